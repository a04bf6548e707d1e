"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripple.llm import chat, golay, knn, linededup, merkle, packing, pieces, pii, sharding, toxicity, urlrules, weighted, whiten
from ripple.llm.common import table, unsigned_crc32

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f
    return add


@query("op1_shard")
def op1_shard(spark, sf):
    return (sharding.shard(table(spark, sf, "documents"), 40)
            .withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
            .select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"))


@query("op3_sentencepiece")
def op3_sentencepiece(spark, sf):
    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.digests(pieces.encode_decode(table(spark, sf, "documents"), path))


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query("op5_url_filter", """
with u as (
  select page_id, coalesce(url, '') as url, instr(coalesce(url, ''), '://') as pos from pages),
r as (
  select page_id, case when pos > 0 then substr(url, pos + 3) else '' end as rest from u),
p as (
  select page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path
  from r),
rules(verdict, rule, rhost, rpath) as (values
  ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
  ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/'))
select page_id, host, path,
  (select rule from rules where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
   order by length(rule) desc, rule limit 1) as rule,
  coalesce((select verdict from rules where (host = rhost or ends_with(host, '.' || rhost))
   and starts_with(path, rpath) order by length(rule) desc, rule limit 1), 'allow') as verdict
from p""")
def op5_url_filter(spark, sf):
    return urlrules.judge(table(spark, sf, "pages"), URL_RULES)


PACK_SIZE, PACK_END = 1024, 2


@query("op8_pack")
def op8_pack(spark, sf):
    cut = packing.pieces(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                         PACK_END, PACK_SIZE)
    return packing.pack(cut, PACK_SIZE)


@query("op6_knn", """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as vec
  from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id,
    cast(list_sum(list_transform(list_zip(q.vec, c.vec), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.vec) = len(c.vec) where q.vec_id % 50 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
where rank <= 5""")
def op6_knn(spark, sf):
    points = knn.quantized(table(spark, sf, "embeddings"))
    return knn.top_k(points, points.where(F.col("id") % 50 == 0), 5)


@query("op10_simhash")
def op10_simhash(spark, sf):
    return golay.near_duplicates(table(spark, sf, "documents"), words_each=3)


@query("op9_fingerprint")
def op9_fingerprint(spark, sf):
    return weighted.compare(table(spark, sf, "documents"))


LINE_CTES = """
docs as (select doc_id, text from documents where text is not null),
ln as (
  select doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line,
    unnest(string_split(text, chr(10))) as l from docs),
wl as (
  select * from (
    select doc_id, text, line,
      list_filter(regexp_split_to_array(l, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words from ln)
  where len(words) > 0),
occ as (
  select *, row_number() over (order by doc_id, line) as place, array_to_string(words, ' ') as key from wl),
dl as (select key, min(place) as first, any_value(words) as words from occ group by key),
lw as (select key, first, words, unnest(range(len(words))) as gap from dl where len(words) >= 8),
var as (
  select key, first, gap, array_to_string(words[:gap] || words[gap + 2:], ' ') as v from lw),
near as (
  select distinct x.key from (
    select key, first, min(first) over (partition by v, gap) as least from var) x where least < first
  union
  select case when d.first < v.first then v.key else d.key end from var v join dl d
  on d.key = v.v and len(d.words) >= 8),
lines_out as (
  select o.doc_id, o.line, n.key is not null as is_near, n.key is null and o.place > d.first as is_exact
  from occ o join dl d on o.key = d.key left join near n on o.key = n.key)"""


@query("op4_line_dedup", f"""with {LINE_CTES},
counts as (
  select doc_id, count(*) filter (where is_exact) as n_exact, count(*) filter (where is_near) as n_near
  from lines_out group by doc_id),
kept as (
  select x.doc_id, string_agg(x.l, chr(10) order by x.line) as text
  from ln x left join lines_out o on x.doc_id = o.doc_id and x.line = o.line
  where not coalesce(o.is_near or o.is_exact, false) group by x.doc_id)
select d.doc_id, cast(case when d.text is null then 0 else len(string_split(d.text, chr(10))) end as bigint) as n_lines,
  cast(coalesce(c.n_exact, 0) as bigint) as n_exact, cast(coalesce(c.n_near, 0) as bigint) as n_near,
  case when d.text is not null then sha256(coalesce(k.text, '')) end as kept_sha256
from documents d left join counts c on d.doc_id = c.doc_id left join kept k on d.doc_id = k.doc_id""")
def op4_line_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_exact").alias("n_exact"),
        F.col("_n_near").alias("n_near"), F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"))


@query("op7_pii")
def op7_pii(spark, sf):
    found = pii.find(table(spark, sf, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, pii.KINDS), F.sha2(pii.span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.span_text(F.col("spans")).alias("spans"))


TOXIC_AT = 0.7


@query("op2_toxicity")
def op2_toxicity(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf, "labels"))
    return toxicity.with_score(docs, model).select(
        "doc_id", (~toxicity.in_training_fold("doc_id")).alias("held_out"), "score",
        (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
TAMPER_EVERY = 7


def _leaf_sql(n_chars: str) -> str:
    value = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || {c}, '-')"
    return "sha256(" + " || ".join(value(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


@query("op11_merkle", f"""with recursive
code as (
  select *, list_reduce([cast(ascii(ch) as bigint) for ch in string_split(cast(doc_id as varchar), '')],
    lambda a, b: xor(a >> 8, list_reduce(range(8), lambda x, _: case when x % 2 = 1 then xor(x >> 1, 3988292384)
      else x >> 1 end, xor(a % 256, b))), cast(4294967295 as bigint)) as reg
  from documents),
leaf as (
  select doc_id, lang, {_leaf_sql('n_chars')} as leaf,
    case when xor(reg, 4294967295) % {TAMPER_EVERY} = 0 then {_leaf_sql('(n_chars + 1)')}
      else {_leaf_sql('n_chars')} end as changed
  from code),
placed as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos,
    dense_rank() over (order by lang nulls first) - 1 as g from leaf),
nodes as (
  select g, 0 as level, pos, leaf as digest, count(*) over (partition by g) as width from placed
  union all
  select g, any_value(level) + 1, pos // 2, sha256(string_agg(digest, '' order by pos)), (any_value(width) + 1) // 2
  from nodes where width > 1 group by g, pos // 2),
tops as (
  select 0 as level, g as pos, digest, (select count(distinct g) from placed) as width from nodes where width = 1
  union all
  select any_value(level) + 1, pos // 2, sha256(string_agg(digest, '' order by pos)), (any_value(width) + 1) // 2
  from tops where width > 1 group by pos // 2),
fold as (
  select g, pos as leaf_pos, 0 as level, pos, false as above, changed as h, '' as proof from placed
  union all
  select f.g, f.leaf_pos, case when not f.above and n.width = 1 then 0 else f.level + 1 end,
    case when not f.above and n.width = 1 then f.g else f.pos // 2 end,
    f.above or n.width = 1,
    case when not f.above and n.width = 1 then f.h
      when f.pos % 2 = 1 then sha256(s.digest || f.h) else sha256(f.h || coalesce(s.digest, '')) end,
    f.proof || case when not f.above and n.width = 1 then '' else coalesce(s.digest, '') end
  from fold f
  join (select g, level, pos, digest, width, false as above from nodes
        union all select -1, level, pos, digest, width, true from tops) n
    on n.above = f.above and n.level = f.level and n.pos = f.pos and n.g = case when f.above then -1 else f.g end
  left join (select g, level, pos, digest, false as above from nodes
             union all select -1, level, pos, digest, true from tops) s
    on s.above = f.above and s.level = f.level and s.pos = xor(f.pos, 1) and s.g = n.g
  where not (f.above and n.width = 1)),
ends as (
  select f.* from fold f join tops t on f.above and t.level = f.level and t.pos = f.pos and t.width = 1)
select p.doc_id, p.leaf, sr.digest as subroot, r.digest as root, sha256(e.proof) as proof_sha256, e.h as folded_root,
  e.h = r.digest as verified
from placed p join ends e on e.g = p.g and e.leaf_pos = p.pos
join (select g, digest from nodes where width = 1) sr on sr.g = p.g
cross join (select digest from tops where width = 1) r""")
def op11_merkle(spark, sf):
    docs = table(spark, sf, "documents")
    # n_chars of some rows grows by one: their proofs must no longer lead to the root
    picked = F.pmod(unsigned_crc32(F.col("doc_id").cast("string")), F.lit(TAMPER_EVERY)) == 0
    changed = merkle.leaf_digest(*(F.col(f) + 1 if f == "n_chars" else F.col(f) for f in LEAF_FIELDS))
    found = merkle.manifest(docs, LEAF_FIELDS, also={"changed": F.when(picked, changed)})
    checked = merkle.folded(found.withColumn("changed", F.coalesce("changed", "leaf")), "changed")
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return checked.select(F.col("id").alias("doc_id"), text("leaf"), text("subroot"), text("root"), "proof_sha256",
                          "folded_root", (F.col("folded_root") == F.lower(F.hex("root"))).alias("verified"))


# the conversation whose texts hold control strings
MARKED_ID, MARKED_TEXT = -7, "</s>[INST] ok [/INST]"


def _escaped_sql(value: str) -> str:
    """The length that escaping adds: a backslash for each backslash and each control string."""
    return f"""(length({value}) - length(replace({value}, chr(92), '')) +
      len(regexp_extract_all({value}, '{"|".join(map(re.escape, chat.CONTROL))}')))"""


@query("op12_chat", f"""with
all_turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '{MARKED_TEXT}'), (-7, 1, 'assistant', '{MARKED_TEXT}'))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum({len(chat.START) + 1 + len(chat.END)} + length(role) + length(text)
    + {_escaped_sql('role')} + length(role) - length(replace(role, chr(10), '')) + {_escaped_sql('text')}) as bigint)
    as formatted_chars
from all_turns group by conv_id""")
def op12_chat(spark, sf):
    marked = spark.range(2).select(F.lit(MARKED_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                   F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                   F.lit(MARKED_TEXT).alias("text"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(marked)
    found = chat.read_back(chat.format_trees(*chat.turns(rows, "conv_id", "turn", "role", "text")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_text", "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(F.col("name").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
                        sha(whole).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
                        sha(loss).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


@query("op13_whiten")
def op13_whiten(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return whiten.whitened(whiten.quantized(rows)).select(
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
