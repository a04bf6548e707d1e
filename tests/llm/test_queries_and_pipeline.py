"""The registered queries' own columns and constants, plain counterparts of op1 and op2, and the pipeline stage by stage."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ripple.llm import golay, packing, pii, queries, sharding, toxicity

SF001 = "/root/testdata/sf0.001"


# -- 1 sharding -------------------------------------------------------------

def plain_differencing(sizes, k):
    """The part sums: the two partial partitions of largest spread are combined, largest with smallest."""
    lists = [[s] + [0] * (k - 1) for s in sizes]
    while len(lists) > 1:
        lists.sort(key=lambda p: -(p[0] - p[-1]))
        a, b, *lists = lists
        lists.append(sorted((x + y for x, y in zip(a, reversed(b))), reverse=True))
    return lists[0]


@pytest.mark.parametrize("k", [2, 3, 7])
def test_shard_sums_equal_plain_differencing(k):
    r = np.random.default_rng(k)
    sizes = r.permutation(10_000)[:60]                         # no ties between spreads of single items
    part = sharding.karmarkar_karp(sizes, k)
    sums = sorted((int(sizes[part == p].sum()) for p in range(k)), reverse=True)
    want = plain_differencing(sizes.tolist(), k)
    assert sum(sums) == sum(want) and sums[0] - sums[-1] == want[0] - want[-1]


def test_op1_columns(spark):
    rows = queries.QUERIES["op1_shard"](spark, SF001).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    assert len(rows) == len(docs) and {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    assert {r["shard"] for r in rows} <= set(range(40))
    for r in rows:
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
    of_text = {}
    for r in rows:
        of_text.setdefault(docs[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for s in of_text.values())
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))


# -- 2 toxicity -------------------------------------------------------------

def plain_logit(model, words):
    """One window by loops over time and gates."""
    p, h = model.p, toxicity.HIDDEN
    sig = lambda v: 1 / (1 + np.exp(-v))
    x = []
    for w in words:
        bare = toxicity.bare(w)
        grams, _ = toxicity.trigrams([bare])
        char = np.mean([p["char"][g] for g in grams], axis=0)
        x.append(np.concatenate([p["word"][model.vocabulary.get(bare, 0)], char]) @ p["w"] + p["b"])
    states = []
    for u, part, order in ((p["uf"], 0, range(len(x))), (p["ub"], 3 * h, range(len(x) - 1, -1, -1))):
        state, out = np.zeros(h), {}
        for t in order:
            g, hu = x[t][part:part + 3 * h], state @ u
            z, r = sig(g[:h] + hu[:h]), sig(g[h:2 * h] + hu[h:2 * h])
            new = np.tanh(g[2 * h:] + r * hu[2 * h:])
            state = (1 - z) * new + z * state
            out[t] = state
        states.append(out)
    s = [np.concatenate([states[0][t], states[1][t]]) for t in range(len(x))]
    e = np.array([float((np.tanh(v @ p["a"] + p["ab"]) @ p["v"])[0]) for v in s])
    alpha = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
    return float((sum(a * v for a, v in zip(alpha, s)) @ p["o"])[0] + p["ob"][0])


def test_forward_pass_equals_plain_loops():
    r = np.random.default_rng(4)
    vocabulary = {f"w{i}": i + 1 for i in range(30)}
    model = toxicity.Model(vocabulary, 3)
    for k in model.p:
        model.p[k] = (model.p[k] + 0.3 * r.standard_normal(model.p[k].shape)).astype(np.float32)
    model.scale = (1.3, -0.2)
    texts = [" ".join(f"W{r.integers(40)}," if r.random() < 0.2 else f"w{r.integers(40)}" for _ in range(n))
             for n in (1, 7, 39, 40, 41, 95, 140)]
    for text, got in zip(texts, model.scores(texts)):
        words = text.lower().split()
        best = max(plain_logit(model, words[a:b]) for a, b in toxicity.windows_of(len(words)))
        assert got == pytest.approx(1 / (1 + math.exp(-(1.3 * best - 0.2))), abs=2e-4)
        # windows overlap and cover every word
        spans = toxicity.windows_of(len(words))
        assert spans[0][0] == 0 and spans[-1][1] == len(words)
        assert all(b > c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_op2_columns(spark):
    rows = queries.QUERIES["op2_toxicity"](spark, SF001).collect()
    assert len(rows) == spark.read.parquet(f"{SF001}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


@pytest.mark.parametrize("name,columns", [
    ("op3_sentencepiece", {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}),
    ("op5_url_filter", {"page_id", "host", "path", "rule", "verdict"}),
    ("op6_knn", {"query_id", "rank", "vec_id", "score"}),
    ("op7_pii", {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}),
    ("op8_pack", {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}),
    ("op9_fingerprint", {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"}),
    ("op10_simhash", {"doc_id", "fingerprint", "component_id"})])
def test_columns_of_the_registered_queries(spark, name, columns):
    df = queries.QUERIES[name](spark, SF001)
    assert columns <= set(df.columns) and df.count() > 0


# -- the pipeline -----------------------------------------------------------

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, line int"


def odd_rows(spark, n=40):
    texts = [f"line of words that only document number {i} holds here\nsecond line {i}" for i in range(n)]
    shared = "this line of many words stands in more than one of the documents"
    rows = [(i, t + ("\n" + shared if i % 4 == 0 else ""), "en", "s", len(t), 0.5, 1) for i, t in enumerate(texts)]
    rows += [(100, None, None, None, None, None, None), (101, "", "en", "s", 0, 0.1, 2), (None, "no id but words enough for it", "en", "s", 3, 0.2, 3),
             (102, shared, "en", "s", 3, 0.1, 4), (103, "mail a@b.c or 1.2.3.4", "en", "s", 3, 0.1, 5), (104, texts[3], "en", "s", 3, 0.1, 6),
             (105, texts[5], "en", "s", 3, 0.1, 7), (105, texts[5], "en", "s", 3, 0.1, 7), (106, " ".join(f"w{i}" for i in range(9000)), "en", "s", 9, 0.1, 8)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def plain_lines(rows):
    """Lines equal to an earlier one go; near ones are told apart by tests of their own. {(id, text): kept or None}."""
    words = lambda line: tuple(w for w in re.split(r"[\x20\x09-\x0D]+", line) if w)
    order = sorted({(r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in rows if r["text"] is not None}, key=lambda t: t[:2])
    seen, out = [], {}
    for has, i, text in order:
        kept, gone = [], 0
        for line in text.split("\n"):
            w = words(line)
            near = w and (w in seen or len(w) >= 8 and any(len(v) >= 8 and one_edit(v, w) for v in seen))
            gone += bool(near)
            if not near:
                kept.append(line)
            if w:
                seen.append(w)
        new = "\n".join(kept)
        out[i if has else None, text] = None if gone and not words(new.replace("\n", " ")) else new
    return out


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1:] or (len(a) == len(b) and a[i + 1:] == b[i + 1:])


def key(r):
    return (r["doc_id"], r["text"], r["lang"], r["source"], r["score"], r["line"])


def test_line_stage_equals_plain(spark):
    docs = odd_rows(spark)
    rows = docs.collect()
    want = plain_lines(rows)
    out = corpus_pipeline.drop_lines(spark, docs, SF001)
    assert out.columns == docs.columns
    expected = Counter()
    for r in rows:
        kept = None if r["text"] is None else want[r["doc_id"], r["text"]]
        if r["text"] is None or kept is not None:
            expected[r["doc_id"], kept, r["lang"], r["source"], r["score"], r["line"]] += 1
    got = out.collect()
    assert Counter(map(key, got)) == expected
    assert all(r["n_chars"] == len(r["text"]) for r in got if r["text"] is not None)


def test_near_copies_and_personal_data_stages(spark):
    docs = odd_rows(spark)
    kept = corpus_pipeline.keep_one(spark, docs, SF001)
    near = golay.near_duplicates(docs, words_each=3).collect()
    assert kept.columns == docs.columns and kept.count() == len({r["component_id"] for r in near})
    rows = corpus_pipeline.redact(spark, docs, SF001)
    assert rows.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    assert rows.count() == docs.count() and texts[103] == "mail <EMAIL> or <IP>"
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(texts[i] == before[i] for i in before if i != 103)


def test_toxicity_stage(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, SF001)
    scores = queries.QUERIES["op2_toxicity"](spark, SF001)
    assert kept.columns == docs.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in scores.collect() if r["score"] < 0.7}
    odd = corpus_pipeline.drop_toxic(spark, odd_rows(spark), SF001)     # a column named score is kept as it is
    assert odd.columns == odd_rows(spark).columns and {r["score"] for r in odd.collect()} <= {0.5, None, 0.1, 0.2}


def test_packing_stage(spark):
    docs = odd_rows(spark)
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = corpus_pipeline.pack(spark, docs, SF001).collect()
    total = sum(len(model.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sum(r["length"] for r in rows) == total and max(r["length"] for r in rows) <= 1024


def test_the_whole_pipeline(spark):
    # run() equals the stages one after the other, each on what its predecessor kept
    docs, sizes = spark.read.parquet(f"{SF001}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF001).collect(), docs.schema)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    want = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, 1024)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, SF001)
    assert Counter(map(tuple, got.select(columns).collect())) == Counter(map(tuple, want.select(columns).collect()))


def test_stages_on_an_empty_table(spark):
    none = odd_rows(spark).where("doc_id < -1")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF001).collect() == [], name
    assert pii.find(none).collect() == [] and math.isfinite(golay.near_duplicates(none).count())
    assert none.select(F.count(F.lit(1))).first()[0] == 0
