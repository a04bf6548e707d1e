"""Personal data by bootstrapped contextual extraction (SQL functions only).

*Seeds* are the spans of four base expressions (email, ip, card, phone).  The
one or two words in front of a seed are its *lexical patterns*.  Identifier-like
words (with a digit or ``@``, and the groups of digits that follow them) that no
base expression covers are unseen *instances*.  A bipartite graph joins patterns
and different instances, and Spark scores it in ``ROUNDS`` rounds, for each kind:

* an instance's score is 1 for a seed, else the belief of the round before (0 at
  first).  It speaks against a pattern if it is no seed and its shape is not one
  that the kind allows (``SHAPES``); unseen instances of a fitting shape don't;
* the confidence of a pattern with at least ``MIN_SEEDS`` seeds is the sum of its
  scores over that sum plus the instances against it plus ``DOUBT``;
* the belief in an unseen instance of a fitting shape is 1 - prod(1 - c) over the
  confidences c of its patterns; from ``CONFIDENT`` on it is a seed of the later
  rounds, and makes patterns of its own eligible.

Patterns of at least ``CONFIDENT`` then extract the unseen instances in front
of which they stand, if their shape fits.  Base spans always stay.

How it runs on Spark: one pass over the texts keeps, for each expression, the
matches and the lengths of the gaps before them (stored, without texts);
running sums over (document, expression) turn them into places, and running
maxima over a document tell which words a base span covers, so a text with
any number of matches takes linear work.  Scores are sums over edges
aggregated before the shuffle; a frequent context costs its own edges, no pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripple.llm.common import partitions, stored

ROUNDS = 3
MIN_SEEDS = 3
CONFIDENT = 0.8
DOUBT = 0.5
CONTEXT = 80                    # code points in front of a word in which its context words are looked for

# Quantifiers are possessive and starts are tied to the start of a run (or the
# end of the match before): same matches, no deep recursion, linear time.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
SHAPES = {
    "email": r"^[^@]++@[^@]++$",
    "ip": r"^[0-9a-fA-F]{1,4}+(?:[.:][0-9a-fA-F]{0,4}+){2,}+$",
    "card": r"^(?:[^A-Za-z0-9]*+[0-9]){12,}+[^A-Za-z0-9]*+$",
    "phone": r"^(?:[^A-Za-z0-9]*+[0-9]){7,15}+[^A-Za-z0-9]*+$",
}
# a word with a digit or @, and groups of digits behind it
WORD = (r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
        r"(?:\x20[().+-]*+[0-9][0-9().-]*+(?![^\x20\x09-\x0D,;:]))*+")
OUTSIDE = r"[^\p{L}\p{N}@+(]"
NO_SPANS = "array<struct<start:int,no:int,end:int,kind:string>>"


def _digits(value):
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits):
    n = F.length(digits)
    at = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + F.pmod(i, F.lit(2)))
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(i) - 9 * (at(i) > 9).cast("int"))
    return F.pmod(F.aggregate(terms, F.lit(0), lambda s, x: s + x), F.lit(10)) == 0


def _valid(kind: str, value):
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: F.when(
            F.length(bare(p)) <= 3, F.concat(F.lit("0"), bare(p)).cast("int") <= 255).otherwise(False))
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(_digits(value))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _cells(texts: DataFrame) -> DataFrame:
    """``doc_id, row, no, i, gap, len, value, context``: every match of every expression, in the order of the text.

    ``gap`` counts the code points since the match before; ``context`` are the
    last words of the gap in front of an identifier-like word.
    """
    out = []
    text = F.col("text")
    for kind, pattern in [*BASE.items(), ("word", WORD)]:
        gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
        context = lambda g: F.lower(F.substring(g, -CONTEXT, CONTEXT)) if kind == "word" else F.lit("")  # noqa: B023, E731
        cells = F.zip_with(gaps, found, lambda g, m: F.struct(
            F.length(g).alias("gap"), F.length(m).alias("len"), m.alias("value"), context(g).alias("context")))
        needs = text.contains(NEEDS[kind]) if NEEDS.get(kind) else text.rlike("[0-9@]")
        out.append(F.when(needs, cells))
    kinds = F.array(*out)
    each = texts.select("doc_id", "row", F.posexplode(kinds).alias("no", "cells"))
    return each.select("doc_id", "row", "no", F.posexplode("cells").alias("i", "x")).select(
        "doc_id", "row", "no", "i", "x.gap", "x.len", "x.value", "x.context").where("value is not null")


def _places(cells: DataFrame) -> DataFrame:
    """Cells with ``start`` and ``end``, each once (rows equal in id and text have the same)."""
    dealt = cells.repartition(partitions(cells.sparkSession), "doc_id", "row")
    once = Window.partitionBy("doc_id", "row", "no").orderBy("i")
    # copies of a row repeat its cells: only the first of each position counts
    first = F.coalesce(F.lag("i").over(once) < F.col("i"), F.lit(True))
    upto = once.rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumn("first", first).where("first").drop("first")
    end = F.sum(F.col("gap") + F.col("len")).over(upto).cast("int")
    return own.withColumn("end", end).withColumn("start", F.col("end") - F.col("len")).drop("gap", "len", "i")


def _kind(no):
    return F.get(F.array(*map(F.lit, KINDS)), no)


def _base(places: DataFrame) -> DataFrame:
    """``doc_id, row, start, no, end, kind`` of the valid base spans."""
    valid = F.lit(False)
    for no, kind in enumerate(KINDS):
        valid = F.when(F.col("no") == no, _valid(kind, F.col("value"))).otherwise(valid)
    return places.where((F.col("no") < len(KINDS)) & valid).select(
        "doc_id", "row", "start", "no", "end", _kind(F.col("no")).alias("kind"))


def _occurrences(places: DataFrame, base: DataFrame) -> DataFrame:
    """Identifier-like words: those in which a base span begins are its seeds, others inside one are left out."""
    words = places.where(F.col("no") == len(KINDS)).select(
        "doc_id", "row", F.lit(None).cast("int").alias("no"), "context",
        (F.col("start") + F.length(F.regexp_extract("value", f"^({OUTSIDE}*)", 1))).alias("start"),
        F.regexp_replace(F.regexp_replace("value", f"^{OUTSIDE}+", ""), r"[^\p{L}\p{N}]+$", "").alias("value"))
    words = words.where("value <> ''").withColumn("end", F.col("start") + F.length("value"))
    spans = base.select("doc_id", "row", "no", F.lit(None).cast("string").alias("context"), "start",
                        F.lit(None).cast("string").alias("value"), "end")
    both = spans.unionByName(words)
    by_start = Window.partitionBy("doc_id", "row").orderBy("start", F.col("no").asc_nulls_last())
    before = by_start.rowsBetween(Window.unboundedPreceding, -1)
    is_span = F.col("no").isNotNull()
    # base spans sort in front of words with the same start
    reach = F.max(F.when(is_span, F.col("end"))).over(before)
    last = F.last(F.when(is_span, F.struct("start", "no")), True).over(before)
    # the next span: the last one before in the reverse order (a frame that only grows)
    reverse = Window.partitionBy("doc_id", "row").orderBy(F.col("start").desc(), F.col("no").desc_nulls_first())
    nxt = F.last(F.when(is_span, F.struct("start", "no")), True).over(
        reverse.rowsBetween(Window.unboundedPreceding, -1))
    x = both.withColumns({"_reach": reach, "_last": last, "_next": nxt}).where("no is null")
    begun = F.when(F.col("_last.start") == F.col("start"), F.col("_last.no")).when(
        F.col("_next.start") < F.col("end"), F.col("_next.no"))
    x = x.withColumn("seed", _kind(begun)).where(
        F.col("seed").isNotNull() | F.coalesce(F.col("_reach") <= F.col("start"), F.lit(True)))
    near = F.filter(F.split("context", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    x = x.withColumn("_near", near)
    pattern = lambda n: F.concat(F.lit(f"{n} "), F.array_join(F.slice("_near", -n, n), " "))
    patterns = F.array_compact(F.array(*(F.when(F.size("_near") >= n, pattern(n)) for n in (1, 2))))
    return x.select("doc_id", "row", "start", "end", "seed", F.xxhash64(F.lower("value")).alias("instance"),
                    F.array(*(F.when(F.col("value").rlike(SHAPES[k]), F.lit(k)) for k in KINDS)).alias("shapes"),
                    patterns.alias("patterns"))


def scored_patterns(occurrences: DataFrame) -> DataFrame:
    """``kind, pattern, confidence`` of the patterns with enough seeds, after all rounds."""
    each = F.explode("patterns").alias("pattern")
    allowed = F.array(*(F.max(F.coalesce(F.get("shapes", F.lit(i)).isNotNull() | (F.col("seed") == k), F.lit(False)))
                        for i, k in enumerate(KINDS)))
    edges = stored(occurrences.select(each, "instance", "seed", "shapes").groupBy("pattern", "instance")
                   .agg(F.max("seed").alias("seed"), allowed.alias("allowed")), "graph")
    # of each pattern: its instances that speak against each kind
    against = stored(edges.groupBy("pattern").agg(F.array(*(
        F.count_if(~F.get("allowed", F.lit(i))) for i in range(len(KINDS)))).alias("against")), "against")
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    base = edges.where("seed is not null").select(F.col("seed").alias("kind"), "instance").distinct()
    score = base.withColumn("score", F.lit(1.0))
    patterns = None
    for i in range(ROUNDS):
        score = stored(score, f"scores-{i}")
        sums = edges.select("pattern", "instance").join(score, "instance").groupBy("kind", "pattern").agg(
            F.sum("score").alias("total"), F.count_if(F.col("score") >= 1.0).alias("seeds"))
        rated = sums.where(F.col("seeds") >= MIN_SEEDS).join(against, "pattern")
        patterns = stored(rated.select("kind", "pattern", (F.col("total") / (
            F.col("total") + F.get("against", number) + DOUBT)).alias("confidence")), f"patterns-{i}")
        # of an instance: one minus the product of its patterns' doubts
        unseen = edges.where("seed is null").join(patterns, "pattern").where(F.get("allowed", number))
        belief = 1.0 - F.exp(F.sum(F.log(F.greatest(1.0 - F.col("confidence"), F.lit(1e-9)))))
        believed = unseen.groupBy("kind", "instance").agg(belief.alias("score"))
        sure = F.when(F.col("score") >= CONFIDENT, 1.0).otherwise(F.col("score"))
        # base seeds stay seeds; what one kind knows, another may still believe in
        score = (base.withColumn("score", F.lit(1.0)).unionByName(believed.withColumn("score", sure))
                 .groupBy("kind", "instance").agg(F.max("score").alias("score")))
    return patterns


def discovered(occurrences: DataFrame, patterns: DataFrame) -> DataFrame:
    """``doc_id, row, start, no, end, kind`` of unseen identifiers behind confident patterns."""
    sure = patterns.where(F.col("confidence") >= CONFIDENT)
    unseen = occurrences.where("seed is null").select(
        "doc_id", "row", "start", "end", "shapes", F.explode("patterns").alias("pattern"))
    hits = unseen.join(sure, "pattern").where(F.array_contains(F.array_compact("shapes"), F.col("kind")))
    number = (F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1).cast("int")
    return hits.select("doc_id", "row", "start", number.alias("no"), "end", "kind").distinct()


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, row, base, spans``, one row for each input row; spans hold the base spans and the found ones.

    A null text counts as empty and has no spans.  Rows equal in id and text
    have the same spans; null ids are kept.  An empty table gives an empty
    one.  ``row`` is a hash of the text.  Other columns, whatever their
    names, are left out.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    places = stored(_places(stored(_cells(texts), "cells")), "places")
    base = _base(places)
    occurrences = stored(_occurrences(places, base), "occurrences")
    extra = discovered(occurrences, stored(scored_patterns(occurrences), "patterns"))
    found = base.withColumn("_base", F.lit(True)).unionByName(extra.withColumn("_base", F.lit(False)))
    span = F.struct("start", "no", "end", "kind")
    of_row = found.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(
        F.collect_set(F.when(F.col("_base"), span)).alias("base"), F.collect_set(span).alias("spans"))
    rows = texts.select("doc_id", "row")
    joined = rows.join(of_row, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    none = F.array().cast(NO_SPANS)
    return joined.select("doc_id", "row", *(F.array_sort(F.coalesce(c, none)).alias(c) for c in ("base", "spans")))


def span_text(spans):
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text, spans):
    """The text with each span (overlapping ones as one) replaced by ``<KIND>`` of its first.

    A null text stays null; null or no spans leave the text as it is.
    """
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    part = lambda a, b: F.substring(text, a + 1, b - a)
    walked = F.aggregate(spans, zero, lambda s, x: F.struct(
        F.greatest(s["at"], x["end"]).alias("at"),
        F.when(x["start"] >= s["at"], F.concat(s["out"], part(s["at"], x["start"]), F.lit("<"), F.upper(x["kind"]),
                                               F.lit(">"))).otherwise(s["out"]).alias("out")),
                         lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(spans.isNotNull() & (F.size(spans) > 0), walked).otherwise(text)
