"""Document fingerprints by consistent weighted sampling.

The terms of a text are its words, weighted by how often they occur.  Each of
``SAMPLES`` draws gives every term numbers of its own, the same in all texts:
r and c from the gamma distribution with shape 2 (minus the logarithm of a
product of two uniforms) and b, uniform.  For a term of weight S,

    t = floor(ln S / r + b),    ln y = r (t - b),    ln a = ln c - ln y - r,

and the draw keeps the pair (term, t) of the smallest a.  Two texts keep the
same pair with a probability equal to the generalised Jaccard similarity of their
weights, sum(min) / sum(max); weights may be any positive numbers.  The share of
equal draws has a standard error of sqrt(p (1 - p) / SAMPLES) at similarity p:
0.0625 at 0.5, 0.0375 at 0.9.

How it runs on Spark (SQL functions only): words are exploded and counted
inside the partition of their document, so nothing but the texts themselves is
shuffled, once, and the work grows with the different words of a text.  Two
hashes of (term, draw) hold all five uniforms; ln a, in steps of 2**-23, is the
upper half of a 64-bit number whose lower half names the pair, so a draw is one
``min``.  A text and its edited text are drawn together, ``DRAWS`` draws at a time:
a term's hashes and logarithms are worked out once for both.  The document that
follows in id order is found on narrow rows: range partitions, ranks inside
them, and one row for each partition to connect them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripple.llm.common import partitions, stored

SAMPLES = 64
DRAWS = 8                       # draws of one aggregate: little code, which the JVM compiles well (all 64: interpreted)
PART_BYTES = 4 << 20            # text of one partition while words are counted
SPACE = r"[\x20\x09-\x0D]+"
NO_TERMS = -1                   # 32 ones: every draw of a text without words
UNIFORM_BITS, SHORT_BITS = 25, 14       # of a hash: two long uniforms and half of a third
LEAST, STEP_BITS = -128.0, 23   # ln a lies above LEAST and below LEAST + 256


def _ranked(term, log_weight, draw):
    """ln a of a term's draw (a number or an int column) in the upper 32 bits, the name of its (term, t) in the lower ones."""
    first, second = (F.xxhash64(term, F.lit(2) * draw + F.lit(k)) for k in (0, 1))
    bits = lambda h, at, n: F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << n) - 1))
    uniform = lambda h, at: (bits(h, at, UNIFORM_BITS) + 0.5) * 2.0 ** -UNIFORM_BITS
    r = -F.log(uniform(first, 0) * uniform(first, UNIFORM_BITS))
    log_c = F.log(-F.log(uniform(second, 0) * uniform(second, UNIFORM_BITS)))
    at = 2 * UNIFORM_BITS
    b = (F.shiftleft(bits(first, at, SHORT_BITS), SHORT_BITS) + bits(second, at, SHORT_BITS) + 0.5) * 2.0 ** (-2 * SHORT_BITS)
    t = F.floor(log_weight / r + b)
    log_a = log_c - r * (t - b + 1)
    upper = F.shiftleft(F.floor((log_a - LEAST) * 2.0 ** STEP_BITS), 32)
    return upper.bitwiseOR(F.xxhash64(term, t).bitwiseAND(F.lit(0xFFFFFFFF)))


def signatures(texts: DataFrame, key: str, cols: list[str], head=None) -> DataFrame:
    """``key, <col>_sig array<int>...``: a signature for each text column (null: no words) of each key.

    ``texts`` is partitioned by ``key``; keys without words in any text are left out.
    ``head``: what all texts of a row begin with, left out of the columns; it is split once.
    The texts of a key are drawn together: a word's hashes and gamma numbers are the
    same in all of them, so they are worked out once for a key, not once for a text.
    """
    kinds = range(len(cols))
    every = -1
    begun = texts.select(key, *cols, F.split(F.lit("") if head is None else head, SPACE).alias("_begun"))
    # the last piece of the head goes on in each text
    rest = lambda c: F.split(F.concat(F.element_at("_begun", -1), F.col(c)), SPACE)
    sides = [F.struct(F.lit(every).alias("kind"), F.slice("_begun", F.lit(1), F.size("_begun") - 1).alias("w")),
             *(F.struct(F.lit(k).alias("kind"), rest(c).alias("w")) for k, c in enumerate(cols))]
    words = begun.select(key, F.explode(F.array(*sides)).alias("x")).select(
        key, "x.kind", F.explode("x.w").alias("w")).where("w <> ''")
    counted = words.groupBy(key, F.xxhash64("w").alias("term")).agg(
        *(F.count_if(F.col("kind").isin(k, every)).alias(f"n{k}") for k in kinds))
    groups = range(0, SAMPLES, DRAWS)
    # a word that a text lacks has a null weight there: its draws are null and no minimum
    weighed = counted.select(key, "term", *(F.log(f"n{k}").alias(f"log_n{k}") for k in kinds),
                             F.explode(F.array(*map(F.lit, groups))).alias("at"))
    drawn = weighed.groupBy(key, "at").agg(
        *(F.min(_ranked(F.col("term"), F.col(f"log_n{k}"), F.col("at") + F.lit(i))).alias(f"d{k}_{i}")
          for i in range(DRAWS) for k in kinds))
    # the lower 32 bits, as a signed int
    low = lambda c: F.shiftright(F.shiftleft(c, 32), 32).cast("int")
    parts = drawn.select(key, "at", *(
        F.when(F.col(f"d{k}_0").isNotNull(), F.array(*(low(F.col(f"d{k}_{i}")) for i in range(DRAWS)))).alias(f"part{k}")
        for k in kinds))
    return parts.groupBy(key).agg(*(
        F.concat(*(F.any_value(F.when(F.col("at") == g, F.col(f"part{k}")), True) for g in groups)).alias(f"{c}_sig")
        for k, c in enumerate(cols)))


def _hex(sig):
    low = F.lit(0xFFFFFFFF)
    return F.array_join(F.transform(
        sig, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(low)), 8, "0"))), "")


def likeness(a, b):
    """The share of draws with equal samples."""
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x) / float(SAMPLES)


def in_order(rows: DataFrame) -> DataFrame:
    """``rows(row, doc_id, n, ...)`` with ``prev``, ``prev_n`` and ``next`` in order of (doc_id, row), as a ring."""
    ranged = stored(rows.repartitionByRange(partitions(rows.sparkSession), "doc_id", "row")
                    .withColumn("part", F.spark_partition_id()), "ordered")
    own = F.struct("doc_id", "row", "n")
    ends = ranged.groupBy("part").agg(F.min(own).alias("first"), F.max(own).alias("last"))
    # one row for each partition
    w = Window.orderBy("part")
    ring = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("last").over(w), F.last("last").over(ring)).alias("before"),
                       F.coalesce(F.lead("first").over(w), F.first("first").over(ring)).alias("after"))
    w = Window.partitionBy("part").orderBy("doc_id", "row")
    return (ranged.withColumns({"_prev": F.lag("row").over(w), "_prev_n": F.lag("n").over(w),
                                "_next": F.lead("row").over(w)}).join(ends, "part")
            .select(*rows.columns, F.coalesce("_prev", "before.row").alias("prev"),
                    F.coalesce("_prev_n", "before.n").alias("prev_n"),
                    F.coalesce("_next", "after.row").alias("next")))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, sig`` for every document: the plain operator, without edited texts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    keyed = rows.select(_row_key().alias("row"), "doc_id", F.length("text").cast("long").alias("n_chars"), "text")
    sigs = signatures(keyed.dropDuplicates(["row"]).repartition("row"), "row", ["text"])
    return keyed.drop("text").dropDuplicates(["row"]).join(sigs, "row", "left").select(
        "doc_id", "n_chars", F.coalesce("text_sig", _none()).alias("sig"))


def _none():
    return F.array_repeat(F.lit(NO_TERMS).cast("int"), SAMPLES)


def _row_key():
    """128 bits that name a row: equal rows are one document."""
    return F.md5(F.concat_ws("\u0000", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text").cast("binary"))


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    Edited text: the last floor(n/4) code points replaced by the first as many
    (or all) of the next document's, in order of the id (equal ids: of a hash
    of the text; after the last comes the first).  A null text is empty.  A
    text without words has the all-ones fingerprint: likeness 1 to another
    such text, else 0.  Null ids sort first.  Rows equal in id and text are
    one document and give one row; an empty table gives an empty one.  Other
    columns, whatever their names, are left out.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("row", _row_key())
    narrow = (texts.groupBy("row").agg(F.any_value("doc_id").alias("doc_id"),
                                       F.any_value(F.length("text").cast("long")).alias("n"),
                                       F.any_value(F.octet_length("text").cast("long")).alias("bytes")))
    narrow = stored(in_order(narrow), "neighbours")
    total = narrow.agg(F.sum("bytes")).first()[0] or 0
    n_parts = max(partitions(docs.sparkSession), math.ceil(total / PART_BYTES))
    dealt = texts.select("row", "text").repartition(n_parts, "row")
    once = Window.partitionBy("row").orderBy(F.lit(0))
    own = dealt.withColumn("_k", F.row_number().over(once)).where("_k = 1").drop("_k").join(narrow, "row")
    heads = own.select(F.col("prev").alias("row"),
                       F.substring(F.col("text"), F.lit(1), F.floor(F.col("prev_n") / 4).cast("int")).alias("head"))
    kept = (F.col("n") - F.floor(F.col("n") / 4)).cast("int")
    both = own.join(heads, "row").select(
        "row", "doc_id", "n", "next", F.substring(F.col("text"), F.lit(1), kept).alias("kept"),
        F.substring(F.col("text"), kept + 1, F.col("n").cast("int")).alias("text"), F.col("head").alias("edited"))
    sigs = signatures(both, "row", ["text", "edited"], F.col("kept")).withColumnRenamed("text_sig", "sig")
    # one job: all branches share the one shuffle of the texts; what is stored has no texts
    shas = both.select("row", "doc_id", "n", "next",
                       F.sha2(F.concat("kept", "edited").cast("binary"), 256).alias("edited_sha256"))
    prints = stored(shas.join(sigs, "row", "left"), "signatures")
    nxt = prints.select(F.col("row").alias("next"), F.col("sig").alias("next_sig"))
    out = prints.join(nxt, "next", "left")
    sig = {c: F.coalesce(c, _none()) for c in ("sig", "edited_sig", "next_sig")}
    return out.select(
        "doc_id", F.col("n").alias("n_chars"), "edited_sha256", _hex(sig["sig"]).alias("fingerprint"),
        _hex(sig["edited_sig"]).alias("edited_fingerprint"),
        likeness(sig["sig"], sig["edited_sig"]).alias("near_edited"),
        likeness(sig["sig"], sig["next_sig"]).alias("near_next"))
