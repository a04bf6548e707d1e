"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint of 64 bits has three segments (22, 21 and 21 bits), each
padded with zeros to the 23 bits of the perfect binary Golay code, which
decodes every word to the one codeword within distance 3.  The *indices* of a
segment are the codewords of the words within one flip of it: two segments
at distance 2 or less have a word within one flip of both, so they share an
index.  Fingerprints that differ in at most two bits agree in one segment
entirely (pigeonhole over three), and differ by at most two in the next.  A
key is a segment taken exactly with one index of the next segment; linked
fingerprints share at least one of their keys.

How it runs on Spark: documents collapse to distinct fingerprints first
(copies of any number cost one row).  Keys are counted; members of a key with
at most ``BUCKET`` fingerprints are joined and verified by their differing
bits.  Members of larger keys go the exact way: every fingerprint within one
flip is a *point*; fingerprints that share a point are at most two bits
apart, a point has at most 65 of them, and each is linked to the smallest.
No link is lost and no group is compared pair by pair.  Components come from
repeated contraction of the links (hash-ordered hooking), stored each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripple.llm.common import slices, stored

SEED = 42
SEGMENTS = ((42, 22), (21, 21), (0, 21))                # lowest bit and width
GENERATOR = 0b110001110101                              # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
BUCKET = 16
SHINGLE_BLOCK = 65_536


# -- fingerprints -----------------------------------------------------------

def simhash(text: str, words_each: int) -> int:
    """The 64-bit fingerprint: a bit is 1 if it is set in over half of the shingles' hashes."""
    words = text.encode().lower().split()                # bytes: A-Z, and white space \x20 and \x09-\x0D
    n = len(words) - words_each + 1
    if not words:
        return 0
    shingles = [b" ".join(words)] if n < 1 else map(b" ".join, zip(*(words[i:] for i in range(words_each))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), ">u8", max(n, 1))
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), SHINGLE_BLOCK):
        ones += np.unpackbits(hashes[a:a + SHINGLE_BLOCK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words_each: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: the fingerprint of every row as a signed 64-bit integer.

    No words (null, empty or blank text): fingerprint zero.  Fewer words
    than a shingle: the whole sequence is the one shingle.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([simhash(t or "", words_each) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, fp long")


# -- Golay indices ----------------------------------------------------------

def _remainder(v: int) -> int:
    for bit in range(22, 10, -1):
        if v >> bit & 1:
            v ^= GENERATOR << (bit - 11)
    return v


class Golay:
    """Decoding of 23-bit words to the 12-bit index of the nearest codeword."""

    def __init__(self):
        column = [_remainder(1 << i) for i in range(23)]
        self.low, self.high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
        for i in range(23):
            t, bit = (self.low, i) if i < 12 else (self.high, i - 12)
            t[(np.arange(len(t)) >> bit & 1) == 1] ^= column[i]
        self.error = np.zeros(1 << 11, np.int64)         # remainder -> error word of weight 3 or less
        flips = [0, *(1 << i for i in range(23))]
        for a in flips:
            for b in flips:
                for c in flips:
                    e = a | b | c
                    self.error[self.low[e & 0xFFF] ^ self.high[e >> 12]] = e

    def index(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.error[self.low[words & 0xFFF] ^ self.high[words >> 12]]) >> 11

    def indices(self, words: np.ndarray, width: int) -> np.ndarray:
        """A row for each word: the indices of the word and of its one-flip neighbours, repeats included."""
        flips = np.array([0, *(1 << i for i in range(width))], np.int64)
        return self.index(words[:, None] ^ flips[None, :])


def keys_of(fps: np.ndarray, code: Golay) -> list[list[int]]:
    """The distinct keys of each fingerprint (signed 64-bit in, keys of 36 bits out)."""
    parts = [((fps.view(np.uint64) >> np.uint64(at)) & np.uint64((1 << w) - 1)).astype(np.int64) for at, w in SEGMENTS]
    found = []
    for s in range(len(SEGMENTS)):
        nxt = (s + 1) % len(SEGMENTS)
        own = (s << 34 | parts[s] << 12)[:, None] | code.indices(parts[nxt], SEGMENTS[nxt][1])
        found.append(own)
    return [sorted(set(row)) for row in np.concatenate(found, axis=1).tolist()]


def fuzzy_keys(distinct: DataFrame) -> DataFrame:
    """``fp, key`` for each distinct fingerprint and key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for batch in slices(batches, 4096):
            keys = keys_of(batch.column(0).to_numpy(), code)
            ends = np.cumsum([0, *map(len, keys)], dtype=np.int32)
            flat = pa.array([k for row in keys for k in row], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)],
                                             names=["fp", "keys"])

    return distinct.select("fp").mapInArrow(run, "fp long, keys array<long>").select("fp", F.explode("keys").alias("key"))


# -- links ------------------------------------------------------------------

def links(distinct: DataFrame) -> DataFrame:
    """``a, b`` (a < b): links of at most two differing bits that connect what is connected."""
    keyed = stored(fuzzy_keys(distinct), "keys")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(keyed.join(sizes, "key"), "members")
    few = members.where(F.col("n") <= BUCKET).select("key", "fp")
    near = (few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), "key")
            .where("a < b and bit_count(a ^ b) <= 2").select("a", "b"))
    points = (members.where(F.col("n") > BUCKET).select("fp").distinct()
              .select("fp", F.explode(F.array(F.col("fp"), *(
                  F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)))).alias("point")))
    centers = points.groupBy("point").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    ball = (points.join(centers, "point").where("a < fp and bit_count(a ^ fp) <= 2")
            .select("a", F.col("fp").alias("b")))
    return near.unionByName(ball).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: one root for all nodes that ``edges(a, b)`` connect.

    Each round every node hooks onto the neighbour (or itself) with the
    smallest hash for that round, and edges move to the hooks; the hash order
    keeps long chains from shrinking by one node a round.
    """
    edges = stored(edges.select("a", "b").where("a <> b"), "links")
    labels = None
    for turn in range(200):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("x"))
        hooks = stored(both.groupBy(F.col("a").alias("node"))
                       .agg(F.min(F.least(order("a"), order("b")))["x"].alias("hook")), "hooks")
        if labels is None:
            labels = hooks.withColumnRenamed("hook", "root")
        else:
            moved = hooks.select(F.col("node").alias("root"), "hook")
            labels = stored(labels.join(moved, "root", "left")
                            .select("node", F.coalesce("hook", "root").alias("root")), "labels")
        end = lambda c: hooks.select(F.col("node").alias(c), F.col("hook").alias(c + "2"))
        edges = stored(edges.join(end("a"), "a").join(end("b"), "b").where("a2 <> b2")
                       .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "links")
        if edges.isEmpty():
            return labels
    raise RuntimeError("components: the links did not contract")


def classes(docs: DataFrame, words_each: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, root``: rows with one root are connected by links of two bits or fewer."""
    prints = stored(fingerprints(docs, words_each, id_col, text_col), "fingerprints")
    joined = components(links(prints.select("fp").distinct()))
    return prints.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select(
        "doc_id", "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, words_each: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` (the smallest doc_id reachable), one row for each input row.

    Texts without words (null, empty, blank) have fingerprint zero and link
    like any other.  Repeated rows are kept.  A null id is kept and never a
    component's smallest unless the component has no other.  An empty table
    gives an empty one.  Other columns, whatever their names, are left out.
    """
    rows = stored(classes(docs, words_each, id_col, text_col), "classes")
    least = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "root").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, words_each: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id, in a single row.

    A null id counts as the largest; between rows with one id a hash of the
    whole row decides.  All columns are kept.
    """
    own = docs.withColumn("_row", F.xxhash64(*(F.col(c) for c in docs.columns)))
    named = own.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"),
                                F.col("_row").alias("row")).alias("_name"), F.col(text_col).alias("text"))
    first = (classes(named, words_each, "_name", "text").groupBy("root").agg(F.min("doc_id").alias("w"))
             .select(F.col("w.id").alias("_id"), F.col("w.row").alias("_first")))
    kept = own.join(first, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_first")))
    once = Window.partitionBy(id_col, "_row").orderBy(F.lit(0))
    return kept.withColumn("_k", F.row_number().over(once)).where("_k = 1").select(*docs.columns)
