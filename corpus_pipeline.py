"""Corpus pipeline over ``documents``: toxicity, line dedup, near dedup, personal data, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of documents.  Cases all
stages share: null texts and ids pass through, an empty table stays empty,
further columns are carried along (names that begin with ``_`` are taken).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripple.llm import golay, linededup, packing, pii, toxicity
from ripple.llm.common import stored, table

TOXIC_AT = 0.7
SHINGLE_WORDS = 3
PACK_SIZE, PACK_END = 1024, 2


def _with_text(docs: DataFrame, text) -> DataFrame:
    """``docs`` with a new text and, where they have one, its n_chars (null text: as it was)."""
    out = docs.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below ``TOXIC_AT`` stay; repeated rows share their fate."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_score(docs, model, score_col="_toxicity").where(F.col("_toxicity") < TOXIC_AT).drop("_toxicity")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that occur earlier; a document that loses its last words goes."""
    lines = linededup.dedup_lines(docs)
    gone = F.col("_n_exact") + F.col("_n_near")
    lines = lines.where((gone == 0) | F.col("_kept").rlike(r"[^\x20\x09-\x0D]"))
    return _with_text(lines, F.col("_kept")).select(*docs.columns)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the smallest id (no id: last) stays, in one row."""
    return golay.representatives(docs, words_each=SHINGLE_WORDS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts replaced by ``<KIND>``; every document stays."""
    found = (pii.find(docs).where(F.size("spans") > 0)
             .groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.any_value("spans").alias("_spans")))
    own = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    joined = docs.withColumn("_own", own).join(
        found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_row")), "left")
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(pii.redact(F.col("text"), F.col("_spans")))
    return _with_text(joined, text).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    cut = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), PACK_END, PACK_SIZE)
    return packing.pack(cut, PACK_SIZE)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("simhash_dedup", keep_one), ("pii", redact),
          ("packing", pack)]

# training and the packing rule are not expressible in SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
