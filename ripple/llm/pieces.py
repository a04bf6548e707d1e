"""SentencePiece encoding and decoding through a table of distinct chunks.

The library marks a space as ``▁``.  Where no piece of the model has a
``▁`` after another character, merges cannot cross from a word into the
next marker, so a text is a row of *chunks* (markers followed by
non-markers) that are segmented independently.  Each task keeps a table
chunk -> (ids, decoded text): the library segments and decodes each distinct
chunk once, and the ids of a text are joined back by the positions of its
chunks.  The table is emptied when it reaches ``TABLE_CHUNKS`` entries; a
later chunk is then segmented again, so memory is bounded and results are
the same.  There is no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripple.llm.common import slices

TABLE_CHUNKS = 400_000
MARK = "▁"
CHUNK = re.compile(" +[^ ]*")


def chunks_of(text: str) -> list[str]:
    """The chunks of a text, each without its first marker and with spaces as markers."""
    text = text.replace(MARK, " ")
    if not text:
        return []
    if "  " in text or text[0] == " ":
        return [x[1:] for x in CHUNK.findall(" " + text)]
    return text.split(" ")


def separable(model: sentencepiece.SentencePieceProcessor) -> bool:
    """True if chunks are independent: markers lead each piece, one is added in front, spaces stay."""
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return (not any(MARK in p.lstrip(MARK) for p in pieces)
            and model.encode("a", out_type=str)[0].startswith(MARK)
            and model.decode(model.encode(" a  b ")) == " a  b "
            and all(model.decode(model.encode(x)) == x for x in ("Ａ①", "é", "　x")))


class ChunkTable:
    """Distinct chunks with their ids (32-bit little-endian) and decoded text."""

    def __init__(self, model_path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        if not separable(self.model):
            raise ValueError(f"{model_path}: its pieces or its normalizer cross whitespace markers")
        self.lone = [self.model.piece_to_id(MARK)]
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, str] = {}

    def learn(self, texts: list[list[str]]) -> None:
        """Segment the chunks that the table does not hold yet."""
        missing = set().union(*texts).difference(self.ids)
        if len(self.ids) + len(missing) > TABLE_CHUNKS:
            self.ids.clear()
            self.text.clear()
            missing = set().union(*texts)
        todo = list(missing)
        for chunk, ids in zip(todo, self.model.encode(todo, num_threads=1)):
            ids = ids or self.lone              # the library has nothing for a lone marker at a text's end
            self.ids[chunk] = np.array(ids, "<i4").tobytes()
            self.text[chunk] = " " + (self.model.decode(ids) if chunk else "")

    def encode(self, chunks: list[str]) -> bytes:
        return b"".join([self.ids[c] for c in chunks])

    def decode(self, chunks: list[str]) -> str:
        return "".join([self.text[c] for c in chunks])[1:]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>, decoded string`` for every row, whole texts, no begin or end ids.

    A null text counts as empty: no ids, empty decoded text.  Null ids and
    repeated rows are kept as they are; an empty table gives an empty one.
    Other columns, whatever their names, are left out.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ChunkTable(model_path)
        for batch in slices(batches):
            texts = [chunks_of(t or "") for t in batch.column(1).to_pylist()]
            known.learn(texts)
            ids = [known.encode(c) for c in texts]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat),
                 pa.array([known.decode(c) for c in texts], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, ids array<int>, decoded string")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, decoded`` from a column of ids (null: empty), by the library's ``decode``."""
    kind = dict(encoded.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for batch in slices(batches):
            ids = [x or [] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.decode(ids) if ids else [], pa.string())],
                                             names=["doc_id", "decoded"])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(
        run, f"doc_id {kind}, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """Per document: number of ids and SHA-256 of the comma-joined ids and of the decoded text."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
