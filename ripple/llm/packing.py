"""Packing token pieces into sequences by the sum-of-squares rule.

Documents are tokenized, closed with an end id and cut into pieces of at
most ``size`` tokens (only documents longer than ``size`` are cut; their
first piece takes the remainder, the others are full).  A full piece is a
sequence of its own.  The others are packed: an open sequence of residual gap
g counts in N(g), and a piece goes where the sum of N(g)**2 over all gaps
becomes smallest.  Two rules make the result as small as best-fit decreasing
(measured: within 0.2 % of the total length divided by the size): pieces come
in falling length, and a new sequence is opened only when no open one has
room.

How it runs on Spark: tokenizing is one pass without a shuffle; only the
narrow pieces (no text, no ids) are stored in the shared folder.  They are
dealt by hash into blocks of about ``BLOCK_PIECES``, and each block is packed
on its own in one task, so a task's memory and time are bounded at any input
size; what blocks cost is their last open sequences.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ripple.llm.common import slices, stored

BLOCK_PIECES = 32_768
TABLE_BYTES = 64 << 20          # of a worker's word table, above which it starts anew
ENTRY_BYTES = 150               # of an entry besides its word and ids
LEARN_WORDS = 1024
# White space in the widest sense (controls and format characters included): a cut
# that is left out costs time, a cut that is wrong costs ids.
_WIDE = r"\s\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff"
RUN = re.compile(f"[{_WIDE}] ")
RUN_CUT = re.compile(f"(?<=[^{_WIDE}]) ")
LATIN = re.compile("[\n!-~\u00a1-\u024f]*")
# the byte-level pattern of the library's pre-tokenizer
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ODD = re.compile(f"^$| |[{_WIDE}]\\Z")


class ChunkIds:
    """Ids of texts through a table of their distinct space-led words.

    The pre-tokenizer's pattern never runs from a character that is not white
    space into a space, and it never looks behind.  So a text may be cut in
    front of every space that follows a character other than white space, and
    its ids are those of the parts, which the table holds.  New parts are
    encoded many at a time (words of Latin letters by the same merges as
    ranks); those that hold a space or end in white space one by one.
    """

    def __init__(self, path: str):
        self.model = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.held = 0
        # bytes of each id: a character of a byte-level token is a byte
        self.width = np.array([len(self.model.id_to_token(i)) for i in range(self.model.get_vocab_size())])
        self.ranks, self.special = self._ranked(path)

    def _ranked(self, path: str) -> tuple[tiktoken.Encoding | None, re.Pattern]:
        """The same merges as ranks, for Latin words (five times as fast), where the file is of that kind."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens") or []}
        vocab, first = spec["model"]["vocab"], spec.get("pre_tokenizer") or {}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [vocab["".join(m)] for m in pairs]
        known = set(made)
        # byte-level letters: printable bytes are themselves, the others follow from U+0100 on
        own = [*range(0x21, 0x7f), *range(0xa1, 0xad), *range(0xae, 0x100)]
        letters = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*own}))}
        plain = (first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
                 and not spec.get("normalizer") and made == sorted(made) and not spec["model"].get("dropout")
                 and all(len(t) == 1 or t in special for t, i in vocab.items() if i not in known))
        never = re.compile("|".join(map(re.escape, special)) or r"\Z\A.")
        if not plain:
            return None, never
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), never

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _learn(self, words: list[str], encode: Callable[[str], list[int]]) -> None:
        """Many words in one text; ids are told apart by the bytes they stand for."""
        for at in range(0, len(words), LEARN_WORDS):
            part = words[at:at + LEARN_WORDS]
            text = " " + " ".join(part)
            ids = np.array(encode(text), "<u4")
            raw = ids.tobytes()
            starts = np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == 0x20)
            cuts = np.searchsorted(np.cumsum(self.width[ids]), starts[1:]) + 1
            ends = [*(4 * cuts).tolist(), len(raw)]
            self.known.update(zip(part, [raw[a:b] for a, b in zip([0, *ends], ends)]))
            self.held += len(raw) + len(text) + ENTRY_BYTES * len(part)

    def _parts(self, text: str) -> list[str]:
        """The text cut in front of the spaces, without these spaces."""
        return RUN_CUT.split(text) if RUN.search(text) else text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if self.held > TABLE_BYTES:
            self.known, self.held = {}, 0
        parts = [self._parts(t) for t in texts]
        missing = set(chain.from_iterable(parts)).difference(self.known)
        odd = set(filter(ODD.search, missing))
        plain = missing - odd
        if self.ranks:
            latin = {w for w in plain if LATIN.fullmatch(w) and not self.special.search(w)}
            self._learn(list(latin), self.ranks.encode_ordinary)
            plain -= latin
        self._learn(list(plain), lambda t: self.model.encode_batch_fast([t], add_special_tokens=False)[0].ids)
        if odd:
            odd = list(odd)
            found = self._ids([" " + w for w in odd])
            self.known.update(zip(odd, found))
            self.held += sum(map(len, odd)) + sum(map(len, found)) + ENTRY_BYTES * len(odd)
        # the first part of a text has no space in front of it
        firsts = list({p[0] for p in parts})
        first = dict(zip(firsts, self._ids(firsts)))
        known = self.known
        return [first[p[0]] + b"".join([known[w] for w in p[1:]]) for p in parts]


_MODELS: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    """The table of this worker process: later tasks go on with it, one is held for each tokenizer."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core; threads would keep buffers of their own
    if path not in _MODELS:
        _MODELS[path] = ChunkIds(path)
    return _MODELS[path]


def piece_lengths(n: int, size: int) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens."""
    if n <= size:
        return [n]
    first = n % size
    return [first] * (first > 0) + [size] * (n // size)


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, size: int, id_col: str = "doc_id",
           text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids`` if kept), one row for each piece.

    A null text counts as empty; an empty text is its end id alone.  Null ids
    are kept.  Every row is cut, repeated rows included; an empty table gives
    an empty one.  A text of any length is tokenized whole.  Other columns,
    whatever their names, are left out.
    """
    kind = dict(docs.dtypes)[id_col]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = chunk_ids(tokenizer_path)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows, took = [], []
            for at, ids in enumerate(model.encode(texts)):
                ids, start = ids + end, 0
                for k, n in enumerate(piece_lengths(len(ids) // 4, size)):
                    own = ids[4 * start:4 * (start + n)]
                    rows.append((k, start, n, zlib.crc32(own)))
                    took.append((at, own))
                    start += n
            columns = [batch.column(0).take(pa.array([a for a, _ in took], pa.int32()))]
            columns += [pa.array([r[i] for r in rows], t) for i, t in enumerate(
                (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                ends = np.cumsum([0, *(len(x) // 4 for _, x in took)])
                flat = np.frombuffer(b"".join(x for _, x in took), "<u4").astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item (lengths 1 to ``size``); equal lengths are taken in the order given."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(size + 1, np.int64)                 # N(g); N(0) stays 0: a full sequence isn't open
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    n_bins = 0
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        room = np.flatnonzero(count[s:])                 # gap minus s, where a sequence is open
        if len(room):
            change = count[room] - count[s + room]       # of the sum of squares, halved and shifted by one
            left = int(room[int(np.argmin(2 * change - (room == 0)))])
            gap = s + left
            at = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, at, n_bins = size, n_bins, n_bins + 1
            left = size - s
        bins[i], offsets[i] = at, size - gap
        if left:
            open_bins[left].append(at)
            count[left] += 1
    return bins, offsets


def pack(cut: DataFrame, size: int) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset`` (gapless from 0 in each sequence).

    Every piece is placed, repeated rows included; an empty table gives an
    empty one.  Null ids are kept; further columns are carried along (names
    that begin with ``_`` are taken).  Sequence ids are unique numbers without
    meaning.
    """
    own = stored(cut.withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    n = own.where(F.col("length") < size).count()
    n_blocks = max(1, math.ceil(n / BLOCK_PIECES))
    schema = own.schema.simpleString()[len("struct<"):-1] + ",sequence_id:bigint,offset:bigint"

    def run(key: tuple, block: pa.Table) -> pa.Table:
        block = block.sort_by("_uid")                   # the same result when a task runs again
        bins, offsets = sum_of_squares(block.column("length").to_numpy(), size)
        ids = (key[0].as_py() << 32) + bins
        block = block.drop_columns(["_block"])
        return block.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    packed = (own.where(F.col("length") < size).withColumn("_block", F.pmod(F.xxhash64("_uid"), F.lit(n_blocks)))
              .groupBy("_block").applyInArrow(run, schema))
    full = own.where(F.col("length") >= size).withColumns(
        {"sequence_id": -1 - F.col("_uid"), "offset": F.lit(0).cast("long")})
    return packed.unionByName(full).drop("_uid")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the token sequences themselves, from pieces that kept their ids.

    Pieces whose ids are null add nothing; an empty table gives an empty one.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
