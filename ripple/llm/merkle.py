"""Merkle manifest of a dataset with inclusion proofs by pointer jumping.

Every row is a leaf: the SHA-256 of its fields, each as ``-`` if null, else
its UTF-8 byte count, ``:`` and its value.  The leaves of a group ascend by
id; two consecutive nodes at a time become the hash of their digests (hex
text, concatenated; a last single one is hashed alone) until one is left, the
group's subroot.  The subroots, ordered by group (null first, bytewise), give
the root in the same way.

A leaf's proof is the list of siblings on its way to the root.  Each node below
its root starts with a pointer to its parent and the segment of that one step
(the sibling and its side).  A self-join of nodes at the end of their pointers
doubles the distance and concatenates the segments; after r rounds a pointer
spans 2**r levels, so a tree of height h needs log2(h) rounds.  In round r only
the nodes on levels divisible by 2**r still move, and a leaf meets a node of
level 2**r, of which there are n / 2**(2**r): from the fourth round on the
joined side is tiny and Spark broadcasts it by its measured size.

How it runs on Spark: texts are read once, to hash them; everything after
carries 32-byte digests.  Places in a group come from range partitions, so a
group that holds most rows is spread; ``STEP`` levels are hashed at once from
blocks of 2**STEP neighbours, so the number of jobs grows with log(n) / STEP.
The tables between steps are stored in the shared folder.

Nulls in any field have their own encoding; null ids come first; a null group
is a group.  Empty and very long texts are hashed whole.  Rows equal in group,
id and all fields are leaves of their own (their order does not matter: the
digests are equal); rows equal in group and id only are ordered by digest.  An
empty table gives an empty manifest.  Other columns, whatever their names, are
left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripple.llm.common import positions, slices, stored

STEP = 8                        # levels hashed from one block of neighbours
ALONE, LEFT, RIGHT = b"\x00", b"\x01", b"\x02"      # where the sibling of a step stands


def digest(*digests: bytes) -> bytes:
    """The hash of the digests as concatenated hex text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def leaf_digest(*fields: Column) -> Column:
    """The leaf of a row, as 32 bytes; the fields in this order."""
    parts = []
    for f in fields:
        value = f.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(
            F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return (n - 1).bit_length()


def _block_levels(base: int):
    """Nodes of the levels base to base + STEP from rows (g, n, block, digests of level base)."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    names = ["g", "n", "level", "pos", "digest", "seg"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            out = []
            for g, n, block, own in zip(*(c.to_pylist() for c in batch.columns)):
                top = height(n)
                for level in range(base, min(base + STEP, top) + 1):
                    first = block << (STEP - (level - base))
                    moves = level < top and level < base + STEP
                    for i, d in enumerate(own):
                        seg = None
                        if moves:
                            other = own[i ^ 1] if (i ^ 1) < len(own) else b""
                            seg = (ALONE if not other else LEFT if i & 1 else RIGHT) + other
                        out.append((g, n, level, first + i, d, seg))
                    own = [digest(*own[i:i + 2]) for i in range(0, len(own), 2)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    return run


def tree(leaves: DataFrame, most: int, name: str) -> DataFrame:
    """``g, n, level, pos, digest, seg`` of all nodes above and including leaves(g, n, pos, digest).

    ``n`` counts the leaves of the node's tree and ``most`` is the largest of
    them; ``seg`` is the step to the parent, null for the root of a tree.
    """
    out, base, start = None, 0, leaves.select("g", "n", "pos", "digest")
    while True:
        blocks = (start.groupBy("g", "n", F.shiftright("pos", STEP).alias("block"))
                  .agg(F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("x"))
                  .select("g", "n", "block", F.col("x.digest").alias("own")))
        made = stored(blocks.mapInArrow(_block_levels(base), "g long, n long, level int, pos long, digest binary, seg binary"),
                      f"{name}-{base}")
        base += STEP
        # the last level of a step starts the next one, with a segment of its own
        ended = height(most) <= base
        own = made if ended else made.where((F.col("level") < base) | _is_root())
        out = own if out is None else out.unionByName(own)
        if ended:
            return out
        start = made.where((F.col("level") == base) & ~_is_root())


def _is_root() -> Column:
    """True on the level at which a tree of ``n`` leaves has one node."""
    return F.expr("shiftleft(1L, level) >= n")


def segments(nodes: DataFrame, most: int, name: str) -> DataFrame:
    """``g, pos, seg`` of the leaves of nodes(g, level, pos, seg): the whole way to the root, by pointer jumping."""
    cur = nodes.where("seg is not null").select("g", "level", "pos", (F.col("level") + 1).alias("reach"), "seg")
    leaves, upper = cur.where("level = 0"), stored(cur.where("level > 0"), f"{name}-upper-1")
    span = 1
    while span < height(most):
        leaves = _jump(leaves, upper.where(F.col("level") == span))
        span *= 2
        if span < height(most):
            moving = upper.where(F.pmod("level", F.lit(span)) == 0)
            upper = stored(_jump(moving, upper.where(F.pmod("level", F.lit(span)) == span // 2)), f"{name}-upper-{span}")
    return leaves.select("g", "pos", "seg")


def _jump(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """Nodes whose pointers go on to where the pointers of their ends lead; those at their root stay."""
    to = ends.select(F.col("g").alias("_g"), F.col("level").alias("_level"), F.col("pos").alias("_pos"),
                     F.col("reach").alias("_reach"), F.col("seg").alias("_seg"))
    at = F.expr("shiftright(pos, reach - level)")
    joined = nodes.withColumn("_at", at).join(
        to, (F.col("g") == F.col("_g")) & (F.col("reach") == F.col("_level")) & (F.col("_at") == F.col("_pos")), "left")
    return joined.select("g", "level", "pos", F.coalesce("_reach", "reach").alias("reach"),
                         F.concat("seg", F.coalesce("_seg", F.lit(b""))).alias("seg"))


def manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "lang",
             also: dict[str, Column] | None = None) -> DataFrame:
    """``id, leaf, subroot, root, proof`` and the columns of ``also``, one row for each row of ``docs``.

    ``fields`` are hashed in this order.  ``leaf``, ``subroot`` and ``root`` are
    32 bytes each; ``proof`` holds a byte for the side and, where there is one,
    the sibling's digest for each step from leaf to root.
    """
    extra = also or {}
    own = stored(docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"),
                             leaf_digest(*(F.col(f) for f in fields)).alias("leaf"),
                             *(c.alias(k) for k, c in extra.items())), "leaves")
    # the groups in their order: their places are the leaves of the tree on top
    groups = positions(stored(own.groupBy("group").agg(F.count(F.lit(1)).alias("n")), "groups"), [], ["group"], "ordered-groups")
    groups = stored(groups.select(F.col("group").alias("_group"), "n", F.col("pos").alias("g")), "group-places")
    n_groups, most = groups.agg(F.count(F.lit(1)), F.max("n")).first()
    if not n_groups:
        return own.select("id", "leaf", *(F.lit(b"").alias(c) for c in ("subroot", "root", "proof")), *extra)
    placed = own.join(groups, F.col("group").eqNullSafe(F.col("_group"))).drop("group", "_group")
    leaves = stored(positions(stored(placed, "placed"), ["g"], ["id", "leaf"], "ordered"), "places")
    nodes = tree(leaves.withColumn("digest", F.col("leaf")), most, "nodes")
    roots = nodes.where(_is_root()).select("g", F.col("digest").alias("subroot"))
    top = tree(stored(roots.select(F.lit(0).cast("long").alias("g"), F.lit(n_groups).cast("long").alias("n"),
                                   F.col("g").alias("pos"), F.col("subroot").alias("digest")), "subroots"), n_groups, "top")
    root = top.where(_is_root()).first()["digest"]
    above = segments(top, n_groups, "top").select(F.col("pos").alias("_g"), F.col("seg").alias("_above"))
    above = stored(roots.join(above, F.col("g") == F.col("_g"), "left").select(
        F.col("g").alias("_g"), "subroot", F.coalesce("_above", F.lit(b"")).alias("_above")), "above")
    below = segments(nodes, most, "nodes").select(F.col("g").alias("_h"), F.col("pos").alias("_pos"), "seg")
    out = (leaves.join(below, (F.col("g") == F.col("_h")) & (F.col("pos") == F.col("_pos")), "left")
           .join(above, F.col("g") == F.col("_g")))
    return out.select("id", "leaf", "subroot", F.lit(bytes(root)).alias("root"),
                      F.concat(F.coalesce("seg", F.lit(b"")), "_above").alias("proof"), *extra)


def steps(proof: bytes) -> list[tuple[bytes, bytes]]:
    """(side, sibling) of each step; the sibling is empty where a node was hashed alone."""
    out, at = [], 0
    while at < len(proof):
        side = proof[at:at + 1]
        end = at + (1 if side == ALONE else 33)
        out.append((side, proof[at + 1:end]))
        at = end
    return out


def fold(leaf: bytes, way: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and the steps of its proof give."""
    for side, other in way:
        leaf = digest(other, leaf) if side == LEFT else digest(leaf, other) if side == RIGHT else digest(leaf)
    return leaf


def folded(rows: DataFrame, leaf_col: str = "leaf", proof_col: str = "proof") -> DataFrame:
    """``rows`` with ``folded_root`` (from ``leaf_col`` and the proof) and ``proof_sha256`` (of the siblings), as hex.

    A null leaf or proof gives nulls.
    """
    at = [rows.columns.index(c) for c in (leaf_col, proof_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            roots, proofs = [], []
            for leaf, proof in zip(*(batch.column(i).to_pylist() for i in at)):
                way = steps(proof or b"")
                roots.append(None if leaf is None or proof is None else fold(leaf, way).hex())
                proofs.append(None if proof is None else digest(*(d for _, d in way)).hex())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string()), pa.array(proofs, pa.string())],
                                             names=[*batch.schema.names, "folded_root", "proof_sha256"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(run, kinds + ", folded_root string, proof_sha256 string")
