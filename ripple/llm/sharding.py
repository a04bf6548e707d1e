"""Balanced shards of indivisible groups by Karmarkar-Karp differencing.

A partial partition is a list of k part sizes.  The two partial partitions
with the largest spread are combined again and again, the largest part of
one with the smallest part of the other, until one is left; unwinding the
combinations gives each group its part.

How it runs on Spark: groups are sums over their rows (partial sums before
the shuffle, so a group of any number of rows is cheap).  A group of at least
1/``PACKETS`` of all bytes is an item of its own, of which there are at most
``PACKETS``; lighter groups are summed by hash into as many *packets*.  So
one task differences at most ``2 * PACKETS`` items at any input size, heavy
groups meet the others first, and thousands of packets of different size
level the parts out.  Groups and packets are joined back to the rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripple.llm.common import partitions, stored, unsigned_crc32

PACKETS = 16_384
ROW_BYTES = 16


def karmarkar_karp(sizes: np.ndarray, k: int) -> np.ndarray:
    """The part (0 to k-1) of each item; equal spreads are taken in the order given."""
    n = len(sizes)
    if n == 0:
        return np.zeros(0, np.int64)
    heap = []
    for i, s in enumerate(sizes.tolist()):
        parts = np.zeros(k, np.int64)
        parts[0] = s
        heap.append((-s, i, parts))                      # parts in falling size; the spread is first minus last
    heapq.heapify(heap)
    combined = []                                        # (left node, right node, which right part meets each left part)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        total = x + y[::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        combined.append((a, b, order))
        heapq.heappush(heap, (-(int(total[0]) - int(total[-1])), n + len(combined) - 1, total))
    part = np.zeros(n, np.int64)
    maps = {heap[0][1]: np.arange(k)}
    for node in range(n + len(combined) - 1, n - 1, -1):
        a, b, order = combined[node - n]
        own = maps.pop(node)
        left = np.empty(k, np.int64)
        left[order] = own                                # position before sorting -> final part
        for child, to in ((a, left), (b, left[::-1])):
            if child < n:
                part[child] = to[0]                      # a lone item lies in its largest part
            else:
                maps[child] = to
    if n == 1:
        part[0] = maps[heap[0][1]][0]
    return part


def _differenced(packets: DataFrame, k: int) -> DataFrame:
    """``packet, shard`` of the (at most 2 * PACKETS) packets(packet, size), in one task."""
    def run(packets: pa.Table) -> pa.Table:
        packets = packets.sort_by([("size", "descending"), ("packet", "ascending")])
        part = karmarkar_karp(packets.column("size").to_numpy(), k)
        return pa.table({"packet": packets.column("packet"), "shard": pa.array(part, pa.int32())})

    return packets.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, "packet string, shard int")


def balance(groups: DataFrame, k: int) -> DataFrame:
    """``item, shard`` for groups(item string, size): sizes of the k shards as equal as differencing makes them."""
    total = groups.agg(F.sum("size")).first()[0] or 0
    light = F.concat(F.lit("#"), F.pmod(F.xxhash64("item"), F.lit(PACKETS)).cast("string"))
    groups = groups.select("item", "size", F.when(F.col("size") * PACKETS >= total, F.col("item")).otherwise(light)
                           .alias("packet"))
    packets = stored(groups.groupBy("packet").agg(F.sum("size").alias("size")), "packets")
    return groups.join(stored(_differenced(packets, k), "differenced"), "packet").select("item", "shard")


def shard(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``, one row for each input row; equal texts share a shard.

    Size: UTF-8 bytes of the text (null: none) plus 16.  Null texts are equal
    to each other and to nothing else; their CRC is null.  Slots count from 0
    in each shard without gaps; repeated rows get slots of their own.  Null
    ids are kept and sort first.  An empty table gives an empty one.  Other
    columns, whatever their names, are left out.
    """
    text = F.col(text_col).cast("string")
    rows = stored(docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        unsigned_crc32(text).alias("text_crc32"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("item")), "sized")
    groups = stored(rows.groupBy("item").agg(F.sum("size").alias("size")), "groups")
    placed = stored(rows.join(balance(groups, k), "item"), "placed")
    # slots: ranks inside (shard, bucket) plus the sizes of the buckets before
    n_buckets = partitions(docs.sparkSession)
    bucket = F.pmod(F.xxhash64("doc_id", "item"), F.lit(n_buckets))
    placed = placed.withColumn("bucket", bucket)
    before = (placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "item"))
    return (placed.withColumn("rank", rank).join(before.drop("n"), ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", "shard",
                    (F.col("before") + F.col("rank") - 1).cast("long").alias("slot")))
