"""Ranks and running sums over a big group without one task per group.

``row_number() OVER (PARTITION BY k ORDER BY ...)`` and running sums put a
whole group into one task; a hot corridor-day can hold a large share of
all rows.  Both are computed here in two levels instead:

1. rows are grouped into *blocks* that follow the sort order (e.g. the
   local hour, or the risk level then the hour); per-block totals are a
   map-side partial aggregate, and an exclusive running sum over those few
   rows per group gives each block's offset;
2. a window partitioned by ``(group, block)`` ranks / sums inside a block.

The result equals the single-window form exactly; the biggest task holds
one block instead of one group.  The offsets are joined on ``(group,
block)`` — the same keys the in-block window partitions by — so the big side
is shuffled once and that shuffle also serves the window.  Group and block
keys must not be NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripple.operators.joins import checked_small


def _block_cols(df: DataFrame, blocks):
    """Materialise block expressions as columns ``_b0, _b1, ...``."""
    names = [f"_b{i}" for i in range(len(blocks))]
    return df.withColumns({n: b for n, (b, _) in zip(names, blocks)}), names


def blocked_rank(df: DataFrame, keys, blocks, order, out: str = "seq") -> DataFrame:
    """``row_number()`` over ``keys`` ordered by ``blocks`` then ``order``.

    ``blocks`` is a list of ``(column, ascending)``; the total order must be
    consistent with the block order.
    """
    d, names = _block_cols(df, blocks)
    d = checked_small(d)                     # read for the blocks and for the rows
    per = d.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_blk_n"))
    ordering = [F.col(n).asc() if asc else F.col(n).desc() for n, (_, asc) in zip(names, blocks)]
    w = Window.partitionBy(*keys).orderBy(*ordering).rowsBetween(Window.unboundedPreceding, -1)
    offs = per.withColumn("_off", F.coalesce(F.sum("_blk_n").over(w), F.lit(0))).drop("_blk_n")
    inner = Window.partitionBy(*keys, *names).orderBy(*order)
    out_df = d.join(offs, on=[*keys, *names], how="inner")
    return out_df.withColumn(out, (F.col("_off") + F.row_number().over(inner)).cast("long")) \
                 .drop("_off", *names)


def blocked_sum_before(df: DataFrame, keys, blocks, order, values) -> DataFrame:
    """For each value column ``v`` add ``_before_v`` = sum of ``v`` over the
    rows strictly before this one in the group's order."""
    d, names = _block_cols(df, blocks)
    d = checked_small(d)                     # read for the blocks and for the rows
    per = d.groupBy(*keys, *names).agg(*[F.sum(v).alias(f"_blk_{v}") for v in values])
    ordering = [F.col(n).asc() if asc else F.col(n).desc() for n, (_, asc) in zip(names, blocks)]
    w = Window.partitionBy(*keys).orderBy(*ordering).rowsBetween(Window.unboundedPreceding, -1)
    offs = per.withColumns({f"_off_{v}": F.coalesce(F.sum(f"_blk_{v}").over(w), F.lit(0)) for v in values}) \
              .drop(*[f"_blk_{v}" for v in values])
    inner = Window.partitionBy(*keys, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = d.join(offs, on=[*keys, *names], how="inner")
    out = out.withColumns({f"_before_{v}": F.col(f"_off_{v}") + F.coalesce(F.sum(v).over(inner), F.lit(0))
                           for v in values})
    return out.drop(*names, *[f"_off_{v}" for v in values])


def hour_block(ts: str = "start_local") -> list[tuple[Column, bool]]:
    return [(F.hour(F.col(ts)), True)]
