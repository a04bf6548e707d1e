"""Exact quantiles without one value map per group.

Spark's exact ``percentile`` merges a value -> count map per group in one
task, which does not fit a huge group of continuous values.  Here:

1. per group: the row count ``n`` and a quantile sketch
   (``percentile_approx``, rank error <= n / accuracy) evaluated below and
   above each wanted probability, at growing distances; ``n`` picks the least
   distance that is ``MARGIN`` sketch errors and ``RANKS`` ranks wide -> a value
   bracket sure to contain the wanted ranks;
2. per group: how many values lie below each bracket (a conditional count,
   map-side partial aggregate);
3. rows inside a bracket (at most ``32 n / accuracy + 24`` per quantile
   besides ties) are counted by value, so a value that holds a third of all
   rows is one row; a running sum of the counts in a window partitioned by
   ``(group, quantile)`` gives each value's ranks, and the values at the wanted
   ranks are picked.

``method='linear'`` reproduces ``percentile`` (interpolation between ranks
``floor`` / ``ceil`` of ``p (n - 1)``); ``method='upper'`` returns the value
at 0-based rank ``floor(p n)`` (``sorted[n // 2]`` for the median).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripple.operators.joins import checked_small

DEFAULT_ACCURACY = 100_000
MARGIN = 4.0          # bracket half-width, in units of the sketch's rank error
RANKS = 3             # and in ranks on top of that


def _join(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Null-safe equi-join of ``left`` with a per-group table ``right``
    (broadcast only when measured small)."""
    ren = {k: f"_rk_{i}" for i, k in enumerate(keys)}
    r = checked_small(right.withColumnsRenamed(ren))
    cond = [left[k].eqNullSafe(r[ren[k]]) for k in keys]
    return left.join(r, on=cond, how="inner").drop(*ren.values())


def _band(tagged: DataFrame, keys, k: int) -> DataFrame:
    """``keys, _i, n, _v, _c``: how often each value inside the bracket of quantile ``_i`` occurs."""
    idx = F.filter(F.sequence(F.lit(0), F.lit(k - 1)),
                   lambda i: (F.col("_v") >= F.col("_lo")[i]) & (F.col("_v") <= F.col("_hi")[i]))
    return tagged.select(*keys, "n", "_v", F.explode(idx).alias("_i")).groupBy(*keys, "_i", "n", "_v").agg(
        F.count(F.lit(1)).alias("_c"))


def exact_quantiles(df: DataFrame, value: str, probs, keys=(), method: str = "linear",
                    accuracy: int = DEFAULT_ACCURACY, prefix: str = "q") -> DataFrame:
    """One row per group: ``keys``, ``n`` and ``{prefix}0 .. {prefix}{k-1}``.
    """
    keys = list(keys)
    glob = not keys
    if glob:        # a constant group key
        df, keys = df.withColumn("_g", F.lit(0)), ["_g"]
    k = len(probs)
    widths = [1.25 * MARGIN / accuracy]
    while widths[-1] < 0.25:
        widths.append(4 * widths[-1])
    src = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    ps = [max(0.0, p - e) for e in widths for p in probs] + [min(1.0, p + e) for e in widths for p in probs]
    sketch = F.percentile_approx("_v", F.array(*[F.lit(x) for x in ps]), accuracy)
    stats = src.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), sketch.alias("_a"))
    least = F.lit(MARGIN / accuracy) + F.lit(float(RANKS)) / F.col("n")

    def bracket(i: int, side: int):
        """The sketch's value at the least width that does for ``n``; open-ended at p = 0 / 1 and beyond the widths."""
        open_end, out = F.lit(float("inf") if side else float("-inf")), None
        for j, e in enumerate(widths):
            at = side * len(widths) * k + j * k + i
            to = open_end if ps[at] in (0.0, 1.0) else F.col("_a")[at]
            out = F.when(least <= e, to) if out is None else out.when(least <= e, to)
        return out.otherwise(open_end)

    lo, hi = ([bracket(i, side) for i in range(k)] for side in (0, 1))
    stats = stats.select(*keys, "n", F.array(*lo).alias("_lo"), F.array(*hi).alias("_hi"))
    tagged = _join(src, stats, keys)
    below = tagged.groupBy(*keys).agg(*[F.count_if(F.col("_v") < F.col("_lo")[i]).alias(f"_b{i}")
                                        for i in range(k)])
    band = _band(tagged, keys, k)
    w = Window.partitionBy(*keys, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = band.withColumn("_end", F.sum("_c").over(w)).withColumn("_r", F.col("_end") - F.col("_c"))
    p = F.element_at(F.array(*[F.lit(float(x)) for x in probs]), F.col("_i") + 1)
    if method == "linear":
        pos = (F.col("n") - 1).cast("double") * p
        r_lo, r_hi = F.floor(pos), F.ceil(pos)
    elif method == "upper":
        pos = F.least(F.floor(p * F.col("n")), F.col("n") - 1).cast("double")
        r_lo = r_hi = pos
    else:
        raise ValueError(method)
    below_i = F.element_at(F.array(*[F.col(f"_b{i}") for i in range(k)]), F.col("_i") + 1)
    j = _join(ranked, below, keys)
    j = j.withColumns({
        "_pos": pos, "_rlo": r_lo.cast("long") - below_i, "_rhi": r_hi.cast("long") - below_i})
    holds = lambda r: (F.col("_r") <= F.col(r)) & (F.col(r) < F.col("_end"))
    picked = j.where(holds("_rlo") | holds("_rhi"))
    per = picked.groupBy(*keys, "_i", "n", "_pos").agg(
        F.max(F.when(holds("_rlo"), F.col("_v"))).alias("_vlo"),
        F.max(F.when(holds("_rhi"), F.col("_v"))).alias("_vhi"))
    lower, higher = F.floor("_pos"), F.ceil("_pos")
    # same arithmetic as Spark's exact percentile
    val = F.when((lower == higher) | (F.col("_vlo") == F.col("_vhi")), F.col("_vlo")).otherwise(
        (higher.cast("double") - F.col("_pos")) * F.col("_vlo")
        + (F.col("_pos") - lower.cast("double")) * F.col("_vhi"))
    per = per.withColumn("_q", val)
    if k == 1:
        out = per.select(*keys, "n", F.col("_q").alias(f"{prefix}0"))
    else:
        out = per.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(f"{prefix}{i}")
                                            for i in range(k)])
    # one row for the whole table is stored: who reads it does not run these steps again
    return checked_small(out.drop("_g")) if glob else out
