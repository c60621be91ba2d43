"""Sketches that are kept by group and merged upward: distinct counts (HLL), quantiles (KLL) and heavy hitters.

All are Spark's own aggregates: tasks make partial sketches, and what is shuffled and kept is a few KB for each group, however
many rows it has. Merging kept sketches gives what one sketch over all rows would be good for, with the same bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: HLL of 2**LG_K registers: the relative error of a distinct count is 1.04 / sqrt(2**LG_K), times three with 99.7 %.
LG_K = 12
#: KLL: the error of a rank is below RANK_ERROR of the rows, with 99 %.
K, RANK_ERROR = 400, 0.009
#: Items that a heavy-hitter sketch tracks: an item's count is off by rows / TRACKED * 3 at most.
TRACKED = 1024

HLL_ERROR = 3 * 1.04 / 2 ** (LG_K / 2)


def kept(df: DataFrame, groups: list[Column], item: str, number: str, heavy: str) -> DataFrame:
    """A row for each group: n rows, distinct (HLL of ``item``), quantiles (KLL of ``number``, a double), top (heavy hitters of ``heavy``).

    Nulls are in no sketch. Groups are what is merged later, for example days.
    """
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.hll_sketch_agg(item, LG_K).alias("distinct"),
        F.kll_sketch_agg_double(number, K).alias("quantiles"),
        F.expr(f"approx_top_k_accumulate(`{heavy}`, {TRACKED})").alias("top"),
    )


def merged(sketches: DataFrame, groups: list[Column]) -> DataFrame:
    """Sketches of coarser groups from those of finer ones; partial merges run in the tasks that read them."""
    return sketches.groupBy(*groups).agg(
        F.sum("n").alias("n"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
        F.expr(f"approx_top_k_combine(top, {TRACKED})").alias("top"),
    )


def distinct_count(sketch: str = "distinct") -> Column:
    return F.hll_sketch_estimate(sketch)


def quantile(rank: float, sketch: str = "quantiles") -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(rank).cast("double"))


def heaviest(k: int, sketch: str = "top") -> Column:
    """array of (item, count), the most frequent first."""
    return F.expr(f"approx_top_k_estimate(`{sketch}`, {k})")
