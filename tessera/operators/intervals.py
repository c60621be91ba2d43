"""Joins of intervals without an equality key.

The whole numbers are cut into dyadic pieces: level k has pieces of 2**k numbers. An
interval is a few pieces side by side (two of each level at most), and a number is in exactly one of them. So "the number
lies in the interval" is an equality of (level, piece), and two intervals overlap if the first begins in
the second, or the second begins in the first after its start: each overlap meets once, and no pair of rows is made that isn't one
of the result (up to the rounding to ``unit``). A piece in which very many numbers meet very many intervals is as large as its
share of the result; Spark's adaptive plan splits it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stored import written
from . import ranks

#: Levels in use at most: numbers are cells of ``unit`` from the least one on, below 2**LEVELS.
LEVELS = 40


def pieces(lo: Column, hi: Column) -> Column:
    """The dyadic pieces of the whole numbers lo to hi (0 or more, both included): array of (level, piece); none if hi < lo.

    At each level the interval gives off its first piece if that is the second of its pair, and its last if that is the first of
    its pair; what is left between goes on one level up.
    """
    start = F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), F.array().cast("array<struct<level:int,piece:bigint>>").alias("out"))

    def up(state: Column, level: Column) -> Column:
        first, last = state["lo"], state["hi"]
        none = F.array().cast("array<struct<level:int,piece:bigint>>")
        piece = lambda at: F.array(F.struct(level.cast("int").alias("level"), at.alias("piece")))
        left = (first <= last) & (first % 2 == 1)
        then = first + F.when(left, F.lit(1)).otherwise(F.lit(0))
        right = (then <= last) & (last % 2 == 0)
        # once it is empty it stays so: lo 1, hi 0 go up to 1, 0 again
        empty = (then > last) | (right & (then > last - 1))
        return F.struct(
            F.when(empty, F.lit(1)).otherwise(F.shiftright(then, 1)).cast("long").alias("lo"),
            F.when(empty, F.lit(0)).otherwise(F.shiftright(last - F.when(right, F.lit(1)).otherwise(F.lit(0)), 1)).cast("long").alias("hi"),
            F.concat(state["out"], F.when(left, piece(first)).otherwise(none), F.when(right, piece(last)).otherwise(none)).alias("out"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), start, up, lambda s: s["out"])


def _points_in(points: DataFrame, at: str, spans: DataFrame, lo: str, hi: str) -> DataFrame:
    """Rows of both where cell ``at`` lies in the cells lo to hi; the levels that spans use come to the driver (LEVELS at most)."""
    cut = spans.withColumn("_piece", F.explode(pieces(F.col(lo), F.col(hi))))
    levels = sorted(r[0] for r in cut.select("_piece.level").distinct().collect())
    if not levels:
        return points.join(spans, F.lit(False))
    of = F.explode(F.array(*[F.struct(F.lit(k).alias("_level"), F.shiftright(F.col(at), k).alias("_at")) for k in levels]))
    keyed = points.withColumn("_of", of).select(*points.columns, "_of._level", "_of._at")
    found = keyed.join(cut, (F.col("_level") == F.col("_piece.level")) & (F.col("_at") == F.col("_piece.piece")))
    return found.drop("_level", "_at", "_piece")


def overlaps(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], unit: int = 1) -> DataFrame:
    """Pairs of rows whose closed intervals (start, end), columns of whole numbers, have a number in common: structs ``l`` and ``r``.

    Intervals with a null end or with the end before the start overlap nothing. Repeated rows give a pair each. ``unit``
    is the width of a cell: about the usual length of an interval over a hundred keeps pieces few; the ends themselves are compared afterwards, so it
    doesn't change the result.
    """
    (a, b), (c, d) = left_span, right_span
    least = left.agg(F.min(a).alias("x")).unionByName(right.agg(F.min(c).alias("x"))).agg(F.min("x")).first()[0] or 0
    cell = lambda x: F.floor((F.col(x) - least) / unit).cast("long")
    l = left.where(F.col(a) <= F.col(b)).select(F.struct(*left.columns).alias("l"), cell(a).alias("l_lo"), cell(b).alias("l_hi"))
    r = right.where(F.col(c) <= F.col(d)).select(F.struct(*right.columns).alias("r"), cell(c).alias("r_lo"), cell(d).alias("r_hi"))
    # the left one begins inside the right one, or the right one begins inside the left one after its start
    first = _points_in(l, "l_lo", r, "r_lo", "r_hi").where((F.col("l")[a] >= F.col("r")[c]) & (F.col("l")[a] <= F.col("r")[d]))
    second = _points_in(r, "r_lo", l, "l_lo", "l_hi").where((F.col("r")[c] > F.col("l")[a]) & (F.col("r")[c] <= F.col("l")[b]))
    return first.select("l", "r").unionByName(second.select("l", "r"))


def overlap_counts(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], key: str, out: str) -> DataFrame:
    """(key, ``out``): with how many rows of right the interval of each row of left overlaps, without making the pairs.

    It is the number of intervals that begin up to its end less that of those that end before its start. Both are running counts over
    the distinct ends of all intervals, counted before anything is ordered, so a frequent end is one row; each row of left then looks its
    two ends up. key tells the rows of left apart. Intervals as in overlaps(); one that overlaps nothing counts 0.
    """
    (a, b), (c, d) = left_span, right_span
    own = left.where(F.col(a) <= F.col(b)).select(F.col(key).alias("key"), F.col(a).cast("long").alias("lo"), F.col(b).cast("long").alias("hi"))
    others = right.where(F.col(c) <= F.col(d)).select(F.col(c).cast("long").alias("lo"), F.col(d).cast("long").alias("hi"))

    def ends(spans: DataFrame, one: int) -> DataFrame:
        point = lambda at, begun, ended: F.struct(F.col(at).alias("at"), F.lit(begun).alias("begun"), F.lit(ended).alias("ended"))
        return spans.select(F.explode(F.array(point("lo", one, 0), point("hi", 0, one))).alias("p")).select("p.*")

    values = written(ends(own, 0).unionByName(ends(others, 1)).groupBy("at").agg(F.sum("begun").alias("begun"), F.sum("ended").alias("ended")))
    begun = ranks.running(values, [], [F.col("at")], "begun", "n").select(F.col("at").alias("hi"), F.col("n").alias("begun"))
    ended = ranks.running(values, [], [F.col("at")], "ended", "n").select(F.col("at").alias("lo"), (F.col("n") - F.col("ended")).alias("ended"))
    found = own.join(begun, "hi").join(ended, "lo").select("key", (F.col("begun") - F.col("ended")).alias("n"))
    none = left.where(~F.coalesce(F.col(a) <= F.col(b), F.lit(False))).select(F.col(key).alias("key"), F.lit(0).cast("long").alias("n"))
    return found.unionByName(none).select(F.col("key").alias(key), F.col("n").alias(out))
