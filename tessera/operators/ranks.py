"""Numbers, ranks and row frames over whole tables: no group of rows, and no tie, has to fit in one task.

Spark's own window functions bring a group to one task. Here rows are dealt by
ranges of the order over all groups; what a range must know of the others is a
row for each group and range: how many rows came before it, and the few rows
that a frame reaches over its ends.

Null is a group of its own; nulls in the order come where the order's columns put them. Rows equal in
groups and order come in any order, but each is numbered once: ranges are written before they are
read twice. Empty tables give empty ones. Columns of the table that are named like a new one are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.stored import written

#: Ranges that a table is cut into at least, whatever the session's number of shuffle partitions is.
RANGES = 8
#: Rows of a range, about, where the table has more than that number of ranges can hold.
ROWS = 500_000
_INDEX_BITS = 33


def _ranges(df: DataFrame, ranges: int | None) -> int:
    """In how many ranges the table is cut: as many as asked for, or else so many that none is much larger than ROWS."""
    return ranges or max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS))


def dealt(df: DataFrame, groups: list[str], order: list[Column], ranges: int | None = None) -> DataFrame:
    """(row, g0, g1 ..., part, index): the rows in order, dealt to ranges and written; index is the place in the range.

    The last key is a row's place among the partitions of df, so a tie of any size is cut too.
    """
    parts = _ranges(df, ranges)
    by = [*[F.col(g).asc_nulls_first() for g in groups], *order, F.col("__tie").asc()]
    sorted_ranges = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    names = [F.col(g).alias(f"g{i}") for i, g in enumerate(groups)]
    return written(sorted_ranges.select(F.struct(*df.columns).alias("row"), *names, F.spark_partition_id().alias("part"), index.alias("index")))


def _keys(groups: list[str]) -> list[str]:
    return [f"g{i}" for i in range(len(groups))]


def _apart(rows: DataFrame, ranges: int, part: str = "part") -> DataFrame:
    """Rows dealt by their range for a window inside it; a number given to repartition() is kept, while adaptive plans put small shuffles together by their packed size."""
    return rows.repartition(ranges, part)


def _joined(rows: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """rows with what spans say of their group and range."""
    of = spans.withColumnsRenamed({k: "of_" + k for k in [*keys, "part"]})
    same = rows["part"] == of["of_part"]
    for k in keys:
        same = same & rows[k].eqNullSafe(of["of_" + k])
    return rows.join(of, same)


def _unpacked(df: DataFrame, rows: DataFrame, new: dict[str, Column]) -> DataFrame:
    taken = {c.lower() for c in new}
    return rows.select(*[F.col("row")[c].alias(c) for c in df.columns if c.lower() not in taken], *[v.alias(k) for k, v in new.items()])


def numbered(df: DataFrame, groups: list[str], order: list[Column], out: str, total: str | None = None, ranges: int | None = None) -> DataFrame:
    """df with ``out``: 1, 2, 3 ... in this order inside each group; ``total``: the rows of the group."""
    rows, keys = dealt(df, groups, order, ranges), _keys(groups)
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy(*keys, "part").agg(F.min("index").alias("first"), F.count(F.lit(1)).alias("n"))
    spans = spans.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1)
    if total:
        spans = spans.withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    found = _joined(rows, spans.drop("n", "first"), keys)
    return _unpacked(df, found, {out: F.col("index") + F.col("start"), **({total: F.col("total")} if total else {})})


def running(df: DataFrame, groups: list[str], order: list[Column], value: str, out: str, ranges: int | None = None) -> DataFrame:
    """df with ``out``: the sum of a column over the rows of the group up to and with each row; null counts as nothing."""
    ranges = _ranges(df, ranges)
    rows, keys = dealt(df, groups, order, ranges), _keys(groups)
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy(*keys, "part").agg(F.sum(F.coalesce(F.col("row")[value], F.lit(0))).alias("n"))
    spans = spans.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy(*keys, "part").orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    summed = _apart(rows, ranges).withColumn("sum", F.sum(F.coalesce(F.col("row")[value], F.lit(0))).over(inside))
    return _unpacked(df, _joined(summed, spans, keys), {out: F.col("sum") + F.col("start")})


def tile(number: Column, total: Column, n: int) -> Column:
    """ntile(n) of the row ``number`` (from 1) of ``total``: the first total % n tiles have one row more."""
    small, larger = F.floor(total / n), total % n
    in_larger = larger * (small + 1)
    return F.when(number <= in_larger, F.ceil(number / (small + 1))).otherwise(larger + F.ceil((number - in_larger) / F.greatest(small, F.lit(1)))).cast("long")


def ranked(df: DataFrame, groups: list[str], by: str, descending: bool = False, ranges: int | None = None) -> DataFrame:
    """df with ``rank``, ``dense_rank``, ``percent_rank`` and ``cume_dist`` by one column inside each group.

    Ties share a rank, nulls too; nulls come first, or last if descending. Equal values are counted before anything is dealt, in the tasks that
    read them, so a frequent value is one row of the ranges; the join back to the rows
    has one row for each value on one side, and Spark's adaptive plan splits a frequent value on the other.
    """
    keys = _keys(groups)
    values = df.groupBy(*[F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)], F.col(by).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    order = F.col("value").desc_nulls_last() if descending else F.col("value").asc_nulls_first()
    ranges = _ranges(values, ranges)
    rows = dealt(values, keys, [order], ranges)
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*keys)
    spans = rows.groupBy(*keys, "part").agg(F.sum("row.n").alias("n"), F.count(F.lit(1)).alias("d"))
    spans = spans.select(*keys, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_start"), F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d_start"), F.sum("n").over(everything).alias("total"))
    inside = Window.partitionBy(*keys, "part").orderBy("index")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    found = _joined(_apart(rows, ranges).select(*keys, "part", F.col("row.value").alias("value"), F.col("row.n").alias("n"), F.sum("row.n").over(upto).alias("sum"), F.row_number().over(inside).alias("place")), spans, keys)
    least = F.col("n_start") + F.col("sum") - F.col("n")
    table = found.select(
        *[F.col(k).alias("of_" + k) for k in keys], F.col("value").alias("of_value"),
        (least + 1).alias("rank"), (F.col("d_start") + F.col("place")).alias("dense_rank"),
        F.when(F.col("total") > 1, least / (F.col("total") - 1)).otherwise(F.lit(0.0)).alias("percent_rank"), ((least + F.col("n")) / F.col("total")).alias("cume_dist"),
    )
    packed = df.select(F.struct(*df.columns).alias("row"), *[F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)], F.col(by).alias("value"))
    same = packed["value"].eqNullSafe(table["of_value"])
    for k in keys:
        same = same & packed[k].eqNullSafe(table["of_" + k])
    return _unpacked(df, packed.join(table, same), {c: F.col(c) for c in ("rank", "dense_rank", "percent_rank", "cume_dist")})


def framed(df: DataFrame, groups: list[str], order: list[Column], back: int, ahead: int, columns: Callable[[WindowSpec], dict[str, Column]], ranges: int | None = None) -> DataFrame:
    """df with the columns that ``columns(window)`` makes over row frames that reach at most ``back`` rows back and ``ahead`` rows ahead.

    Each range also sees, without keeping them, the rows of its groups that a frame reaches beyond its ends: taken from the
    nearest ranges that hold rows of the group, however few those are.
    """
    ranges = _ranges(df, ranges)
    rows, keys = dealt(df, groups, order, ranges), _keys(groups)
    seen = rows.select(*keys, "part", F.col("index").alias("place"), "row", F.lit(True).alias("own"))
    for reach, forward in ((back, False), (ahead, True)):
        if not reach:
            continue
        near = Window.partitionBy(*keys, "part").orderBy(F.col("index").asc() if forward else F.col("index").desc())
        ends = rows.withColumn("r", F.row_number().over(near)).where(F.col("r") <= reach)
        ends = ends.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct("index", "row"))).alias("end"))
        parts = Window.partitionBy(*keys).orderBy("part").rowsBetween(*((1, reach) if forward else (-reach, -1)))
        joined = ends.select(*keys, "part", F.flatten(F.collect_list("end").over(parts)).alias("near"))
        some = F.slice("near", 1, reach) if forward else F.slice("near", F.greatest(F.size("near") - reach, F.lit(0)) + 1, F.lit(reach))
        carried = joined.select(*keys, "part", F.posexplode(some).alias("at", "x"))
        place = F.col("at") + (1 << _INDEX_BITS) if forward else F.col("at").cast("long") - reach
        seen = seen.unionByName(carried.select(*keys, "part", place.alias("place"), F.col("x.row").alias("row"), F.lit(False).alias("own")))
    wide = seen.select(*[F.col(k).alias("__" + k) for k in keys], F.col("part").alias("__part"), F.col("place").alias("__place"), F.col("own").alias("__own"), "row.*")
    window = Window.partitionBy(*["__" + k for k in keys], "__part").orderBy("__place")
    new = columns(window)
    taken = {c.lower() for c in new}
    found = _apart(wide, ranges, "__part").select("__own", *[c for c in df.columns if c.lower() not in taken], *[v.alias(k) for k, v in new.items()])
    return found.where("__own").drop("__own")
