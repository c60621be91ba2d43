"""Lookups with defaults, existence flags and set differences, as equi joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranks


def missing_keys(wanted: DataFrame, present: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of wanted whose key present doesn't have (a null key is never present)."""
    return wanted.join(present, on, "left_anti")


def set_difference(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """The distinct rows of wanted that present doesn't have; nulls are equal to each other."""
    return wanted.subtract(present)


def look_up(rows: DataFrame, table: DataFrame, on: str, value: str, default: str, out: str) -> DataFrame:
    """All rows with the value that the table has for their key as text, or the default.

    The table's keys must be unique; make them so first, else rows multiply.
    """
    found = table.select(on, F.col(value).cast("string").alias(out))
    return rows.join(found, on, "left").withColumn(out, F.coalesce(out, F.lit(default)))


def flag_presence(rows: DataFrame, table: DataFrame, on: str, out: str, yes: str = "ok", no: str = "missing") -> DataFrame:
    """All rows with a flag whether the table has their key, however often."""
    keys = table.select(on).distinct().withColumn(out, F.lit(yes))
    return rows.join(keys, on, "left").withColumn(out, F.coalesce(out, F.lit(no)))


def any_row(df: DataFrame) -> DataFrame:
    """One row: n_missing, 1 if df has any row, else 0. Each task looks at one row at most."""
    return df.select(F.lit(1).alias("one")).limit(1).agg(F.count("one").alias("n_missing"))


def append(parts: Sequence[tuple[str, DataFrame]], order: str, value: str) -> DataFrame:
    """(source, line_no, value) of several ordered tables; each is numbered by itself, from 1, by ranges of the order."""
    out = None
    for name, df in parts:
        numbered = ranks.numbered(df, [], [F.col(order).asc()], "line_no")
        listed = numbered.select(F.lit(name).alias("source"), "line_no", F.col(value).alias("value"))
        out = listed if out is None else out.unionByName(listed)
    return out


def tail(rows: DataFrame, group: str, order: str, value: str, count: int, separator: str, out: str) -> DataFrame:
    """For each group the last ``count`` values in order, joined.

    The rank filter is applied in the tasks that read the rows, before the shuffle,
    so a group sends ``count`` rows from each task at most.
    """
    from pyspark.sql import Window

    latest = Window.partitionBy(group).orderBy(F.col(order).desc())
    kept = rows.select(group, order, value).withColumn("_rank", F.row_number().over(latest)).where(F.col("_rank") <= count)
    listed = F.array_sort(F.collect_list(F.struct(order, value)))
    return kept.groupBy(group).agg(F.array_join(F.transform(listed, lambda x: x[value]), separator).alias(out))
