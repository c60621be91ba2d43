"""Shared pieces: written intermediate tables and distributed numbering."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import discard, shared_folder, written

__all__ = ["discard", "free_name", "numbered", "restored", "set_aside", "shared_folder", "written"]


def restored(kind: type, state: dict) -> object:
    """An object of this package's class from its broadcast ``vars()``.

    Broadcast values are pickled by reference, so a class of this package would have to be on the executors' path; arrays, lists
    and dicts needn't. What the object keeps in its attributes stays for the next tasks of the worker.
    """
    made = object.__new__(kind)
    made.__dict__ = state
    return made


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet (compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def set_aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with its columns of these names renamed, and what gives them their names back and drops other columns of these names."""
    taken = {x.lower() for x in names}
    own = {c: free_name(df, "_own_" + c) for c in df.columns if c.lower() in taken}

    def back(other: DataFrame) -> DataFrame:
        kept = other.drop(*[c for c in other.columns if c.lower() in taken])
        return kept.withColumnsRenamed({v: k for k, v in own.items()})

    return df.withColumnsRenamed(own), back


def numbered(
    df: DataFrame, groups: list[str], bucket: Column, order: list[Column], out: str, buckets: int = 1024, few: bool = False
) -> DataFrame:
    """Add ``out``: numbers from 0 without gaps inside each group, without one task per group.

    Rows of a group are dealt into ``buckets`` by ``bucket`` (a value from 0 to
    buckets - 1) and numbered there; each bucket starts where the ones before it
    end. The table of starts has at most groups x buckets rows; it is broadcast if
    there are ``few`` groups. The order is (bucket, order).
    """
    b, n, start = free_name(df, "_bucket"), free_name(df, "_count"), free_name(df, "_start")
    of = {k: free_name(df, "_of_" + k) for k in [*groups, b]}
    df = df.withColumn(b, bucket.cast("int"))
    before = Window.partitionBy(*groups).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    keys = [*groups, b]
    starts = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias(n))
        .withColumn(start, F.coalesce(F.sum(n).over(before), F.lit(0)))
        .select(*[F.col(k).alias(of[k]) for k in keys], start)
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn(out, F.row_number().over(inside).cast("long") - 1)
    match = [rows[k].eqNullSafe(starts[of[k]]) for k in keys]
    return (
        rows.join(F.broadcast(starts) if few else starts, match)
        .withColumn(out, F.col(out) + F.col(start))
        .drop(b, start, *of.values())
    )
