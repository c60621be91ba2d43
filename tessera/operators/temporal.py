"""Joins on time: as-of and range, both as equi joins or windows on a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str, out: str, bucket_seconds: int = 86_400) -> DataFrame:
    """left with the value of the latest right row of its key at or before its time (null if none, or if left's key or time is null).

    Both sides are merged and sorted by (time, right first) within (key, time
    bucket), so a busy key is many small groups and no pair of rows is made. What a
    bucket takes over from those before it comes from one row for each (key,
    bucket). Of right rows at one time any may be taken.
    """
    columns = left.columns
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (bucket_seconds * 1_000_000))
    common = [F.col(key).alias("_key"), bucket(time).alias("_bucket"), F.col(time).alias("_time")]
    kind = right.schema[value].dataType
    a = left.select(F.struct(*columns).alias("row"), *common, F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_value"))
    b = right.where(F.col(time).isNotNull()).select(F.lit(None).cast(a.schema["row"].dataType).alias("row"), *common, F.lit(0).alias("_side"), F.col(value).alias("_value"))
    merged = a.unionByName(b)
    latest = merged.groupBy("_key", "_bucket").agg(F.max_by("_value", F.when(F.col("_side") == 0, F.col("_time"))).alias("_last"))
    earlier = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = latest.select(F.col("_key").alias("_of"), F.col("_bucket").alias("_at"), F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    inside = Window.partitionBy("_key", "_bucket").orderBy("_time", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = merged.withColumn("_found", F.last("_value", ignorenulls=True).over(inside)).where("_side = 1")
    same = (F.col("_key") == F.col("_of")) & (F.col("_bucket") == F.col("_at"))
    return found.join(carried, same, "left").select("row.*", F.when(F.col("_key").isNotNull(), F.coalesce("_found", "_carried")).alias(out))


def within(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, seconds: int) -> DataFrame:
    """Pairs of one key with right_time in (left_time - seconds, left_time].

    Times are cut into buckets of that length; a left row looks into two, so
    the join is on (key, bucket) and a busy key is spread over its buckets.
    """
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    length = F.lit(seconds * 1_000_000)
    bucket = F.floor(at(left_time) / length)
    a = left.withColumn("_bucket", F.explode(F.array(bucket - 1, bucket)))
    b = right.withColumn("_bucket", F.floor(at(right_time) / length))
    near = (F.col(right_time) <= F.col(left_time)) & (at(right_time) > at(left_time) - length)
    return a.join(b, [key, "_bucket"]).where(near).drop("_bucket")
