"""As-of and range joins against loops over small random rows, with ties and nulls."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from tessera.operators import temporal

START = datetime(2024, 1, 1)


def rows(seed, n):
    rng = random.Random(seed)
    return [(i, rng.choice([1, 2, None]), START + timedelta(seconds=rng.randrange(0, 300, 10))) for i in range(n)]


@pytest.mark.parametrize("seconds", [10, 35, 86_400])
def test_as_of(spark, seconds):
    left, right = rows(1, 60), rows(2, 40)
    right = list({(k, t): (i, k, t) for i, k, t in right}.values())
    a = spark.createDataFrame(left, "id int, k int, ts timestamp_ntz")
    b = spark.createDataFrame(right, "other int, k int, ts timestamp_ntz")
    got = {r["id"]: r["found"] for r in temporal.as_of(a, b, "k", "ts", "other", "found", seconds).collect()}
    for i, k, t in left:
        near = [(u, j) for j, q, u in right if k is not None and q == k and u <= t]
        assert got[i] == (max(near)[1] if near else None)


def test_within(spark):
    left, right = rows(3, 60), rows(4, 60)
    a = spark.createDataFrame(left, "id int, k int, ts timestamp_ntz")
    b = spark.createDataFrame(right, "other int, k int, at timestamp_ntz")
    got = sorted((r["id"], r["other"]) for r in temporal.within(a, b, "k", "ts", "at", 60).collect())
    want = sorted((i, j) for i, k, t in left for j, q, u in right if k is not None and q == k and t - timedelta(seconds=60) < u <= t)
    assert got == want and got


def test_late_rows_are_dropped(spark, tmp_path):
    """A row behind the watermark doesn't reach a window that is closed."""
    from pyspark.sql import functions as F

    for n, times in enumerate((["2024-01-01 01:00:00", "2024-01-01 03:00:00"], ["2024-01-01 00:20:00", "2024-01-01 05:00:00"], ["2024-01-01 08:00:00"])):
        spark.createDataFrame([(t,) for t in times], "t string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        source = spark.readStream.schema("t string").json(str(tmp_path / "in")).select(F.to_timestamp("t").alias("ts"))
        counts = source.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
        q = counts.select(F.col("w.start").alias("start"), "n").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r["start"].hour: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert 0 not in got and got[1] == 1 and got[3] == 1
