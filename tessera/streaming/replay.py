"""Out-of-order replay of events, with an account of what the watermark drops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import delete, new_path
from ..sources.tables import load

#: Arrivals are cut into so many slices of equal time, each of which a stream sees as one batch.
SLICES = 6
DELAY = "10 minutes"


def arrival(event_id: Column, at: Column) -> Column:
    """Microseconds at which an event arrives: one in five up to a day late, the others within a minute; by its id alone."""
    late = F.pmod(event_id * 7919, F.lit(100)) < 20
    return at + F.when(late, F.pmod(event_id * 104729, F.lit(86_400))).otherwise(F.pmod(event_id, F.lit(60))) * 1_000_000


def sliced(events: DataFrame, slices: int = SLICES) -> DataFrame:
    """events (event_id, ts) with ``slice``, the number of the time slice in which they arrive."""
    rows = events.withColumn("arrived", arrival(F.col("event_id"), F.unix_micros(F.col("ts").cast("timestamp"))))
    ends = rows.agg(F.min("arrived").alias("lo"), F.max("arrived").alias("hi")).first()
    if ends["lo"] is None:
        return rows.drop("arrived").withColumn("slice", F.lit(0))
    number = F.expr(f"int((arrived - {ends['lo']}) * {slices} div {ends['hi'] - ends['lo'] + 1})")
    return rows.withColumn("slice", number).drop("arrived")


def replayed(rows: DataFrame, slices: int = SLICES, delay: str = DELAY) -> tuple[DataFrame, int]:
    """(rows with ``on_time``, rows that Spark counted as dropped): rows (event_id, ts, slice and others) through a stream that takes one slice after the other.

    The stream only drops what is behind the watermark when a slice begins (``delay`` before the latest time of all slices before) and
    repeated event_ids. It stops after each slice and goes on from its checkpoint, as after a lost driver. Rows without a time can't be
    late. Each slice is appended to the input of the stream, so a slice may have any number of files.
    """
    spark = rows.sparkSession
    place = new_path(spark)
    dropped = 0
    kept = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    for k in range(slices):
        kept.where(F.col("slice") == k).write.mode("append").parquet(f"{place}/in")
        source = spark.readStream.schema(kept.schema).parquet(f"{place}/in").withWatermark("ts", delay)
        found = source.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "slice")
        query = found.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        dropped += sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
    delete(spark, f"{place}/state")
    on_time = spark.read.schema("event_id long, slice int").parquet(f"{place}/out").select(F.col("event_id").alias("_id"), F.col("slice").alias("_slice"))
    both = rows.join(on_time, (F.col("event_id") == F.col("_id")) & (F.col("slice") == F.col("_slice")), "left")
    return both.withColumn("on_time", F.col("_id").isNotNull()).drop("_id", "_slice"), dropped


def stream_late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Events that the watermark dropped."""
    rows, _ = replayed(sliced(load(spark, folder, "events").select("event_id", "ts")))
    return rows.where("not on_time").select("event_id", "slice")


def stream_late_account(spark: SparkSession, folder: str) -> DataFrame:
    """For each slice and day of the events' own time what came, what was on time and what was dropped."""
    rows, _ = replayed(sliced(load(spark, folder, "events").select("event_id", "ts")))
    counts = rows.groupBy("slice", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"))
    return counts.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("on_time").alias("n_on_time"), F.count_if(~F.col("on_time")).alias("n_dropped"))


QUERIES = {f.__name__: f for f in (stream_late_rows, stream_late_account)}

_ROWS = f"""arrivals AS (SELECT event_id, ts, epoch_us(ts) + CASE WHEN event_id * 7919 % 100 < 20 THEN event_id * 104729 % 86400 ELSE event_id % 60 END * 1000000 AS arrived FROM events),
slices AS (SELECT event_id, ts, CAST((arrived - (SELECT min(arrived) FROM arrivals)) * {SLICES} // ((SELECT max(arrived) - min(arrived) FROM arrivals) + 1) AS INTEGER) AS slice FROM arrivals),
marks AS (SELECT slice, max(epoch_us(max(ts)) // 1000 - 600000) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM slices GROUP BY slice),
judged AS (SELECT event_id, ts, s.slice, mark IS NULL OR epoch_us(ts) > mark * 1000 AS on_time FROM slices s JOIN marks m ON m.slice = s.slice)"""

SQL = {
    "stream_late_rows": f"WITH {_ROWS} SELECT event_id, slice FROM judged WHERE NOT on_time",
    "stream_late_account": f"WITH {_ROWS} SELECT slice, date_trunc('day', ts) AS day, count(*) AS n_rows, count(*) FILTER (on_time) AS n_on_time, count(*) FILTER (NOT on_time) AS n_dropped FROM judged GROUP BY ALL",
}
