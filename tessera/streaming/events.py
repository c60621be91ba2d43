"""Event streams: watermarked windows, sessions, deduplication and an interval join of two streams.

Each query reads the files of the table as a stream, runs over what is there
(``availableNow``) and returns what was emitted. Windows that the watermark has not
closed are not emitted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import delete, new_path
from ..sources.tables import stream

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(df: DataFrame, rocksdb: bool = False) -> DataFrame:
    """Run the stream over all that is there, into a Parquet sink with a checkpoint, and return the sink's rows.

    The checkpoint is deleted then; the rows stay in the shared folder, as the result reads them. Custom state needs ``rocksdb``.
    """
    spark = df.sparkSession
    place = new_path(spark)
    before = spark.conf.get(_STORE, None)
    if rocksdb:
        spark.conf.set(_STORE, _ROCKSDB)
    try:
        query = df.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    finally:
        if rocksdb:
            spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)
    query.awaitTermination()
    delete(spark, f"{place}/state")
    return spark.read.schema(df.schema).parquet(f"{place}/rows")


def timed(spark: SparkSession, folder: str, delay: str) -> DataFrame:
    events = stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", delay)


def stream_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    counts = timed(spark, folder, "10 minutes").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return drained(counts.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n"))


def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    sessions = timed(spark, folder, "10 minutes").groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return drained(sessions.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n"))


def stream_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return drained(timed(spark, folder, "1 hour").select("event_id", "ts").dropDuplicatesWithinWatermark(["event_id"]).select("event_id"))


def stream_join(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases with the same user's clicks of the ten minutes before, both as streams."""
    buys = timed(spark, folder, "10 minutes").where("event_type = 'purchase'").select(F.col("user_id").alias("buyer"), F.col("event_id").alias("buy_id"), F.col("ts").alias("bought"))
    clicks = timed(spark, folder, "10 minutes").where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("clicked"))
    near = (F.col("buyer") == F.col("user_id")) & (F.col("clicked") <= F.col("bought")) & (F.col("clicked") >= F.col("bought") - F.expr("INTERVAL 10 MINUTES"))
    return drained(buys.join(clicks, near).select("buy_id", "click_id"))


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_sessions, stream_distinct, stream_join)}

SQL = {
    # what the last watermark, ten minutes behind the latest event, has closed
    "stream_tumbling": "SELECT date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
    "stream_sessions": "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
    "stream_distinct": "SELECT DISTINCT event_id FROM events",
    "stream_join": "SELECT b.event_id AS buy_id, c.event_id AS click_id FROM events b JOIN events c ON b.user_id = c.user_id AND c.ts <= b.ts AND c.ts >= b.ts - INTERVAL 10 MINUTE WHERE b.event_type = 'purchase' AND c.event_type = 'click'",
}
