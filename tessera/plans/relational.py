"""A wider relational surface over the given tables (this project's own design)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ranks, temporal
from ..sources.tables import load


def pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    lines = load(spark, folder, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(price), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 4).alias("avg_discount"),
        F.count(F.lit(1)).alias("n"),
    )


def rollup_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = load(spark, folder, "orders")
    return orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))


def cube_customers(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "customer").cube("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def grouping_sets(spark: SparkSession, folder: str) -> DataFrame:
    events = load(spark, folder, "events")
    hour = F.hour("ts").alias("hour")
    return events.select("event_type", hour).groupingSets([[F.col("event_type")], [F.col("hour")]], "event_type", "hour").agg(F.count(F.lit(1)).alias("n"))


def pivot_status(spark: SparkSession, folder: str) -> DataFrame:
    orders = load(spark, folder, "orders")
    return orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))


def distinct_parts(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("n_parts"))


def approx_parts(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("n_parts"))


def order_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "lineitem").groupBy("l_linestatus").agg(
        F.round(F.percentile("l_quantity", F.lit(0.5)), 4).alias("median_quantity"),
        F.round(F.stddev_samp("l_quantity"), 4).alias("sd_quantity"),
        F.round(F.corr("l_quantity", "l_extendedprice"), 4).alias("correlation"),
    )


def nation_revenue(spark: SparkSession, folder: str) -> DataFrame:
    """Four tables joined; the small ones are broadcast by Spark where their size allows it."""
    joined = (
        load(spark, folder, "lineitem")
        .join(load(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(load(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(load(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def semi_join(spark: SparkSession, folder: str) -> DataFrame:
    big = load(spark, folder, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return load(spark, folder, "orders").join(big, "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus")


def anti_join(spark: SparkSession, folder: str) -> DataFrame:
    returned = load(spark, folder, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return load(spark, folder, "orders").join(returned, "o_orderkey", "left_anti").select("o_orderkey", "o_orderstatus")


def full_outer(spark: SparkSession, folder: str) -> DataFrame:
    a = load(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    b = load(spark, folder, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    return a.join(b, "nation", "full_outer")


def bag_intersect(spark: SparkSession, folder: str) -> DataFrame:
    a = load(spark, folder, "customer").select(F.col("c_nationkey").alias("nation"))
    b = load(spark, folder, "supplier").select(F.col("s_nationkey").alias("nation"))
    return a.intersectAll(b)


def bag_except(spark: SparkSession, folder: str) -> DataFrame:
    a = load(spark, folder, "customer").select(F.col("c_nationkey").alias("nation"))
    b = load(spark, folder, "supplier").select(F.col("s_nationkey").alias("nation"))
    return a.exceptAll(b)


def top_customers(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(20).select("c_custkey", "c_acctbal")


def top_orders_each(spark: SparkSession, folder: str) -> DataFrame:
    """The three dearest orders of each customer; the rank filter runs before the shuffle too."""
    latest = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    ranked = load(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(latest).cast("long").alias("place"))
    return ranked.where("place <= 3")


def window_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers, ranks, neighbours and quarters of the parts of each brand; a brand is cut by ranges of the order, so it isn't one task."""
    parts = load(spark, folder, "part").select("p_partkey", "p_brand", "p_size")
    order = [F.col("p_size").asc(), F.col("p_partkey").asc()]
    near = ranks.framed(parts, ["p_brand"], order, 1, 1, lambda w: {"before": F.lag("p_size").over(w), "after": F.lead("p_size").over(w)})
    placed = ranks.numbered(near, ["p_brand"], order, "place", "total")
    ranked = ranks.ranked(placed, ["p_brand"], "p_size")
    return ranked.select("p_partkey", "place", "rank", F.col("dense_rank").alias("dense"), "before", "after", ranks.tile(F.col("place"), F.col("total"), 4).alias("quarter"))


def moving_average(spark: SparkSession, folder: str) -> DataFrame:
    """Mean of an event's value and those of the user's two events before; a busy user's events are cut into ranges that see two rows of the one before."""
    events = load(spark, folder, "events").select("event_id", "user_id", "ts", "value")
    order = [F.col("ts").asc(), F.col("event_id").asc()]
    means = ranks.framed(events, ["user_id"], order, 2, 0, lambda w: {"average": F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 3)})
    return means.select("event_id", "average")


def hour_before(spark: SparkSession, folder: str) -> DataFrame:
    """Events of the same user in the hour up to each event.

    A user's time is cut in quarters of a day, so that a busy user isn't one group; the last hour of a quarter is
    also seen, but not counted for itself, in the next one.
    """
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    quarter = F.floor(seconds / 21600)
    last = F.when(seconds >= (quarter + 1) * 21600 - 3600, F.array(F.struct(quarter.alias("quarter"), F.lit(True).alias("own")), F.struct((quarter + 1).alias("quarter"), F.lit(False).alias("own"))))
    events = load(spark, folder, "events").select("event_id", "user_id", "ts", F.explode(F.coalesce(last, F.array(F.struct(quarter.alias("quarter"), F.lit(True).alias("own"))))).alias("part"))
    events.select("event_id", "user_id", "ts", "part.*").createOrReplaceTempView("_tessera_events")
    found = spark.sql("SELECT event_id, own, count(*) OVER (PARTITION BY user_id, quarter ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS n FROM _tessera_events")
    return found.where("own").drop("own")


def as_of_join(spark: SparkSession, folder: str) -> DataFrame:
    events = load(spark, folder, "events")
    buys = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return temporal.as_of(buys, views, "user_id", "ts", "view_id", "view_id").select("event_id", "view_id")


def range_join(spark: SparkSession, folder: str) -> DataFrame:
    events = load(spark, folder, "events")
    buys = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("buy_id"), F.col("ts").alias("bought"))
    clicks = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("clicked"))
    return temporal.within(buys, clicks, "user_id", "bought", "clicked", 7200).select("buy_id", "click_id")


def scalar_functions(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "events").select(
        "event_id",
        F.get_json_object("props", "$.k").alias("k"),
        F.regexp_extract("props", r"(\d+)", 1).alias("digits"),
        F.md5(F.col("event_type").cast("binary")).alias("md5"),
        F.levenshtein("event_type", F.lit("click")).cast("long").alias("distance"),
        F.upper("event_type").alias("upper"),
        F.year("ts").cast("long").alias("year"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"),
    )


def cosine_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine of each vector to the vector numbered one higher."""
    vectors = load(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = dot("v", "w") / F.sqrt(dot("v", "v") * dot("w", "w"))
    return vectors.join(after, "vec_id").select("vec_id", F.round(cosine, 4).alias("cosine"))


def tumbling_counts(spark: SparkSession, folder: str) -> DataFrame:
    events = load(spark, folder, "events")
    return events.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def sliding_counts(spark: SparkSession, folder: str) -> DataFrame:
    events = load(spark, folder, "events")
    return events.groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def user_sessions(spark: SparkSession, folder: str) -> DataFrame:
    events = load(spark, folder, "events")
    grouped = events.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def region_path(spark: SparkSession, folder: str) -> DataFrame:
    """A recursive query: numbers up to the greatest region key, with the region's name."""
    load(spark, folder, "region").createOrReplaceTempView("_tessera_region")
    return spark.sql(
        "WITH RECURSIVE last AS (SELECT max(r_regionkey) AS top FROM _tessera_region), n(k, top) AS (SELECT 0, top FROM last UNION ALL SELECT k + 1, top FROM n WHERE k < top) "
        "SELECT CAST(k AS INT) AS k, r_name FROM n JOIN _tessera_region ON r_regionkey = k"
    )


def lateral_top(spark: SparkSession, folder: str) -> DataFrame:
    load(spark, folder, "nation").createOrReplaceTempView("_tessera_nation")
    load(spark, folder, "supplier").createOrReplaceTempView("_tessera_supplier")
    return spark.sql(
        "SELECT n_name, s.s_suppkey FROM _tessera_nation, LATERAL (SELECT s_suppkey FROM _tessera_supplier WHERE s_nationkey = n_nationkey ORDER BY s_acctbal DESC, s_suppkey LIMIT 2) s"
    )


def scaled_prices(spark: SparkSession, folder: str) -> DataFrame:
    """A scalar pandas function, for what columns can't say; Arrow batches, not rows."""

    @F.pandas_udf("double")
    def clipped(price: pd.Series) -> pd.Series:
        return price.clip(lower=1000, upper=1500).round(2)

    return load(spark, folder, "part").select("p_partkey", clipped("p_retailprice").alias("price"))


def user_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The longest run of days in a row of each user (gaps and islands); days are made distinct first, in the tasks that read them."""
    days = load(spark, folder, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("day"))
    runs = days.select("user_id", F.date_sub("day", place).alias("run")).groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("user_id").agg(F.max("n").alias("longest_run"))


QUERIES = {
    f.__name__: f
    for f in (
        pricing_summary, rollup_orders, cube_customers, grouping_sets, pivot_status, distinct_parts, approx_parts, order_statistics, nation_revenue, semi_join, anti_join,
        full_outer, bag_intersect, bag_except, top_customers, top_orders_each, window_ranks, moving_average, hour_before, as_of_join, range_join, scalar_functions, cosine_pairs,
        tumbling_counts, sliding_counts, user_sessions, region_path, lateral_top, scaled_prices, user_spans,
    )
}

SQL = {
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 4) AS avg_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "rollup_orders": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping_id(o_orderstatus, o_orderpriority) AS level FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "cube_customers": "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY CUBE (c_nationkey, c_mktsegment)",
    "grouping_sets": "SELECT event_type, CAST(hour AS INTEGER) AS hour, count(*) AS n FROM (SELECT event_type, hour(ts) AS hour FROM events) GROUP BY GROUPING SETS ((event_type), (hour))",
    "pivot_status": 'SELECT o_orderpriority, nullif(count(*) FILTER (o_orderstatus = \'F\'), 0) AS "F", nullif(count(*) FILTER (o_orderstatus = \'O\'), 0) AS "O", nullif(count(*) FILTER (o_orderstatus = \'P\'), 0) AS "P" FROM orders GROUP BY 1',
    "distinct_parts": "SELECT l_returnflag, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY 1",
    "order_statistics": "SELECT l_linestatus, round(quantile_cont(l_quantity, 0.5), 4) AS median_quantity, round(stddev_samp(l_quantity), 4) AS sd_quantity, round(corr(l_quantity, l_extendedprice), 4) AS correlation FROM lineitem GROUP BY 1",
    "nation_revenue": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "semi_join": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)",
    "anti_join": "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')",
    "full_outer": "SELECT coalesce(a.nation, b.nation) AS nation, customers, suppliers FROM (SELECT c_nationkey AS nation, count(*) AS customers FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b ON a.nation = b.nation",
    "bag_intersect": "SELECT c_nationkey AS nation FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "bag_except": "SELECT c_nationkey AS nation FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "top_customers": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20",
    "top_orders_each": "SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3",
    "window_ranks": "SELECT p_partkey, row_number() OVER a AS place, rank() OVER b AS rank, dense_rank() OVER b AS dense, lag(p_size) OVER a AS before, lead(p_size) OVER a AS after, ntile(4) OVER a AS quarter FROM part WINDOW a AS (PARTITION BY p_brand ORDER BY p_size, p_partkey), b AS (PARTITION BY p_brand ORDER BY p_size)",
    "moving_average": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 3) AS average FROM events",
    "hour_before": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events",
    "as_of_join": "SELECT b.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') b ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON b.user_id = v.user_id AND b.ts >= v.ts",
    "range_join": "SELECT b.event_id AS buy_id, c.event_id AS click_id FROM events b JOIN events c ON b.user_id = c.user_id AND c.ts <= b.ts AND c.ts > b.ts - INTERVAL 2 HOUR WHERE b.event_type = 'purchase' AND c.event_type = 'click'",
    "scalar_functions": r"SELECT event_id, json_extract_string(props, '$.k') AS k, regexp_extract(props, '(\d+)', 1) AS digits, md5(event_type) AS md5, levenshtein(event_type, 'click') AS distance, upper(event_type) AS upper, year(ts) AS year, date_trunc('hour', ts) AS hour FROM events",
    "cosine_pairs": "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "tumbling_counts": "SELECT date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1",
    "sliding_counts": "SELECT start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1",
    "user_sessions": "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s",
    "region_path": "WITH RECURSIVE n(k) AS (SELECT 0 UNION ALL SELECT k + 1 FROM n WHERE k < (SELECT max(r_regionkey) FROM region)) SELECT k, r_name FROM n JOIN region ON r_regionkey = k",
    "lateral_top": "SELECT n_name, s_suppkey FROM (SELECT n_name, s_suppkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM nation JOIN supplier ON s_nationkey = n_nationkey) WHERE r <= 2",
    "scaled_prices": "SELECT p_partkey, round(greatest(1000, least(1500, p_retailprice)), 2) AS price FROM part",
    "user_spans": "SELECT user_id, max(n) AS longest_run FROM (SELECT user_id, count(*) AS n FROM (SELECT user_id, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS g FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events)) GROUP BY user_id, g) GROUP BY user_id",
}
