"""Keyed lookups, set steps and line-oriented text over the given tables (the surveyed behaviour)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import lookup
from ..sources.tables import load

#: The report's cards.
CARDS = [("Python", "notebook, pandas, scikit-learn"), ("React", "Vite + JavaScript workspace"), ("Spring", "Java 21 + Spring Boot API"), ("R", "tidyverse, ggplot2, IRkernel")]
STATUS_NAMES = {"F": "FILLED", "O": "OPEN"}


def anti_missing_keys(spark: SparkSession, folder: str) -> DataFrame:
    return lookup.missing_keys(load(spark, folder, "documents"), load(spark, folder, "labels"), "doc_id").select("doc_id")


def set_difference(spark: SparkSession, folder: str) -> DataFrame:
    rich = load(spark, folder, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nationkey"))
    served = load(spark, folder, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nationkey"))
    return lookup.set_difference(rich, served)


def lookup_default(spark: SparkSession, folder: str) -> DataFrame:
    labels = load(spark, folder, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return lookup.look_up(load(spark, folder, "documents").select("doc_id"), labels, "doc_id", "quality", text.MISSING, "quality")


def exists_flag(spark: SparkSession, folder: str) -> DataFrame:
    return lookup.flag_presence(load(spark, folder, "documents").select("doc_id"), load(spark, folder, "labels"), "doc_id", "status")


def map_lookup_default(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "orders").select("o_orderkey", text.named_code(F.col("o_orderstatus"), STATUS_NAMES).alias("status"))


def format_code(spark: SparkSession, folder: str) -> DataFrame:
    counts = load(spark, folder, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("user_id", text.exit_text(F.col("n")).alias("status"))


def replace_text(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "events").select("event_id", F.replace("props", F.lit(":"), F.lit(" | ")).alias("props"))


def first_line(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "documents").select("doc_id", text.first_line(F.col("text")).alias("first_line"))


def nonblank_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with a blank line put after each line feed, so that there are blank lines to leave out."""
    spaced = F.replace("text", F.lit("\n"), F.lit("\n \t\n"))
    lines = load(spark, folder, "documents").select("doc_id", F.posexplode(text.nonblank(spaced)).alias("line_no", "line"))
    return lines.select("doc_id", (F.col("line_no") + 1).cast("long").alias("line_no"), "line")


def tail_join(spark: SparkSession, folder: str) -> DataFrame:
    return lookup.tail(load(spark, folder, "conversations"), "conv_id", "turn", "role", 5, " | ", "tail")


def append_ordered(spark: SparkSession, folder: str) -> DataFrame:
    region = load(spark, folder, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    nation = load(spark, folder, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return lookup.append([("region", region), ("nation", nation)], "k", "name")


def instant_text(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "events").select("event_id", text.instant(F.col("ts")).alias("at"))


def literal_projection(spark: SparkSession, folder: str) -> DataFrame:
    """The cards, each with the number of documents that name its label; the documents are read once for all cards."""
    cards = F.array(*[F.struct(F.lit(x).alias("label"), F.lit(y).alias("detail")) for x, y in CARDS])
    named = load(spark, folder, "documents").select(F.explode(cards).alias("card"), "text").groupBy("card.label", "card.detail")
    return named.agg(F.count_if(F.contains("text", F.col("card.label"))).alias("n_documents"))


def empty_guard(spark: SparkSession, folder: str) -> DataFrame:
    return lookup.any_row(anti_missing_keys(spark, folder))


def default_nullif(spark: SparkSession, folder: str) -> DataFrame:
    orders = load(spark, folder, "orders")
    return orders.select("o_orderkey", F.coalesce(F.nullif("o_orderstatus", F.lit("P")), "o_orderpriority").alias("status"))


def map_put_if_absent(spark: SparkSession, folder: str) -> DataFrame:
    props = text.put_if_absent(F.from_json("props", "map<string,string>"), "level", "2")
    return load(spark, folder, "events").select("event_id", props["k"].alias("k"), props["level"].alias("level"))


def two_lookups(spark: SparkSession, folder: str) -> DataFrame:
    """Two independent lookups for each row, on different keys, as a tab-separated report line."""
    lines = load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    parts = load(spark, folder, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    suppliers = load(spark, folder, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    found = lookup.look_up(lookup.look_up(lines, parts, "l_partkey", "p_brand", text.MISSING, "brand"), suppliers, "l_suppkey", "s_name", text.MISSING, "supplier")
    return found.select(F.concat_ws("\t", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), "brand", "supplier").alias("line"))


def append_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Two reports of different columns under each other; what one doesn't have is null there."""
    a = load(spark, folder, "nation").select(F.lit("nation").alias("section"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    b = load(spark, folder, "region").select(F.lit("region").alias("section"), F.col("r_name").alias("name"))
    return a.unionByName(b, allowMissingColumns=True)


def keep_present(spark: SparkSession, folder: str) -> DataFrame:
    """Only rows whose key exists elsewhere, each once."""
    return load(spark, folder, "documents").select("doc_id", "lang").join(load(spark, folder, "labels"), "doc_id", "left_semi")


QUERIES = {
    f.__name__: f
    for f in (
        anti_missing_keys, set_difference, lookup_default, exists_flag, map_lookup_default, format_code, replace_text, first_line, nonblank_lines,
        tail_join, append_ordered, instant_text, literal_projection, empty_guard, default_nullif, map_put_if_absent, two_lookups, append_reports, keep_present,
    )
}

SQL = {
    "anti_missing_keys": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "set_difference": "SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "lookup_default": "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'missing') AS quality FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id",
    "exists_flag": "SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) THEN 'ok' ELSE 'missing' END AS status FROM documents d",
    "map_lookup_default": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'FILLED' WHEN 'O' THEN 'OPEN' ELSE 'UNKNOWN' END AS status FROM orders",
    "format_code": "SELECT user_id, 'exit=' || CAST(count(*) AS VARCHAR) AS status FROM events GROUP BY user_id",
    "replace_text": "SELECT event_id, replace(props, ':', ' | ') AS props FROM events",
    "first_line": r"SELECT doc_id, CASE WHEN regexp_matches(text, '\S') THEN string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10))[1] ELSE 'ok' END AS first_line FROM documents",
    "nonblank_lines": r"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS place FROM documents) WHERE regexp_matches(line, '\S')",
    "tail_join": "SELECT conv_id, string_agg(role, ' | ' ORDER BY turn) AS tail FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 5 GROUP BY conv_id",
    "append_ordered": "SELECT 'region' AS source, row_number() OVER (ORDER BY r_regionkey) AS line_no, r_name AS value FROM region UNION ALL SELECT 'nation', row_number() OVER (ORDER BY n_nationkey), n_name FROM nation",
    "instant_text": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS at FROM events",
    "literal_projection": "SELECT label, detail, count(*) FILTER (contains(text, label)) AS n_documents FROM (VALUES ('Python', 'notebook, pandas, scikit-learn'), ('React', 'Vite + JavaScript workspace'), ('Spring', 'Java 21 + Spring Boot API'), ('R', 'tidyverse, ggplot2, IRkernel')) t(label, detail), documents GROUP BY label, detail",
    "empty_guard": "SELECT CAST(count(*) > 0 AS BIGINT) AS n_missing FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "default_nullif": "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), o_orderpriority) AS status FROM orders",
    "map_put_if_absent": "SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_extract_string(props, '$.level'), '2') AS level FROM events",
    "two_lookups": "SELECT concat_ws(chr(9), CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), coalesce(p_brand, 'missing'), coalesce(s_name, 'missing')) AS line FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = l_partkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_suppkey = l_suppkey",
    "append_reports": "SELECT 'nation' AS section, n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT 'region', r_name, NULL FROM region",
    "keep_present": "SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
}
