"""The surveyed text and report steps over the given tables.

What a command would be is a document here: its label tells the exit code (no label: it wasn't started), and its text is
output or error output. The steps themselves are in functions.text and plans.reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources.stored import new_path
from ..sources.tables import load, read_tsv, write_tsv
from . import reports


def results(spark: SparkSession, folder: str) -> DataFrame:
    """(line, name, out, err, code) of each document: code 0 for quality 1, 1 or 2 (toxic) for quality 0, null without a label."""
    labels = load(spark, folder, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    failed = F.col("quality") == 0
    return load(spark, folder, "documents").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("line"),
        F.col("source").alias("name"),
        F.when(failed & (F.col("toxic") == 0), F.lit("")).otherwise(F.col("text")).alias("out"),
        F.col("text").alias("err"),
        F.when(failed, F.col("toxic") + 1).when(F.col("quality") == 1, F.lit(0)).alias("code"),
    )


def command_lines(spark: SparkSession, folder: str) -> DataFrame:
    """What each report says of a command: its first line or error, all its lines, the last five, its code."""
    said = text.either(F.col("out"), F.col("err"))
    return results(spark, folder).select(
        "line", text.outcome(F.col("out"), F.col("err"), F.col("code")).alias("first_or_error"), text.flat(F.col("out"), F.col("err")).alias("flat"), text.tail(said).alias("tail"), text.exit_text(F.col("code")).alias("status")
    )


def tool_report(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as tools, started by the conversation of their number: what its first turn says, as an error where no sixth turn follows."""
    turns = load(spark, folder, "conversations")
    long = turns.where("turn = 5").select("conv_id", F.lit(0).alias("code"))
    said = turns.where("turn = 0").join(long, "conv_id", "left").select(F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("program"), F.col("text").alias("out"), F.lit("").alias("err"), F.coalesce("code", F.lit(1)).alias("code"))
    argv = F.array(F.concat(F.lit("conv"), F.col("doc_id").cast("string")), F.lit("--version"))
    return reports.tool_report(load(spark, folder, "documents").select(F.col("doc_id").alias("line"), F.col("source").alias("name"), argv.alias("argv")), said)


def package_report(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as packages: a version for those not in debt, a module where their nation has a customer of means."""
    nations = load(spark, folder, "nation")
    suppliers = load(spark, folder, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    expected = suppliers.select(F.col("s_suppkey").alias("line"), F.col("s_name").alias("dist"), F.col("n_name").alias("module"))
    versions = suppliers.where("s_acctbal >= 0").select(F.col("s_name").alias("dist"), F.concat_ws(".", F.col("s_nationkey").cast("string"), F.col("n_regionkey").cast("string")).alias("version"))
    rich = load(spark, folder, "customer").where("c_acctbal > 9900").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return reports.package_report(expected, versions, rich.select(F.col("n_name").alias("module")))


def version_text(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as programs: one without a label has no path."""
    path = F.when(F.col("code").isNotNull(), F.col("name"))
    return results(spark, folder).select("line", text.version(path, F.col("code"), F.col("out"), F.col("err")).alias("version"))


def framework_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = results(spark, folder).where("code is not null").withColumnRenamed("line", "source_no")
    return reports.framework_lines(rows).withColumn("line_no", F.col("line_no").cast("long"))


def device_report(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as devices (present: with a supplier of means), documents as commands, events as libraries (an error doesn't load), labelled documents as frameworks."""
    nations = load(spark, folder, "nation")
    paths = nations.select(F.col("n_nationkey").alias("line"), F.col("n_name").alias("path"))
    present = load(spark, folder, "supplier").where("s_acctbal > 8000").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("path"))
    failed = F.col("event_type") == "error"
    code = F.when(~failed & (F.col("event_type") != "signup"), F.get_json_object("props", "$.k").cast("int"))
    codes = load(spark, folder, "events").select(F.col("event_id").alias("line"), F.col("event_type").alias("lib"), code.alias("code"), F.when(failed, F.col("props")).alias("error"))
    commands = results(spark, folder)
    return reports.device_report(paths, present, commands.select("line", "name", "code", "out", "err"), codes, commands.where("code is not null").withColumnRenamed("line", "source_no"))


def specifications(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as lines of two manifests, of which the second includes the first; every fifth is a comment, an include or blank."""
    brand, size = F.replace("p_brand", F.lit("#"), F.lit("-")), F.col("p_size").cast("string")
    kind = F.col("p_partkey") % 5
    spec = (
        F.when(kind == 0, F.when(F.col("p_partkey") % 15 == 0, F.lit("")).when(F.col("p_partkey") % 15 == 5, F.concat(F.lit("# "), F.col("p_name"))).otherwise(F.lit("-r requirements.txt")))
        .when(kind == 1, F.concat(brand, F.lit(">="), size))
        .when(kind == 2, F.concat(brand, F.lit("["), F.lower("p_type"), F.lit("]=="), size, F.lit(".1")))
        .when(kind == 3, brand)
        .otherwise(F.concat(brand, F.lit("="), size))
    )
    lines = load(spark, folder, "part").select("p_size", spec.alias("spec"))
    core = lines.where("p_size <= 25")
    both = core.select(F.lit("core").alias("group"), "spec").unionByName(lines.select(F.lit("ml").alias("group"), "spec"))
    return reports.specifications(both)


def path_text(spark: SparkSession, folder: str) -> DataFrame:
    """The folders of each page's address before an old path, which is null, empty or the address."""
    old = F.when(F.col("page_id") % 3 == 0, F.lit(None)).when(F.col("page_id") % 3 == 1, F.lit("")).otherwise(F.col("url"))
    parts = F.filter(F.split(F.regexp_extract("url", "^[a-z]+://[^/?#]*/?([^?#]*)", 1), "/"), lambda x: x != "")
    return load(spark, folder, "pages").select(F.col("page_id").alias("line"), text.search_path(parts, old).alias("path"))


def tsv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The package report as tab-separated text in the shared folder, read back."""
    path = new_path(spark)
    write_tsv(package_report(spark, folder), path)
    return read_tsv(spark, path, "line bigint, python_package string, distribution_version string, module_status string")


def status_record(spark: SparkSession, folder: str) -> DataFrame:
    """One record for each kind of event: a constant service and status, and the latest instant as text."""
    latest = load(spark, folder, "events").groupBy(F.col("event_type").alias("service")).agg(F.max("ts").alias("at"))
    return latest.select("service", F.lit("ok").alias("status"), text.instant(F.col("at")).alias("timestamp"))


def document_report(spark: SparkSession, folder: str) -> DataFrame:
    """The line-oriented steps over whole documents, every fifth of which counts as failed."""
    docs = load(spark, folder, "documents").select("doc_id", F.col("text").alias("out"), F.lit("no text").alias("err"), (F.col("doc_id") % 5 == 0).cast("int").alias("code"))
    return docs.select("doc_id", text.outcome(F.col("out"), F.col("err"), F.col("code")).alias("said"), text.flat(F.col("out"), F.col("err")).alias("flat"), text.tail(F.col("out")).alias("tail"))


QUERIES = {f.__name__: f for f in (command_lines, tool_report, package_report, version_text, framework_lines, device_report, specifications, path_text, tsv_round_trip, status_record, document_report)}

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_SAID = "CASE WHEN out = '' THEN err ELSE out END"
_LINES = f"CASE WHEN {_STRIP.format(_SAID)} = '' THEN [] ELSE string_split({_STRIP.format(_SAID)}, chr(10)) END"
_OUTCOME = f"CASE WHEN code <> 0 THEN 'error: ' || array_to_string({_LINES}, ' ') ELSE coalesce(({_LINES})[1], 'ok') END"
_FLAT = f"coalesce(nullif(replace({_STRIP.format(_SAID)}, chr(10), ' | '), ''), 'ok')"
_LAST = "array_to_string(({})[-5:], ' | ')"
_EXIT = "CASE WHEN code IS NULL THEN 'missing' ELSE 'exit=' || CAST(code AS VARCHAR) END"
_KNOWN = """results AS (SELECT d.doc_id AS line, source AS name, CASE WHEN quality = 0 AND toxic = 0 THEN '' ELSE text END AS out, text AS err, CASE WHEN quality = 0 THEN toxic + 1 WHEN quality = 1 THEN 0 END AS code
    FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id)"""
_ERR_LINES = f"CASE WHEN {_STRIP.format('err')} = '' THEN [] ELSE string_split({_STRIP.format('err')}, chr(10)) END"
_FRAMEWORK = rf"""SELECT line AS source_no, row_number() OVER (PARTITION BY line ORDER BY part, place) - 1 AS line_no, said AS line FROM (
    SELECT line, 1 AS part, unnest(range(1, len(string_split(out, chr(10))) + 1)) AS place, unnest(string_split(out, chr(10))) AS said FROM results WHERE code IS NOT NULL
    UNION ALL SELECT line, 2, 1, name || chr(9) || 'error: exit=' || CAST(code AS VARCHAR) || '; ' || {_LAST.format(_ERR_LINES)} FROM results WHERE code <> 0)
    WHERE part = 2 OR regexp_matches(said, '\S')"""
_PACKAGES = """SELECT CAST(s_suppkey AS BIGINT) AS line, s_name AS python_package, CASE WHEN s_acctbal >= 0 THEN s_nationkey || '.' || n_regionkey ELSE 'missing' END AS distribution_version,
    CASE WHEN n_name IN (SELECT n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 9900) THEN 'ok' ELSE 'missing' END AS module_status FROM supplier JOIN nation ON n_nationkey = s_nationkey"""

SQL = {
    "command_lines": f"WITH {_KNOWN} SELECT line, {_OUTCOME} AS first_or_error, {_FLAT} AS flat, {_LAST.format(_LINES)} AS tail, {_EXIT} AS status FROM results",
    "tool_report": f"""WITH results AS (SELECT f.conv_id, f.text AS out, '' AS err, CASE WHEN f.conv_id IN (SELECT conv_id FROM conversations WHERE turn = 5) THEN 0 ELSE 1 END AS code FROM conversations f WHERE turn = 0)
    SELECT doc_id AS line, source AS dev_tool, CASE WHEN code IS NULL THEN 'missing' ELSE {_OUTCOME} END AS status FROM documents LEFT JOIN results ON conv_id = doc_id""",
    "package_report": _PACKAGES,
    "tsv_round_trip": _PACKAGES,
    "version_text": f"WITH {_KNOWN} SELECT line, CASE WHEN code IS NULL THEN 'missing' WHEN code <> 0 THEN 'error: ' || {_STRIP.format('err')} ELSE {_STRIP.format('out')} END AS version FROM results",
    "framework_lines": f"WITH {_KNOWN} {_FRAMEWORK}",
    "device_report": f"""WITH {_KNOWN}, framework AS ({_FRAMEWORK}), codes AS (SELECT event_id, event_type, CASE WHEN event_type NOT IN ('error', 'signup') THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS code, props FROM events)
    SELECT 1 AS section_no, CAST(n_nationkey AS BIGINT) AS line_no, n_name || chr(9) || CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000) THEN 'present' ELSE 'missing' END AS line FROM nation
    UNION ALL SELECT 2, line, name || chr(9) || {_EXIT} || chr(9) || CASE WHEN code IS NULL THEN 'missing' ELSE {_FLAT} END FROM results
    UNION ALL SELECT 3, event_id, event_type || chr(9) || CASE WHEN event_type = 'error' THEN 'error: ' || props WHEN code IS NULL THEN 'missing' ELSE 'loaded; cuInit=' || CAST(code AS VARCHAR) || ' (' || CASE code WHEN 0 THEN 'CUDA_SUCCESS' WHEN 100 THEN 'CUDA_ERROR_NO_DEVICE' WHEN 35 THEN 'CUDA_ERROR_INSUFFICIENT_DRIVER' WHEN 804 THEN 'CUDA_ERROR_FORWARD_COMPATIBILITY_NOT_SUPPORTED' ELSE 'UNKNOWN' END || ')' END FROM codes
    UNION ALL SELECT 4, source_no * 1000000 + line_no, line FROM framework""",
    "specifications": r"""WITH lines AS (SELECT p_size, CASE WHEN p_partkey % 15 = 0 THEN '' WHEN p_partkey % 15 = 5 THEN '# ' || p_name WHEN p_partkey % 5 = 0 THEN '-r requirements.txt' WHEN p_partkey % 5 = 1 THEN replace(p_brand, '#', '-') || '>=' || p_size
        WHEN p_partkey % 5 = 2 THEN replace(p_brand, '#', '-') || '[' || lower(p_type) || ']==' || p_size || '.1' WHEN p_partkey % 5 = 3 THEN replace(p_brand, '#', '-') ELSE replace(p_brand, '#', '-') || '=' || p_size END AS spec FROM part),
    groups AS (SELECT 'core' AS grp, spec FROM lines WHERE p_size <= 25 UNION ALL SELECT 'ml', spec FROM lines)
    SELECT grp AS "group", regexp_extract(spec, '^([A-Za-z0-9._-]+)', 1) AS package, nullif(regexp_extract(spec, '\[([^\]]*)\]', 1), '') AS extra, nullif(regexp_extract(spec, '(>=|==|<=|~=|!=|<|>|=)', 1), '') AS op, nullif(regexp_extract(spec, '[=<>]([0-9.]+)$', 1), '') AS version FROM groups WHERE spec <> '' AND spec NOT LIKE '#%' AND spec NOT LIKE '-r%'""",
    "path_text": r"""WITH cut AS (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1), '/'), lambda x: x <> '') AS parts, CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE url END AS old FROM pages)
    SELECT page_id AS line, CASE WHEN len(parts) > 0 THEN array_to_string(parts, ':') || ':' || coalesce(old, '') ELSE old END AS path FROM cut""",
    "status_record": "SELECT event_type AS service, 'ok' AS status, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp FROM events GROUP BY event_type",
    "document_report": f"WITH results AS (SELECT doc_id, text AS out, 'no text' AS err, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS code FROM documents) SELECT doc_id, {_OUTCOME} AS said, {_FLAT} AS flat, {_LAST.format('string_split(' + _STRIP.format('out') + ', chr(10))')} AS tail FROM results",
}
