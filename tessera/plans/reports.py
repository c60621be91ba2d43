"""Toolchain reports from tables of what was found: packages, tools, devices.

The tables come from wherever the facts are collected; starting programs is not
Spark's work. Rows keep the order of ``line`` columns, missing facts become the text
``missing`` in the last projection only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import lookup

#: The names of library codes.
CODES = {0: "CUDA_SUCCESS", 100: "CUDA_ERROR_NO_DEVICE", 35: "CUDA_ERROR_INSUFFICIENT_DRIVER", 804: "CUDA_ERROR_FORWARD_COMPATIBILITY_NOT_SUPPORTED"}


def package_report(expected: DataFrame, versions: DataFrame, modules: DataFrame) -> DataFrame:
    """expected (line, dist, module), versions (dist, version), modules (module) -> line, python_package, distribution_version, module_status.

    Version and status come from different lookups and may disagree. Of several versions the least counts.
    """
    found = lookup.look_up(expected, versions.groupBy("dist").agg(F.min("version").alias("version")), "dist", "version", text.MISSING, "distribution_version")
    found = lookup.flag_presence(found, modules, "module", "module_status")
    return found.select("line", F.col("dist").alias("python_package"), "distribution_version", "module_status")


def tool_report(expected: DataFrame, results: DataFrame) -> DataFrame:
    """expected (line, name, argv), results (program, out, err, code) -> line, dev_tool, status; a program without a result is missing, of several results the least counts."""
    one = results.groupBy("program").agg(F.min(F.struct("code", "out", "err")).alias("r")).select("program", "r.*")
    rows = expected.withColumn("program", F.get("argv", F.lit(0))).join(one, "program", "left")
    status = F.when(F.col("code").isNull(), F.lit(text.MISSING)).otherwise(text.outcome(F.col("out"), F.col("err"), F.col("code")))
    return rows.select("line", F.col("name").alias("dev_tool"), status.alias("status"))


def framework_lines(results: DataFrame) -> DataFrame:
    """results (source_no, name, out, err, code) -> source_no, line_no, line: non-blank lines of output as they are, and a failure's last five error lines."""
    failed = F.concat(F.col("name"), F.lit("\terror: "), text.exit_text(F.col("code")), F.lit("; "), text.tail(F.col("err")))
    all_lines = F.concat(text.nonblank(F.col("out")), F.when(F.col("code") != 0, F.array(failed)).otherwise(F.array().cast("array<string>")))
    return results.select("source_no", F.posexplode(all_lines).alias("line_no", "line"))


def device_report(paths: DataFrame, present: DataFrame, commands: DataFrame, codes: DataFrame, results: DataFrame) -> DataFrame:
    """Four sections under each other: section_no, line_no, line.

    paths (line, path), present (path), commands (line, name, code, out, err), codes (line, lib, code, error: why
    the library couldn't be loaded), results as in framework_lines().
    """
    tab = lambda *c: F.concat_ws("\t", *c)
    devices = lookup.flag_presence(paths, present, "path", "status", "present", "missing").select(F.lit(1).alias("section_no"), F.col("line").alias("line_no"), tab("path", "status").alias("line"))
    said = F.when(F.col("code").isNull(), F.lit(text.MISSING)).otherwise(text.flat(F.col("out"), F.col("err")))
    tools = commands.select(F.lit(2).alias("section_no"), F.col("line").alias("line_no"), tab("name", text.exit_text(F.col("code")), said).alias("line"))
    loaded = F.concat(F.lit("loaded; cuInit="), F.col("code").cast("string"), F.lit(" ("), text.named_code(F.col("code"), CODES), F.lit(")"))
    status = F.coalesce(F.concat(F.lit("error: "), F.col("error")), loaded, F.lit(text.MISSING))
    libraries = codes.select(F.lit(3).alias("section_no"), F.col("line").alias("line_no"), tab("lib", status).alias("line"))
    frameworks = framework_lines(results).select(F.lit(4).alias("section_no"), (F.col("source_no") * 1000000 + F.col("line_no")).cast("long").alias("line_no"), "line")
    return devices.withColumn("line_no", F.col("line_no").cast("long")).unionByName(tools).unionByName(libraries).unionByName(frameworks)


def to_install(wanted: DataFrame, installed: DataFrame) -> DataFrame:
    """Wanted packages that aren't installed, each once."""
    return lookup.set_difference(wanted.select("package"), installed.select("package"))


def specifications(groups: DataFrame) -> DataFrame:
    """groups (group, spec) -> group, package, extra, op, version of each version specification; comments and blank lines are left out."""
    lines = groups.where(~text.strip(F.col("spec")).rlike(r"^(#.*|-r.*)?$"))
    return lines.select("group", text.requirement(F.col("spec")).alias("r")).select("group", "r.*")
