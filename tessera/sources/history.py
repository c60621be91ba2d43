"""Tables of changes with validity intervals, merged partition by partition, and tables laid out for joins without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranks
from .stored import discard, new_path, written

#: Parts of a history table, by a hash of the key; a merge rewrites those that its changes fall into.
PARTS = 64


def _intervals(changes: DataFrame, key: str, version: str, payload: list[str]) -> DataFrame:
    """All changes; those that say something new (_new) are valid up to the next such of their key."""
    order = [F.col(version).asc(), *[F.col(c).asc() for c in payload]]
    said = F.struct(*payload)

    def news(w):
        return {"_new": F.coalesce(~F.lag(said).over(w).eqNullSafe(said), F.lit(True)) | (F.lag(F.lit(1)).over(w).isNull())}

    # of changes with one key and version the greatest payload counts
    one = changes.groupBy("_part", key, version).agg(F.max(said).alias("_said")).select("_part", key, version, "_said.*")
    told = written(ranks.framed(one, [key], order, 1, 0, news))
    valid = ranks.framed(told.where("_new"), [key], order, 0, 1, lambda w: {"valid_to": F.lead(version).over(w)})
    return valid.unionByName(told.where("not _new"), allowMissingColumns=True).withColumnRenamed(version, "valid_from")


def merge(spark: SparkSession, path: str, changes: DataFrame, key: str, version: str, payload: list[str]) -> int:
    """Merge changes (key, version, payload) into the history at path; the number of parts that were rewritten.

    The table has the key, the payload, valid_from and valid_to (null: still valid); it keeps the changes that said nothing new too, since
    a late version may come to lie before one of them, and read() leaves them out. Only the parts of changed keys are read and
    written, by Spark's dynamic partition overwrite, so a merge that fails leaves the parts as they were. A change that is known already, or says what was
    valid anyway, changes nothing: replays are harmless, and late versions are put in between. Null keys and versions are left out; of two payloads of one key and version
    the greater holds. The same file system as path has to hold the intermediate tables.
    """
    part = F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int").alias("_part")
    new = changes.where(F.col(key).isNotNull() & F.col(version).isNotNull()).select(part, key, version, *payload)
    touched = sorted(r[0] for r in new.select("_part").distinct().collect())  # PARTS numbers at most
    if not touched:
        return 0
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        old = spark.read.parquet(path).where(F.col("_part").isin(touched))
        new = old.select("_part", key, F.col("valid_from").alias(version), *payload).unionByName(new)
    rows = written(_intervals(new, key, version, payload))
    laid = rows.select(key, *payload, "valid_from", "valid_to", "_new", "_part").repartition("_part").sortWithinPartitions("_part", key, "valid_from")
    laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(path)
    discard(rows)
    return len(touched)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The history: key, payload, valid_from, valid_to."""
    return spark.read.parquet(path).where("_new").drop("_new", "_part")


def as_of(history: DataFrame, version: object) -> DataFrame:
    """The rows that were valid at a version."""
    return history.where((F.col("valid_from") <= F.lit(version)) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(version))))


def bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """df as a table of so many buckets by keys, sorted in them, in the shared folder.

    Two such tables with the same number of buckets join on their keys without a shuffle, and with one file for each bucket without a sort. One key's rows
    are in one bucket: meant for keys of which none has a large share of the rows.
    """
    spark = df.sparkSession
    name = f"tessera_{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).sortWithinPartitions(*keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", new_path(spark)).saveAsTable(name)
    table = spark.table(name)
    return table
