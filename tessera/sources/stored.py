"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's switch (4.1 and later) for deleting the shuffle files of a query when it ends.
_SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN: dict[str, str] = {}
_PATHS: dict[int, tuple[weakref.ref, str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); where it is unset, a temporary one on a local master and an error on a cluster."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if "path" not in _OWN:
        _OWN["path"] = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _OWN["path"], ignore_errors=True)
    return "file://" + _OWN["path"]


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks that read the table,
    not the work before it.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(table)] = (weakref.ref(table), path)
    return table


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that no plan needs any more."""
    for table in tables:
        known, path = _PATHS.pop(id(table), (None, ""))
        if known and known() is table:
            delete(table.sparkSession, path)


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of each written table are deleted when it is written; else they stay until the driver happens to collect its garbage, which one with much memory may never do."""
    before = spark.conf.get(_SHUFFLES_END, None)
    spark.conf.set(_SHUFFLES_END, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLES_END)
        else:
            spark.conf.set(_SHUFFLES_END, before)
