"""A training corpus from the documents table, stage by stage.

Each stage takes (spark, docs, sf_dir), docs being what the stage before it kept,
and returns a DataFrame that is written as Parquet before the next one reads it.
Further columns of docs go through all stages, whatever their names are; those of the same
name that the last stage adds replace them. Empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard, mixing, quality, sharding
from tessera.llm.common import free_name, set_aside, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling draws; the rest goes.

    Null and empty texts are neutral, rows that are alike stay or go together, very long texts are scored whole; without
    labels for any of docs everything stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, back = set_aside(docs, quality.COLUMNS)
    return back(quality.resample(rows, labels, keep_columns=True)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of sets of five-word shingles with a similarity of 0.8 or more: that of the least doc_id, a null one first.

    Null and empty texts have no shingles and all stay; of rows with equal doc_id and text one stays.
    """
    return jaccard.one_of_each(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no test item is found under tiles of five words or more, to 0.8 of its words.

    Null and empty texts match nothing and stay; rows that are alike stay or go together.
    """
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order in which the schedule mixes their sources.

    A null source is a source; rows that are alike in every column come in any order.
    """
    rows, back = set_aside(docs, mixing.COLUMNS)
    return back(mixing.mix_sources(rows).orderBy("mix_slot", "mix_seq")).select(*docs.columns)


def laid_out(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with two columns, and their names: the piece of the table that a row lies in, and its place there.

    Of a Parquet table the pieces are its files, in the order in which its writer numbered them; of other rows the partitions.
    """
    piece, place = free_name(docs, "_piece"), free_name(docs, "_place")
    # a query over files would pass on the places in those files, which aren't its own
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation" or not docs.inputFiles():
        rows = docs.withColumn(place, F.monotonically_increasing_id())
        return rows.withColumn(piece, F.shiftright(place, 33).cast("int")), [piece, place]
    rows = docs.withColumn(place, F.col("_metadata.row_index")).withColumn(piece, F.col("_metadata.file_name"))
    # part-00012-...-c000: the number of the task, and of the file of a task that wrote several
    number = F.coalesce(F.regexp_extract(piece, r"^part-(\d+)", 1).try_cast("int"), F.lit(0)) * 1000 + F.coalesce(F.regexp_extract(piece, r"-c(\d{1,3})\b", 1).try_cast("int"), F.lit(0))
    return rows.withColumn(piece, number), [piece, place]


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and their place in it; a shard's rows keep the order in which docs lie, which is that of the mix.

    A null doc_id is placed like any key, a null text counts as no bytes; rows that share a doc_id share their shard.
    The rows of a shard are numbered file by file, so neither a shard nor the table is one task.
    """
    rows, (piece, place) = laid_out(docs)
    return sharding.shard_documents(rows, bucket=F.col(piece), order=[F.col(piece), F.col(place)]).drop(piece, place)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mixing),
    ("sharding", shards),
]

#: No SQL for n-gram models, string tiling and Pfair schedules; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
