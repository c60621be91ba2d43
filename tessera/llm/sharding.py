"""Sharding by rendezvous hashing: every shard bids for a key, the highest bid wins.

A bid depends on the key and the shard alone, so another shard takes just the
rows for which it bids highest, and no row moves between old shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, numbered

SHARDS = 24
BUCKETS = 1024
#: Up to so many shards the starts of their buckets are broadcast where the order is given.
FEW_SHARDS = 256


def bid(key: Column, shard: int, weight: float) -> Column:
    """-weight / ln(u), u uniform in (0, 1) from the hash of (key, shard): the winner's chance is in proportion to its weight."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
    return F.lit(-float(weight)) / F.ln(u)


def winner(key: Column, weights: Sequence[float]) -> Column:
    """struct(bid, order) of the winning shard; equal bids go to the lower shard."""
    bids = [F.struct(bid(key, j, w).alias("bid"), F.lit(-j).alias("order")) for j, w in enumerate(weights) if w > 0]
    if not bids:
        raise ValueError("at least one shard needs a weight above 0")
    return F.array_max(F.array(*bids))


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], grown_weight: float | None = None) -> DataFrame:
    """Add ``shard`` and ``grown_shard`` (with one more shard of ``grown_weight``, by default the mean weight).

    A null key is a key of its own. Repeated keys share a shard. Existing
    columns named shard or grown_shard are replaced. Empty tables stay empty.
    """
    extra = sum(weights) / len(weights) if grown_weight is None else grown_weight
    win = free_name(df, "_win")
    old = F.col(win)
    df = df.withColumn(win, winner(F.col(key), weights))
    grown = F.when(bid(F.col(key), len(weights), extra) > old["bid"], F.lit(len(weights))).otherwise(-old["order"])
    return df.withColumn("shard", (-old["order"]).cast("int")).withColumn("grown_shard", grown.cast("int")).drop(win)


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, weights: Sequence[float] | None = None, bucket: Column | None = None, order: Sequence[Column] = ()
) -> DataFrame:
    """All documents with size, text_crc32, law, shard, slot and grown_shard added.

    slot numbers a shard's rows from 0 without gaps, in the order of a hash
    bucket, doc_id and the text's checksum, or of ``bucket`` (a value from 0 to
    BUCKETS - 1) and ``order``, where given. A null text counts as no bytes; a
    null doc_id is placed like any key; rows alike in every column share their
    shard and take slots in any order. Columns of these names are replaced.
    """
    placed = assign_shards(docs, "doc_id", weights or [1.0] * shards)
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = (
        placed.withColumn("size", F.octet_length(text).cast("long") + 8)
        .withColumn("text_crc32", F.crc32(F.encode(text, "UTF-8")))
        .withColumn("law", F.lit("key"))
    )
    few = bucket is not None and len(weights or range(shards)) <= FEW_SHARDS
    if bucket is None:
        # with the text, so that rows that share a doc_id (or have none) are spread over the buckets
        bucket, order = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text_crc32"), F.lit("slot")), F.lit(BUCKETS)), [F.col("doc_id"), F.col("text_crc32")]
    return numbered(placed, ["shard"], bucket, list(order), "slot", buckets=BUCKETS, few=few)
