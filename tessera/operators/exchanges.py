"""Conversations as exchanges: a partitioned Arrow table function that carries state along ordered rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranks

_OUT = "conv_id bigint, exchange bigint, first_turn bigint, n_turns bigint, asked_chars bigint, answered_chars bigint, last_role string"


@F.arrow_udtf(returnType=_OUT)
class Exchange:
    """One row for each partition of turns: counts are carried over its batches, in the order of the turns."""

    def __init__(self) -> None:
        self.first, self.last, self.n, self.asked, self.answered = None, None, 0, 0, 0

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        conv, exchange, turn, role, chars = (batch.column(c).to_pylist() for c in ("conv_id", "exchange", "turn", "role", "chars"))
        if self.first is None and conv:
            self.first = (conv[0], exchange[0], turn[0])
        for r, c in zip(role, chars, strict=True):
            self.n += 1
            self.last = r
            if r == "user":
                self.asked += c or 0
            else:
                self.answered += c or 0
        return iter([])

    def terminate(self) -> Iterator[pa.Table]:
        if self.first is not None:
            row = [*self.first, self.n, self.asked, self.answered, self.last]
            kinds = [pa.int64()] * 6 + [pa.string()]
            yield pa.table([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["conv_id", "exchange", "first_turn", "n_turns", "asked_chars", "answered_chars", "last_role"])


def exchanges(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) -> a row for each exchange: a user's turn and all that follow up to the next one.

    What comes before a conversation's first user turn is exchange 0. Null texts count 0 characters, a null role as an answer; a null conv_id is a
    conversation; turns of one number come in any order, so conversations with such may be cut in any of their ways. Exchanges are numbered by a running count that cuts a long
    conversation into ranges; the table function then sees one exchange at a time, however long the conversation is.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.char_length("text").cast("long").alias("chars"), F.when(F.col("role") == "user", F.lit(1)).otherwise(F.lit(0)).alias("asks"))
    numbered = ranks.running(rows, ["conv_id"], [F.col("turn").asc()], "asks", "exchange").drop("asks")
    return Exchange(numbered.asTable().partitionBy("conv_id", "exchange").orderBy("turn"))
