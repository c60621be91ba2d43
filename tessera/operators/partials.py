"""Aggregate functions of one's own with partial aggregation, over Arrow batches.

Spark's grouped functions in Python bring all rows of a group to one task. Here a task folds the batches that it reads
into one state for each key it meets, sends the states, and these are merged in two steps: by (key, salt), so that a frequent key of a large table
isn't one task's work, and then by key. What is shuffled is states.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts that the states of a key are merged in first.
SALTS = 32
#: States that a task holds before it sends them.
HELD = 10_000

Fold = Callable[[pa.RecordBatch], Iterator[tuple[Any, Any]]]


def aggregate(df: DataFrame, fold: Fold, merge: Callable[[Any, Any], Any], finish: Callable[[Any, Any], dict], schema: str | T.StructType) -> DataFrame:
    """A row of ``schema`` for each key.

    fold(batch) gives (key, state) for what a batch holds, a key any number of times; merge(a, b) joins two states of a key, in
    any order and grouping; finish(key, state) makes the row. Keys are hashable and, like states, picklable; a state has to stay
    small however many rows it stands for. The result doesn't depend on the cut of the table if merge doesn't.
    """
    made = "salt int, hash long, key binary, state binary"

    def sent(held: dict) -> pa.RecordBatch:
        keys = [pickle.dumps(k) for k in held]
        hashes = [int.from_bytes(blake(k), "little", signed=True) for k in keys]
        salts = [int.from_bytes(blake(k + s), "little") % SALTS for k, s in zip(keys, map(pickle.dumps, held.values()), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(salts, pa.int32()), pa.array(hashes, pa.int64()), pa.array(keys, pa.binary()), pa.array([pickle.dumps(v) for v in held.values()], pa.binary())], names=["salt", "hash", "key", "state"])

    def blake(data: bytes) -> bytes:
        from hashlib import blake2b

        return blake2b(data, digest_size=8).digest()

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for key, state in fold(batch):
                held[key] = merge(held[key], state) if key in held else state
            if len(held) > HELD:
                yield sent(held)
                held = {}
        yield sent(held)

    def joined(batches: Iterator[pa.RecordBatch]) -> dict:
        held: dict = {}
        for batch in batches:
            for key, state in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                key, state = pickle.loads(key), pickle.loads(state)
                held[key] = merge(held[key], state) if key in held else state
        return held

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield sent(joined(batches))

    struct = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [finish(k, v) for k, v in joined(batches).items()]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(struct)
    states = df.mapInArrow(folded, made).repartition("hash", "salt").mapInArrow(merged, made)
    return states.repartition(F.col("hash")).mapInArrow(finished, struct)
