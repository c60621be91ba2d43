"""Products of matrices kept as tables of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import partials

#: Rows and columns of a block at most.
SIDE = 256
BLOCKS = "name string, i long, j long, n_rows int, n_columns int, values array<double>"


def row_blocks(rows: DataFrame, name: str, index: str, values: str, width: int, side: int = SIDE) -> DataFrame:
    """Blocks of the matrices whose rows are arrays of ``width`` numbers (float or double): one matrix for each ``name``, its rows numbered by ``index`` (any distinct whole numbers).

    Block (i, j) has the rows with index // side = i and the columns j * side and on. Rows of one block come together in one task, side of them at most
    if index is distinct; missing rows and nulls among the numbers count as 0, null rows are left out.
    """

    def cut(key: tuple, table: pa.Table) -> pa.Table:
        block = np.zeros((side, width))
        places = np.asarray(table.column("at"))
        filled = np.nan_to_num(np.array([[0.0 if x is None else x for x in v] for v in table.column("v").to_pylist()], dtype=np.float64).reshape(len(places), width))
        np.add.at(block, places, filled)
        parts = [block[:, lo : lo + side] for lo in range(0, width, side)]
        return pa.Table.from_pylist([{"name": key[0].as_py(), "i": key[1].as_py(), "j": j, "n_rows": side, "n_columns": p.shape[1], "values": p.ravel().tolist()} for j, p in enumerate(parts)], schema=pa.schema([("name", pa.string()), ("i", pa.int64()), ("j", pa.int64()), ("n_rows", pa.int32()), ("n_columns", pa.int32()), ("values", pa.list_(pa.float64()))]))

    keyed = rows.where(F.col(values).isNotNull() & F.col(index).isNotNull()).select(F.col(name).cast("string").alias("name"), F.floor(F.col(index) / side).alias("i"), F.pmod(F.col(index), F.lit(side)).cast("int").alias("at"), F.col(values).cast("array<double>").alias("v"))
    return keyed.groupBy("name", "i").applyInArrow(cut, BLOCKS)


def transposed(blocks: DataFrame) -> DataFrame:
    """The blocks of the transposed matrices."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, columns = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            values = [np.asarray(v.values).reshape(r, c).T.ravel() for v, r, c in zip(batch.column(5), rows, columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(1), batch.column(4), batch.column(3), pa.array([v.tolist() for v in values], pa.list_(pa.float64()))], names=batch.schema.names)

    return blocks.mapInArrow(turn, BLOCKS)


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Blocks of A B for each name that both have: blocks meet on the inner index, their products are added up as partial sums in the tasks and merged by (i, j).

    A block is at most SIDE x SIDE numbers; no matrix comes to the driver or to one task. Missing blocks count as 0.
    """
    left = a.select("name", "i", F.col("j").alias("k"), F.col("n_rows").alias("n"), F.col("n_columns").alias("m"), F.col("values").alias("x"))
    right = b.select(F.col("name").alias("of"), F.col("i").alias("inner"), "j", F.col("n_rows").alias("q"), F.col("n_columns").alias("p"), F.col("values").alias("y"))
    pairs = left.join(right, F.col("name").eqNullSafe(F.col("of")) & (F.col("k") == F.col("inner"))).select("name", "i", "j", "n", "m", "q", "p", "x", "y")

    def fold(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
        name, i, j, n, m, q, p = (batch.column(c).to_pylist() for c in range(7))
        for r in range(batch.num_rows):
            x, y = (np.asarray(batch.column(c)[r].values) for c in (7, 8))
            inner = min(m[r], q[r])  # the last block of one side may be filled up with zeros
            yield (name[r], i[r], j[r]), x.reshape(n[r], m[r])[:, :inner] @ y.reshape(q[r], p[r])[:inner]

    def finish(key: tuple, total: np.ndarray) -> dict:
        return {"name": key[0], "i": key[1], "j": key[2], "n_rows": total.shape[0], "n_columns": total.shape[1], "values": total.ravel().tolist()}

    return partials.aggregate(pairs, fold, lambda s, t: s + t, finish, BLOCKS)


def entries(blocks: DataFrame, side: int = SIDE) -> DataFrame:
    """(name, row, column, value) of the blocks."""
    cells = blocks.select("name", "i", "j", "n_columns", F.posexplode("values").alias("at", "value"))
    return cells.select("name", (F.col("i") * side + F.floor(F.col("at") / F.col("n_columns"))).alias("row"), (F.col("j") * side + F.pmod("at", "n_columns")).alias("column"), "value")
