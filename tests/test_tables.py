"""Histories, bucketed tables, partial aggregates, block products and exchanges, with nulls, ties, repeats and empty tables."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import exchanges, matrices, partials
from tessera.sources import history

CHANGE = "k long, v int, a string, b int"


def states(changes):
    """(key, valid_from, valid_to, payload) by a loop over changes in order."""
    out = []
    for key in {c[0] for c in changes if None not in c[:2]}:
        mine = {}
        for k, v, *said in changes:
            if k == key and v is not None:
                rank = lambda s: [(x is not None, x) for x in s]
                mine[v] = max(mine.get(v, said), said, key=rank)
        news = []
        for v in sorted(mine):
            if not news or news[-1][1] != mine[v]:
                news.append((v, mine[v]))
        out += [(key, v, news[i + 1][0] if i + 1 < len(news) else None, *said) for i, (v, said) in enumerate(news)]
    return sorted(out, key=repr)


def test_history(spark, tmp_path):
    """Late versions, replays, payloads that say nothing new, nulls, two payloads of one version; only touched parts are rewritten."""
    rng = random.Random(3)
    changes = [(rng.choice([1, 2, 3, 4, None]), rng.choice([*range(12), None]), rng.choice(["x", "y", None]), rng.choice([1, None])) for _ in range(120)]
    path = f"file://{tmp_path}/history"
    got = None
    for some in (changes[:50], changes[50:], changes[20:70]):
        history.merge(spark, path, spark.createDataFrame(some, CHANGE), "k", "v", ["a", "b"])
        got = sorted((tuple(r) for r in history.read(spark, path).select("k", "valid_from", "valid_to", "a", "b").collect()), key=repr)
    assert got == states(changes) and len(got) > 20
    files = sorted(str(p) for p in (tmp_path / "history").rglob("*.parquet"))
    assert history.merge(spark, path, spark.createDataFrame([(77, 1, "z", 0)], CHANGE), "k", "v", ["a", "b"]) == 1
    assert set(files) <= {str(p) for p in (tmp_path / "history").rglob("*.parquet")}
    assert history.merge(spark, path, spark.createDataFrame([(None, 1, "z", 0)], CHANGE), "k", "v", ["a", "b"]) == 0
    at = {r.k: (r.a, r.b) for r in history.as_of(history.read(spark, path), 6).collect()}
    assert at == {k: (a, b) for k, since, until, a, b in [*states(changes), (77, 1, None, "z", 0)] if since <= 6 and (until is None or until > 6)}


def test_bucketed_tables_join_without_a_shuffle(spark):
    a = spark.range(500).select("id", (F.col("id") % 7).alias("x"))
    b = spark.range(0, 800, 2).select("id", (F.col("id") % 5).alias("y")).unionByName(spark.createDataFrame([(None, 1), (4, 9)], "id long, y long"))
    left, right = history.bucketed(a, ["id"], 6), history.bucketed(b, ["id"], 6)
    joined = left.hint("merge").join(right, "id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    sums = right.groupBy("id").agg(F.sum("y"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in sums
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, a.join(b, "id").collect()))
    # partition pruning at run time: the other side's filter reaches the scan
    assert history.bucketed(a.where("id < 0"), ["id"], 4).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_partial_aggregates(spark, parts, monkeypatch):
    monkeypatch.setattr(partials, "HELD", 3)
    rows = [(i % 5 if i % 11 else None, float(i * i % 97)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, x double").repartition(parts)

    def fold(batch: pa.RecordBatch):
        for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield k, (1, x, x)

    merge = lambda a, b: (a[0] + b[0], a[1] + b[1], max(a[2], b[2]))
    finish = lambda k, s: {"k": k, "n": s[0], "total": s[1], "most": s[2]}
    schema = "k int, n long, total double, most double"
    got = sorted(map(tuple, partials.aggregate(df, fold, merge, finish, schema).collect()), key=repr)
    keys = {k for k, _ in rows}
    assert got == sorted([(k, len(v := [x for q, x in rows if q == k]), sum(v), max(v)) for k in keys], key=repr)
    assert partials.aggregate(df.where("x < 0"), fold, merge, finish, schema).count() == 0


@pytest.mark.parametrize("side", [3, 256])
def test_products_of_blocks(spark, side):
    """Against numpy: two matrices by name, one without a partner, a null row, blocks filled up with zeros."""
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(10, 7)), rng.normal(size=(7, 4))
    table = lambda m, name: spark.createDataFrame([(name, i, r.tolist()) for i, r in enumerate(m)], "name string, id long, v array<double>")
    left = table(a, "m").unionByName(table(2 * a, "n")).unionByName(spark.createDataFrame([("m", 3, None)], "name string, id long, v array<double>"))
    left = matrices.row_blocks(left, "name", "id", "v", 7, side)
    right = matrices.row_blocks(table(b, "m").unionByName(table(b, "other")), "name", "id", "v", 4, side)

    def same(blocks, want):
        found = matrices.entries(blocks, side).collect()
        assert {r.name for r in found} == set(want)
        for name, m in want.items():
            cells = {(r.row, r.column): r.value for r in found if r.name == name}
            assert all(abs(cells.pop((i, j)) - m[i, j]) < 1e-9 for i in range(m.shape[0]) for j in range(m.shape[1]))
            assert all(x == 0 for x in cells.values())

    same(matrices.product(left, right), {"m": a @ b})
    same(matrices.transposed(left), {"m": a.T, "n": 2 * a.T})
    same(matrices.product(matrices.transposed(left), left), {"m": a.T @ a, "n": 4 * a.T @ a})
    assert matrices.product(left, right.where("name = 'none'")).count() == 0


def test_exchanges(spark):
    rows = [(1, 0, "assistant", "hi"), (1, 1, "user", "a?"), (1, 2, "assistant", "bbb"), (1, 3, None, "c"), (1, 4, "user", None), (2, 5, "user", "x"), (None, 1, "user", "yy"), (None, 2, "assistant", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = sorted(map(tuple, exchanges.exchanges(turns).collect()), key=repr)
    want = [(1, 0, 0, 1, 0, 2, "assistant"), (1, 1, 1, 3, 2, 4, None), (1, 2, 4, 1, 0, 0, "user"), (2, 1, 5, 1, 1, 0, "user"), (None, 1, 1, 2, 2, 1, "assistant")]
    assert got == sorted(want, key=repr)
    long = spark.range(20_000).select(F.lit(9).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 4000 == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit("ab").alias("text"))
    assert sorted(map(tuple, exchanges.exchanges(long).collect())) == [(9, k + 1, 4000 * k, 4000, 2, 7998, "assistant") for k in range(5)]
    assert exchanges.exchanges(turns.where("conv_id > 5")).count() == 0
