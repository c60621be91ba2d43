"""Numbers, ranks and frames against Spark's window functions, with ties, nulls, one frequent value and empty tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import ranks


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    data = [(i, rng.choice([None, 1, 2, 2, 2, 2]), rng.choice([None, 1, 1, 1, 1, 2, 3, 7]), rng.random()) for i in range(300)]
    return spark.createDataFrame(data, "id int, g int, v int, row double").repartition(3)


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


@pytest.mark.parametrize("groups", [["g"], []])
def test_numbers(table, groups):
    order = [F.col("v").asc(), F.col("id").desc()]
    got = ranks.numbered(table, groups, order, "n", "total", ranges=5)
    assert got.columns == ["id", "g", "v", "row", "n", "total"]
    window = Window.partitionBy(*groups)
    same(got.select("id", "n", "total"), table.select("id", F.row_number().over(window.orderBy(*order)), F.count(F.lit(1)).over(window)))


@pytest.mark.parametrize("groups", [["g"], []])
@pytest.mark.parametrize("descending", [False, True])
def test_ranks(table, groups, descending):
    window = Window.partitionBy(*groups).orderBy(F.col("v").desc() if descending else F.col("v").asc())
    want = table.select("id", F.rank().over(window), F.dense_rank().over(window), F.percent_rank().over(window), F.cume_dist().over(window))
    same(ranks.ranked(table, groups, "v", descending, ranges=5).select("id", "rank", "dense_rank", "percent_rank", "cume_dist"), want)


@pytest.mark.parametrize("ranges", [1, 5, 60])
def test_frames(table, ranges):
    """60 ranges of 300 rows: a frame reaches over several ranges."""

    def columns(w):
        return {"sum": F.sum("id").over(w.rowsBetween(-4, 2)), "before": F.lag("id", 3).over(w), "row": F.lead("id", 2).over(w)}

    for groups in (["g"], []):
        window = Window.partitionBy(*groups).orderBy("v", "id")
        got = ranks.framed(table, groups, [F.col("v").asc(), F.col("id").asc()], 4, 2, columns, ranges)
        same(got.select("id", "sum", "before", "row"), table.select("id", *[c.alias(k) for k, c in columns(window).items()]))


@pytest.mark.parametrize("n", [1, 2, 4, 23, 30])
def test_tiles(spark, n):
    rows = spark.range(1, 24).select("id", F.lit(23).alias("total"))
    same(rows.select("id", ranks.tile(F.col("id"), F.col("total"), n)), rows.select("id", F.ntile(n).over(Window.orderBy("id"))))


def test_a_tie_is_cut_and_empty_tables_stay_empty(spark, table):
    ties = spark.range(400).select("id", F.lit(1).alias("v")).repartition(4)
    parts = ranks.dealt(ties, [], [F.col("v").asc()], ranges=8).groupBy("part").count().collect()
    assert len(parts) > 4 and max(r["count"] for r in parts) < 200
    assert {r[0] for r in ranks.numbered(ties, [], [F.col("v").asc()], "n").select("n").collect()} == set(range(1, 401))
    none = table.where("id < 0")
    assert ranks.numbered(none, ["g"], [F.col("v").asc()], "n").count() == ranks.ranked(none, ["g"], "v").count() == 0
    assert ranks.framed(none, ["g"], [F.col("v").asc()], 1, 0, lambda w: {"x": F.sum("id").over(w)}).count() == 0


def test_ranges_grow_with_the_table(spark, table, monkeypatch):
    """More ranges than the session's shuffle partitions where the rows need them, the same sums."""
    monkeypatch.setattr(ranks, "ROWS", 20, raising=False)
    order = [F.col("v").asc(), F.col("id").asc()]
    assert ranks.dealt(table, [], order).select("part").distinct().count() > 8
    for groups in (["g"], []):
        got = ranks.running(table, groups, order, "id", "n").select("id", "n")
        same(got, table.select("id", F.sum("id").over(Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))))
