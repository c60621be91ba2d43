"""Intervals, reachability and sketches against loops, with ties, nulls, repeated rows and empty tables."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import graphs, intervals, ranks, sketches
from tessera.sources import stored


def spans(seed, n, top):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lo = rng.choice([None, rng.randrange(-top, top), rng.randrange(-top, top)])
        hi = None if rng.random() < 0.1 else (lo or 0) + rng.choice([0, 0, 1, 3, rng.randrange(top), -1])
        out.append((i, lo, hi))
    return [*out, *out[:5]]


def meets(a, b):
    return None not in (a[1], a[2], b[1], b[2]) and a[1] <= a[2] and b[1] <= b[2] and a[1] <= b[2] and b[1] <= a[2]


def test_pieces_cover_an_interval_once(spark):
    rng = random.Random(2)
    rows = [(0, 0), (0, 1), (0, 7), (1, 6), (3, 3), (2, 2), (5, 4), (0, 2**39 - 1), (2**39 - 1, 2**39 - 1), (7, 2**38 + 5)] + [(a := rng.randrange(500), a + rng.randrange(200)) for _ in range(200)]
    df = spark.createDataFrame(rows, "lo long, hi long")
    for lo, hi, found in df.select("lo", "hi", intervals.pieces(F.col("lo"), F.col("hi"))).collect():
        ranges = sorted((p.piece << p.level, (p.piece + 1 << p.level) - 1) for p in found)
        levels = [p.level for p in found]
        assert max((levels.count(k) for k in levels), default=0) <= 2
        if hi < lo:
            assert not found
        else:
            assert ranges[0][0] == lo and ranges[-1][1] == hi and all(a[1] + 1 == b[0] for a, b in zip(ranges, ranges[1:]))


@pytest.mark.parametrize(("top", "unit"), [(12, 1), (1000, 1), (1000, 37)])
def test_overlaps(spark, top, unit):
    left, right = spans(1, 60, top), spans(2, 50, top)
    a = spark.createDataFrame(left, "id int, lo int, hi int")
    b = spark.createDataFrame(right, "id int, since int, until int").repartition(3)
    got = sorted((r.l.id, r.r.id) for r in intervals.overlaps(a, b, ("lo", "hi"), ("since", "until"), unit).collect())
    assert got == sorted((x[0], y[0]) for x in left for y in right if meets(x, y)) and got
    once = left[:60]
    counts = intervals.overlap_counts(spark.createDataFrame(once, "id int, lo int, hi int"), b, ("lo", "hi"), ("since", "until"), "id", "n")
    assert sorted(map(tuple, counts.collect())) == [(x[0], sum(meets(x, y) for y in right)) for x in once]


def test_overlaps_make_no_nested_loop(spark):
    a = spark.createDataFrame(spans(1, 30, 50), "id int, lo int, hi int")
    plan = intervals.overlaps(a, a, ("lo", "hi"), ("lo", "hi"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    none = a.where("id < 0")
    assert intervals.overlaps(a, none, ("lo", "hi"), ("lo", "hi")).count() == intervals.overlaps(none, a, ("lo", "hi"), ("lo", "hi")).count() == 0
    assert {r.n for r in intervals.overlap_counts(a.where("id < 20"), none, ("lo", "hi"), ("lo", "hi"), "id", "n").collect()} == {0}


def test_overlap_counts_order_distinct_ends_only(spark, monkeypatch):
    """3,000 spans with 21 ends: what is dealt to ranges is a row for each end."""
    sizes, dealt = [], ranks.dealt

    def counted(df, *args):
        sizes.append(df.count())
        return dealt(df, *args)

    monkeypatch.setattr(ranks, "dealt", counted)
    rows = spark.range(3000).select("id", (F.col("id") % 20).alias("lo"), (F.col("id") % 20 + F.col("id") % 2).alias("hi"))
    counts = {r.id: r.n for r in intervals.overlap_counts(rows, rows, ("lo", "hi"), ("lo", "hi"), "id", "n").collect()}
    spans = [(i % 20, i % 20 + i % 2) for i in range(3000)]
    met = {x: sum(x[0] <= y[1] and y[0] <= x[1] for y in spans) for x in set(spans)}
    assert counts == {i: met[x] for i, x in enumerate(spans)} and max(sizes) == 21


@pytest.mark.parametrize("seed", [1, 2])
def test_reachable(spark, seed):
    """Cycles, loops, repeated and null edges and starts, starts that aren't nodes."""
    rng = random.Random(seed)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(40)] + [(1, 1), (None, 3), (4, None), (5, 6), (5, 6), (6, 5)]
    starts = [3, 3, 5, 17, 99, None]
    want = []
    for s in {x for x in starts if x is not None}:
        seen, front, hops = {s: 0}, {s}, 0
        while front:
            hops += 1
            front = {b for a, b in edges if a in front and b is not None} - set(seen)
            seen |= dict.fromkeys(front, hops)
        want += [(s, node, h) for node, h in seen.items()]
    e = spark.createDataFrame(edges, "a int, b int")
    found = graphs.reachable(e, spark.createDataFrame([(x,) for x in starts], "start int"))
    assert sorted(map(tuple, found.collect())) == sorted(want)
    # a fixed point: following any edge from what was found leads to nothing new
    again = found.join(e, F.col("node") == F.col("a")).where("b is not null").select("start", F.col("b").alias("node")).distinct()
    assert again.join(found, ["start", "node"], "left_anti").count() == 0
    assert sorted(map(tuple, graphs.reachable(e, spark.createDataFrame([(3,)], "start int"), most=1).collect())) == sorted(x for x in want if x[0] == 3 and x[2] <= 1)
    assert graphs.reachable(e.where("a > 1000"), spark.createDataFrame([(3,)], "start int")).collect() == [(3, 3, 0)]


def test_reachable_keeps_words_of_starts_not_pairs(spark, monkeypatch):
    """150 starts go around a ring of 160 nodes: what a round writes has at most a row for each node and 64 starts, and two steps are one round."""
    sizes = []

    def counted(df):
        table = stored.written(df)
        if "node" in df.columns:
            sizes.append(table.count())
        return table

    monkeypatch.setattr(graphs, "written", counted)
    ring = spark.range(160).select(F.col("id").alias("a"), ((F.col("id") + 1) % 160).alias("b")).coalesce(1)
    found = graphs.reachable(ring, spark.range(150).select(F.col("id").alias("start")), most=19)
    assert sorted(map(tuple, found.collect())) == sorted((s, (s + h) % 160, h) for s in range(150) for h in range(20))
    assert len(sizes) <= 11 and max(sizes) <= 3 * 160


def test_reachable_takes_single_steps_where_a_hub_has_too_many_double_ones(spark):
    edges = [(i, 1000) for i in range(60)] + [(1000, 2000 + i) for i in range(60)]
    found = graphs.reachable(spark.createDataFrame(edges, "a int, b int"), spark.createDataFrame([(i,) for i in range(60)], "start int"))
    assert sorted(map(tuple, found.collect())) == sorted((s, node, h) for s in range(60) for node, h in [(s, 0), (1000, 1), *((2000 + i, 2) for i in range(60))])


def test_reachable_leaves_no_shuffle_files_of_its_rounds(spark):
    """20 rounds around a ring: the files of their shuffles go with the rounds, whether or not the driver collects its garbage."""

    def shuffles():
        return set(re.findall(r"shuffle_(\d+)_", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")))

    ring = spark.range(40).select(F.col("id").alias("a"), ((F.col("id") + 1) % 40).alias("b"))
    before = shuffles()
    found = graphs.reachable(ring, spark.range(3).select(F.col("id").alias("start")))
    until = time.time() + 10
    while shuffles() - before and time.time() < until:  # executors delete them a moment later
        time.sleep(0.2)
    assert not shuffles() - before
    assert sorted(map(tuple, found.collect())) == sorted((s, (s + h) % 40, h) for s in range(3) for h in range(40))
    assert spark.conf.get(stored._SHUFFLES_END) == "false"


def test_reachable_puts_starts_with_the_same_nodes_in_the_same_words(spark, monkeypatch):
    """Four rings of 64 nodes with keys in turn: a word has the starts of one ring, so the table has a row for each node, not four."""
    sizes = []

    def counted(df):
        table = stored.written(df)
        if {"word", "node"} <= set(df.columns):
            sizes.append(table.count())
        return table

    monkeypatch.setattr(graphs, "written", counted)
    monkeypatch.setattr(graphs, "FEW_ROWS", 0, raising=False)
    ring = spark.range(256).select(F.col("id").alias("a"), F.pmod(F.col("id") - 4, F.lit(256)).alias("b"))
    found = graphs.reachable(ring, spark.range(256).select(F.col("id").alias("start")))
    assert sorted(map(tuple, found.collect())) == sorted((s, (s - 4 * h) % 256, h) for s in range(256) for h in range(64))
    assert max(sizes) == 256


def test_reachable_is_the_same_whichever_words_starts_share(spark, monkeypatch):
    """Random edges with nulls, loops and repeats; starts that no edge has, or that no edge leaves."""
    rng = random.Random(5)
    edges = spark.createDataFrame([(rng.choice([None, *range(300)]), rng.randrange(300)) for _ in range(330)] + [(7, 7), (1, 2), (1, 2), (3, None)], "a int, b int")
    starts = spark.createDataFrame([(x,) for x in [*range(0, 300, 2), 4, 999, None]], "start int")
    want = sorted(map(tuple, graphs.reachable(edges, starts).collect()))
    monkeypatch.setattr(graphs, "FEW_ROWS", 0, raising=False)
    for looks in (0, 2, 8):
        monkeypatch.setattr(graphs, "LOOKS", looks, raising=False)
        assert sorted(map(tuple, graphs.reachable(edges, starts).collect())) == want and (999, 999, 0) in want
    assert graphs.reachable(edges.where("a > 1000"), starts.where("start = 4")).collect() == [(4, 4, 0)]


def test_merged_sketches_are_as_good_as_whole_ones(spark):
    """Many distinct values, a skewed one, nulls; days merged to one group, against exact figures and against one sketch over all rows."""
    n = 60_000
    x = F.pmod(F.xxhash64("id"), F.lit(1_000_000)).cast("double")
    heavy = F.when(F.col("id") % 10 < 3, F.lit("often")).when(F.col("id") % 10 == 3, F.lit("some")).otherwise((F.col("id") % 20_000).cast("string"))
    rows = spark.range(n).select((F.col("id") % 30).alias("day"), F.when(F.col("id") % 50 != 0, F.col("id") % 20_000).alias("user"), x.alias("value"), heavy.alias("what"))
    days = sketches.kept(rows, [F.col("day")], "user", "value", "what")
    assert days.count() == 30
    told = sketches.merged(days, [F.lit(1).alias("all")]).select("n", sketches.distinct_count().alias("users"), sketches.quantile(0.5).alias("q5"), sketches.quantile(0.99).alias("q99"), sketches.heaviest(2).alias("top")).first()
    users = rows.select("user").where("user is not null").distinct().count()
    assert told.n == n and abs(told.users - users) <= sketches.HLL_ERROR * users and told.users != 0
    for rank, value in ((0.5, told.q5), (0.99, told.q99)):
        assert abs(rows.where(F.col("value") <= value).count() / n - rank) <= sketches.RANK_ERROR + 1 / n
    assert [t.item for t in told.top] == ["often", "some"]
    for item, exact in (("often", n * 3 // 10), ("some", n // 10)):
        count = next(t["count"] for t in told.top if t.item == item)
        assert abs(count - exact) <= 3 * n / sketches.TRACKED
    nulls = spark.createDataFrame([(1, None, None, None)], "day int, user long, value double, what string")
    empty = sketches.merged(sketches.kept(nulls, [F.col("day")], "user", "value", "what"), [F.col("day")]).select("n", sketches.distinct_count().alias("users"), sketches.heaviest(2).alias("top")).first()
    assert empty.n == 1 and empty.users == 0
    assert sketches.kept(nulls.where("day > 1"), [F.col("day")], "user", "value", "what").count() == 0
