from __future__ import annotations

import math
import struct
import zlib

import pytest
import xxhash

from tessera.llm import mixing, sharding
from tessera.llm.common import numbered


def bid(key: int, shard: int, weight: float) -> float:
    h = xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42)
    h = xxhash.xxh64_intdigest(struct.pack("<i", shard), seed=h)
    return -weight / math.log(((h >> 11) + 0.5) * 2.0**-53)


@pytest.mark.parametrize("weights", [[1.0] * 24, [1.0, 0.0, 3.0, 2.5]])
def test_winner_by_brute_force(spark, weights):
    keys = [*range(300), -1, 2**62, -(2**63)]
    got = sharding.assign_shards(spark.createDataFrame([(k,) for k in keys], "doc_id long"), "doc_id", weights).collect()
    for r in got:
        bids = [bid(r["doc_id"], j, w) if w else -1.0 for j, w in enumerate(weights)]
        best = max(bids)
        assert abs(bids[r["shard"]] - best) <= 1e-9 * best
        more = bid(r["doc_id"], len(weights), sum(weights) / len(weights))
        assert r["grown_shard"] == (len(weights) if more > best else r["shard"])


def test_share_follows_weight(spark):
    rows = sharding.assign_shards(spark.range(6000).withColumnRenamed("id", "doc_id"), "doc_id", [1.0, 2.0, 3.0]).groupBy("shard").count().collect()
    share = {r["shard"]: r["count"] / 6000 for r in rows}
    assert all(abs(share[j] - (j + 1) / 6) < 0.03 for j in range(3))


def test_documents_with_nulls_ties_and_clashing_columns(spark):
    rows = [(1, "aé", 7, "x"), (1, "aé", 7, "x"), (2, None, 8, "y"), (None, "b", 9, "z"), (3, "", 1, None), *[(5, "t", 1, "q")] * 20]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, _bucket string")
    got = sharding.shard_documents(df).collect()
    assert len(got) == len(rows) and "_bucket" in got[0].asDict()
    for r in got:
        data = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 8, zlib.crc32(data), "key")
    by_shard: dict[int, list[int]] = {}
    for r in got:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    assert sharding.shard_documents(df.where("false")).count() == 0


def test_no_weight_is_an_error(spark):
    with pytest.raises(ValueError):
        sharding.assign_shards(spark.range(1), "id", [0.0])


def test_numbers_without_gaps(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000).withColumn("g", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 2))
    got = numbered(df, ["g"], F.pmod(F.xxhash64("id"), F.lit(7)), [F.col("id")], "n", 7).collect()
    for g in (None, 0, 1):
        mine = sorted(r["n"] for r in got if r["g"] == g)
        assert mine == list(range(len(mine))) and mine


def brute_schedule(blocks: dict, shares: dict) -> dict:
    """Frame by frame, earliest deadline first among released blocks; (source, block) -> slot."""
    out, base, frame = {}, 0, 0
    while any(frame * shares[s] < n for s, n in blocks.items()):
        now = {s: min(n, (frame + 1) * shares[s]) - frame * shares[s] for s, n in blocks.items()}
        now = {s: m for s, m in now.items() if m > 0}
        length, done = sum(now.values()), dict.fromkeys(now, 0)
        for slot in range(length):
            ready = [(-(-(done[s] + 1) * length // m), str(s), s) for s, m in now.items() if done[s] < m and done[s] * length // m <= slot]
            s = min(ready)[2]
            out[s, frame * shares[s] + done[s]] = base + slot
            done[s] += 1
        base, frame = base + length, frame + 1
    return out


@pytest.mark.parametrize("block_rows, frame, weights", [(3, 7, None), (1, 10, [("a", 5.0), ("b", 3.0), ("c", 2.0)]), (4, 50, [("a", 1.0), ("a", 0.5), ("nowhere", 9.0), ("b", None)])])
def test_mixing_by_brute_force(spark, block_rows, frame, weights):
    sources = {"a": 211, "b": 90, "c": 17, "d": 1}
    docs = spark.createDataFrame([(i, s, s) for s, n in sources.items() for i in range(n)], "doc_id long, source string, mix_slot string")
    table = None if weights is None else spark.createDataFrame(weights, "source string, weight double")
    got = mixing.mix_sources(docs, weights=table, block_rows=block_rows, frame=frame).collect()
    assert len(got) == len({(r["source"], r["doc_id"]) for r in got}) == sum(sources.values())
    plan = {r["source"]: (r["blocks"], r["share"]) for r in mixing.source_plan(docs, "source", table, block_rows, frame).collect()}
    want = brute_schedule({s: b for s, (b, _) in plan.items()}, {s: q for s, (_, q) in plan.items()})
    assert {(r["source"], r["mix_block"]): r["mix_slot"] for r in got} == want
    assert len({(r["mix_slot"], r["mix_seq"]) for r in got}) == len(got)
    for r in got:
        assert r["mix_release"] <= r["mix_slot"] < r["mix_deadline"]


def test_less_than_one_block_from_the_share(spark):
    sources = {"a": 500, "b": 300, "c": 150, "d": 50}
    docs = spark.createDataFrame([(i, s) for s, n in sources.items() for i in range(n)], "doc_id long, source string")
    table = spark.createDataFrame([(s, float(n)) for s, n in sources.items()], "source string, weight double")
    order = [r["source"] for r in mixing.mix_sources(docs, weights=table, block_rows=1, frame=100).sort("mix_slot").collect()]
    for s, n in sources.items():
        seen = 0
        for t, x in enumerate(order, 1):
            seen += x == s
            assert abs(seen - t * n / 1000) < 1


@pytest.mark.parametrize("rows, weights", [([4000, 8000], [1.0, 2.0]), ([9000, 20, 20], [5000.0, 1.0, 1.0]), ([3000, *[60] * 32], None), ([7, 900, 2500, 1], [0.3, 0.1, 0.7, 1e-3])])
def test_less_than_one_block_from_the_true_weight_over_many_frames(spark, rows, weights):
    names = [f"s{i:02}" for i in range(len(rows))]
    docs = spark.range(sum(rows)).selectExpr("id as doc_id", "case " + " ".join(f"when id < {sum(rows[: i + 1])} then '{s}'" for i, s in enumerate(names)) + " end as source")
    table = weights and spark.createDataFrame(list(zip(names, weights)), "source string, weight double")
    got = mixing.mix_sources(docs, weights=table, block_rows=1).select("source", "mix_block", "mix_release", "mix_slot", "mix_deadline").sort("mix_slot").collect()
    assert [r["mix_slot"] for r in got] == list(range(sum(rows)))
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in got)
    weight = dict(zip(names, weights or [math.sqrt(n) for n in rows]))
    ideal, left, seen = dict.fromkeys(names, 0.0), dict(zip(names, map(float, rows))), dict.fromkeys(names, 0)
    for r in got:
        assert r["mix_block"] == seen[r["source"]]
        seen[r["source"]] += 1
        time = 1.0
        while time > 1e-9 and left:
            total = sum(weight[s] for s in left)
            step = min(time, min(left[s] * total / weight[s] for s in left))
            for s in list(left):
                ideal[s] += step * weight[s] / total
                left[s] -= step * weight[s] / total
                if left[s] < 1e-7:
                    del left[s]
            time -= step
        assert all(abs(seen[s] - ideal[s]) < 1 + 1e-4 for s in names)


def test_blocks_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 10)
    docs = spark.range(1000).selectExpr("id as doc_id", "if(id < 300, 'a', 'b') as source")
    assert mixing.rows_in_block(docs) == 100
    got = mixing.mix_sources(docs).collect()
    assert {r["mix_slot"] for r in got} == set(range(10)) and len({(r["mix_slot"], r["mix_seq"]) for r in got}) == 1000


def test_columns_named_like_helpers_stay(spark):
    names = ["_of_shard", "_of__bucket", "_mix_of", "_mix_at", "_mix_slot", "_mix_piece", "_bucket", "_start", "_rank"]
    docs = spark.range(50).selectExpr("id as doc_id", "string(id) as text", "string(id % 3) as source", *[f"id + 7 as {n}" for n in names])
    for df in (sharding.shard_documents(docs), mixing.mix_sources(docs), mixing.mix_sources(docs, frame=10)):
        rows = df.collect()
        assert len(rows) == 50 and all(r[n] == r["doc_id"] + 7 for r in rows for n in names)


def test_rows_that_share_an_id_are_spread(spark):
    docs = spark.range(3000).selectExpr("cast(null as long) as doc_id", "string(id) as text", "'a' as source")
    slots = sorted(r["slot"] for r in sharding.shard_documents(docs).collect())
    assert slots == list(range(3000))
    got = mixing.mix_sources(docs).collect()
    assert len({(r["mix_slot"], r["mix_seq"]) for r in got}) == 3000


def test_mixing_null_sources_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (None, None), (2, "a"), (2, "a")], "doc_id long, source string")
    got = mixing.mix_sources(docs, block_rows=1).collect()
    assert sorted(r["mix_slot"] for r in got) == [0, 1, 2, 3]
    assert mixing.mix_sources(docs.where("false")).count() == 0


def test_no_python_on_the_main_path(spark):
    docs = spark.createDataFrame([(1, "t", "a")], "doc_id long, text string, source string")
    for df in (mixing.mix_sources(docs), sharding.shard_documents(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
