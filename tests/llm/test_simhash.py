"""Fingerprints, trees and components against loops over all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import queries, runs, simhash


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, pairs):
    g = list(range(n))

    def find(x):
        while g[x] != x:
            g[x] = g[g[x]]
            x = g[x]
        return x

    for a, b in pairs:
        g[find(a)] = find(b)
    return [find(i) for i in range(n)]


def near_pairs(fps, bits=4):
    for lo in range(0, len(fps), 500):
        a, b = np.nonzero(np.bitwise_count(fps[lo : lo + 500, None] ^ fps[None, :]) <= bits)
        yield from zip((a + lo).tolist(), b.tolist(), strict=True)


def same_groups(a, b):
    seen = {}
    return all(seen.setdefault(x, y) == y for x, y in zip(a, b, strict=True)) and len(set(a)) == len(set(b))


def random_fingerprints(kind, n, rng):
    base = {"random": rng.integers(0, 2**64, n, dtype=np.uint64), "dense": rng.integers(0, 2**64, n // 10, dtype=np.uint64).repeat(10), "ball": np.full(n, rng.integers(0, 2**64, dtype=np.uint64))}[kind]
    for i, k in enumerate(rng.integers(0, 7, len(base))):
        for b in rng.integers(0, 64, k):
            base[i] ^= np.uint64(1) << np.uint64(b)
    return np.unique(base)


def test_fingerprints(monkeypatch):
    r = random.Random(1)
    texts = ["", " ", "a b", "A B c", "one two THREE four", "É x İ", " ".join(r.choice("abcdefg") * r.randrange(1, 9) for _ in range(3000))]
    texts += [" ".join(r.choice(["Ab", "cd", "é", "zz"]) for _ in range(r.randrange(12))) for _ in range(200)]
    want = [fingerprint(t) for t in texts]
    assert simhash.majority([t.encode() for t in texts]).tolist() == want
    monkeypatch.setattr(runs.pieces, "__defaults__", (50,))
    monkeypatch.setattr(simhash, "_BLOCK", 100)
    assert simhash.majority([t.encode() for t in texts]).tolist() == want


def test_hash_is_sparks(spark):
    row = spark.sql("SELECT xxhash64('one two three four') AS h").first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest(b"one two three four", simhash.SEED)


@pytest.mark.parametrize("kind", ["random", "dense", "ball"])
@pytest.mark.parametrize(("leaf", "held"), [(64, 4096), (16, 20)])
def test_shards_miss_no_link(kind, leaf, held):
    fps = random_fingerprints(kind, 2000, np.random.default_rng(1))
    counts = [np.unique((fps >> np.uint64(16 * p)).astype(np.int64) & 65535, return_counts=True) for p in range(simhash.PARTS)]
    shard, visits, places = simhash.dealt(fps, simhash.shard_plan(counts, leaf, held))
    order, pairs = np.lexsort((visits, shard)), []
    shard, visits, places = shard[order], visits[order], places[order]
    for s in np.unique(shard):
        own, others = places[(shard == s) & (visits == 0)], places[(shard == s) & (visits == 1)]
        if len(own):
            found = simhash.Shard(own, 4)
            pairs += found.inner_links() + (found.links_of(others) if len(others) else [])
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    at = {int(x): i for i, x in enumerate(fps)}
    assert same_groups(roots(len(fps), [(at[a], at[b]) for a, b in pairs]), roots(len(fps), near_pairs(fps)))
    own = visits == 0
    assert sorted(places[own].tolist()) == sorted(fps.tolist() * simhash.PARTS)  # every fingerprint has one leaf in each tree


def test_tree_visits_hold_a_neighbour_and_leave_none_out():
    rng = np.random.default_rng(3)
    values, weights = np.unique(rng.integers(0, 65536, 9000), return_counts=True)
    home, sizes, visits = simhash.tree(values.astype(np.uint16), weights, 100)
    assert sizes.sum() == weights.sum() and sizes.max() <= 100 and (home[values] >= 0).all()
    have = set(values.tolist())
    want = {(v, int(home[u])) for v in have for b in range(16) if (u := v ^ 1 << b) in have and home[u] > home[v]}
    assert {(int(v), n) for v, n in visits} == want


def test_documents(spark, small):
    """The whole query against all pairs."""
    got = queries.op11_simhash_vp_trees(spark, small).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(got) == len(texts)
    fps = np.array([fingerprint(texts[r.doc_id]) for r in got], dtype=np.uint64)
    assert [r.fingerprint for r in got] == [f"{x:016x}" for x in fps.tolist()]
    root, least = roots(len(got), near_pairs(fps)), {}
    for g, r in zip(root, got, strict=True):
        least[g] = min(r.doc_id, least.get(g, r.doc_id))
    assert [r.component_id for r in got] == [least[g] for g in root]


def test_odd_rows(spark):
    """Null ids and texts, repeated rows, a frequent text, columns of clashing names, an empty table."""
    long = "word " * 5 + "other " * 50_000
    data = [(5, None, 1), (3, "", 2), (None, "  ", 3), (None, "a b c", 4), (8, "A B C", 5), (8, "A B C", 5), (9, long, 6), (None, "only here", 7)] + [(i, "x y z", 0) for i in range(20, 60)]
    docs = spark.createDataFrame(data, "doc_id long, text string, Component_ID int").withColumn("_fp", F.lit("own"))
    got = simhash.simhash_components(docs.repartition(3))
    assert got.columns == ["doc_id", "_fp", "fingerprint", "component_id"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(data) and {r[1] for r in rows} == {"own"}
    assert sorted(r[2:] for r in rows if r[0] in (3, 5)) == [("0" * 16, 3)] * 2
    assert {r[3] for r in rows if r[0] is None} == {3, 8, None} and [r[3] for r in rows if r[0] == 8] == [8, 8]
    assert {r[3] for r in rows if r[0] and r[0] >= 20} == {20} and [r[2] for r in rows if r[0] == 9] == [f"{fingerprint(long):016x}"]
    assert simhash.simhash_components(docs.where("doc_id < 0")).count() == 0
