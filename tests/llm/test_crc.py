"""CRCs of word runs against zlib on their strings; the draw against a plain loop."""

from __future__ import annotations

import math
import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import crc
from tessera.llm.text import blocks


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def features(text, shortest, longest, buckets):
    w = words(text)
    return [zlib.crc32(" ".join(w[j : j + k]).encode()) % buckets for k in range(shortest, longest + 1) for j in range(len(w) - k + 1)]


def random_texts(n):
    rng = random.Random(3)
    odd = ["", " ", "Abc déf x", "aa-bb_cc 12", "x" * 70 + " y", "日本 語 a\x00b", "İ ſ K", "q" * 1000]
    return odd + [" ".join(rng.choice(["Ab", "cD", "é1", "q" * 65, "x-y"]) for _ in range(rng.randrange(9))) for _ in range(n)]


@pytest.mark.parametrize(("shortest", "longest"), [(1, 1), (1, 4), (3, 3)])
@pytest.mark.parametrize("limit", [1 << 20, 64])
def test_buckets(shortest, longest, limit):
    texts = random_texts(60)
    made = crc.Features()
    for lo, _, data, rows in blocks(pa.array(texts), limit):
        bucket, of, n = made.buckets(data, rows, shortest, longest, 10_000)
        for k, number in enumerate(n.tolist()):
            assert number == len(words(texts[lo + k]))
            assert sorted(bucket[of == k].tolist()) == sorted(features(texts[lo + k], shortest, longest, 10_000))


def test_shifts_by_any_length():
    shifts, rng = crc.Shifts(), np.random.default_rng(4)
    for n in (0, 1, 2, 3, 7, 64, 1000, 70_001):
        a, b = rng.bytes(9), rng.bytes(n)
        got = shifts.appended(np.array([zlib.crc32(a)], dtype=np.uint32), np.array([n]))[0] ^ zlib.crc32(b)
        assert got == zlib.crc32(a + b)


def brute(docs, target, shortest, longest, buckets, least, percent, seed):
    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for b in features(t, shortest, longest, buckets):
                out[b] += 1
        return out

    s, t = counts(x[1] for x in docs), counts(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * float(sum(s) + buckets) / ((s[b] + 1) * float(sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        f = features(text, shortest, longest, buckets)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        key = f"{seed}:{doc_id}" if doc_id is not None else f"{seed}::{sha256((text or '').encode()).hexdigest()}"
        h = int(sha256(key.encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0]))
    k = percent * len(able) // 100
    return rows, [r[0] for r in able[:k]]


@pytest.mark.parametrize(("longest", "least", "percent"), [(1, 2, 30), (3, 0, 50), (2, 5, 100), (1, 100, 10)])
def test_draw(spark, longest, least, percent):
    """Nulls in every column, repeated rows, ties of rows that share a doc_id, and columns named like new ones."""
    texts = random_texts(80)
    docs = [(i, t) for i, t in enumerate(texts)] + [(500, None), (None, "Ab cD é1 Ab Ab"), (None, "cD cD x"), (7, "again and again"), (7, "again and again")]
    target = ["Ab cD Ab", None, "", "é1 é1 Ab"]
    table = spark.createDataFrame([(i, t, -1.0, None) for i, t in docs], "doc_id long, text string, Weight double, other int").repartition(3)
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = crc.resample_towards(table, items, 1, longest, 50, least, percent, 99, keep=["doc_id", "Weight", "other"])
    assert got.columns == ["doc_id", "other", "n_features", "weight", "score", "rank"]
    found = got.collect()
    rows, drawn = brute(docs, target, 1, longest, 50, least, percent, 99)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:4])
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in found), key=key) == sorted((r[:4] for r in rows), key=key)
    ranked = sorted((r.rank, r.doc_id) for r in found if r.rank is not None)
    assert [r[1] for r in ranked] == drawn and [r[0] for r in ranked] == list(range(1, len(drawn) + 1))


def test_other_columns_go_along_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c", "en"), (2, None, None)], "doc_id long, text string, lang string")
    none = docs.where("doc_id > 5")
    got = {r.doc_id: r for r in crc.resample_towards(docs, none.select("text"), least_words=1, percent=100).collect()}
    assert got[1].text == "a b c" and got[1].lang == "en" and got[1].rank == 1 and got[2].rank is None
    assert crc.resample_towards(none, docs.select("text")).count() == 0
