"""Periodic runs against a loop over all periods; the whole query against SQL is in test_queries."""

from __future__ import annotations

import random
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import runs


def brute(w, least, times):
    n, out = len(w), []
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i + p - start >= max(least, times * p):
                out.append((start, i + p - start, p))
    smaller = lambda a, b: a[2] < b[2] and a[0] <= b[0] and a[0] + a[1] >= b[0] + b[1]
    return sorted((r for r in out if not any(smaller(q, r) for q in out)), key=lambda r: (r[0], r[2]))


def test_random_sequences():
    rng = random.Random(5)
    for _ in range(1500):
        n, k = rng.randrange(0, 90), rng.choice([1, 2, 3, 4])
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(4) if n else 0):
            a, p, m = rng.randrange(n), rng.randrange(1, 12), rng.randrange(0, 60)
            w[a:a] = [w[(a + i % p) % n] for i in range(m)]
        least, times = rng.choice([(24, 3), (4, 2), (2, 2), (6, 3), (10, 2)])
        assert runs.find_runs(np.array(w, dtype=np.int32), least, times) == brute(w, least, times)


def test_sequences_with_very_many_runs_or_long_ones():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    for w in (b[:1200], [bin(i).count("1") % 2 for i in range(1024)], [0] * 700, [i % 100 for i in range(900)], [i % 7 for i in range(900)] + [i % 5 for i in range(900)]):
        assert runs.find_runs(np.array(w, dtype=np.int32), 2, 2) == brute(w, 2, 2)


def test_hashes_that_fail_are_found_out(monkeypatch):
    """With a tiny modulus hashes often say that unequal words are equal; the words themselves decide."""
    rng = random.Random(8)
    w = [rng.randrange(2) for _ in range(60)] * 4 + [rng.randrange(3) for _ in range(200)]
    want = brute(w, 24, 3)
    fails = []
    holds = runs.Extensions.holds
    monkeypatch.setattr(runs, "_PRIME", 8191)
    monkeypatch.setattr(runs.Extensions, "holds", lambda self, ids: (x := holds(self, ids)) or fails.append(x))
    for shift in range(40):
        v = w[shift:] + w[:shift]
        assert runs.find_runs(np.array(v, dtype=np.int32)) == brute(v, 24, 3)
    assert want and runs.find_runs(np.array(w, dtype=np.int32)) == want


def test_pieces_of_a_text():
    text = b"  aa b\xc2\xa0c \t d\x0be " * 40
    assert sum(runs.pieces(text, 7), []) == text.split() and sum(runs.pieces(b"", 7), []) == []
    assert sum(runs.pieces(b"x" * 50, 7), []) == [b"x" * 50]


def test_table(spark):
    """Null and empty texts, repeated rows, odd spaces, a long text, columns named like new ones, empty tables."""
    again = " \t".join(["one two\x0bthree"] * 9)
    data = [(1, again, 5), (1, again, 5), (None, None, None), (2, "", 1), (3, "a b", 2), (4, "x " * 30 + "y " * 30, 3), (5, "w" + " z" * 200_000, 4)]
    docs = spark.createDataFrame(data, "doc_id long, text string, Runs int").repartition(2)
    got = runs.periodic_runs(docs)
    assert got.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    rows = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()}
    assert got.count() == 7
    assert rows[1] == (27, [(0, 27, 3)], "one two three")
    assert rows[None] == (0, [], "") and rows[2] == (0, [], "") and rows[3] == (2, [], "a b")
    assert rows[4] == (60, [(0, 30, 1), (30, 30, 1)], "x y")
    assert rows[5] == (200_001, [(1, 200_000, 1)], "w z")
    assert runs.periodic_runs(docs.where("doc_id > 9")).count() == 0
    said = {r.doc_id: r for r in runs.digest(got).collect()}
    assert said[4].n_runs == 2 and (said[4].start, said[4].length, said[4].period, said[4].exponent_milli) == (0, 30, 1, 30_000)
    assert said[4].runs_sha256 == sha256(b"0,30,1\n30,30,1\n").hexdigest() and said[3].start is None and said[None].collapsed_sha256 == sha256(b"").hexdigest()


@pytest.mark.parametrize("text", ["a b c d e f g h i j", "one", "", None])
def test_planted_periods(spark, text):
    import zlib

    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(text).cast("string").alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(None, text)], "doc_id long, text string"))
    changed = 0
    for r in runs.repeated(docs).collect():
        w = (text or "").split()
        h = zlib.crc32(str(r.doc_id).encode())
        if r.doc_id is None or h % 10 or not w:
            assert r.text == text
            continue
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert r.text == " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n))
        changed += 1
    assert changed > 5 or not (text or "").strip()
