from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from tessera.llm import substring


def brute(docs, window):
    words = [(i, (t or "").encode().split()) for i, t in docs]
    seen = Counter(tuple(w[p : p + window]) for _, w in words for p in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                gone[p : p + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(70)]
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 120)))) for i in range(25)]
    for i in range(25, 45):
        a, n = rng.randint(0, 30), rng.randint(5, 40)
        mine = [word() for _ in range(rng.randint(0, 60))]
        at = rng.randint(0, len(mine))
        docs.append((i, "\n ".join(mine[:at] + passage[a : a + n] + mine[at:])))
    docs += [(45, "in. " * 200), (46, "a b " * 90), (47, None), (48, ""), (49, " \t\x0b\n"), (50, "x"), (3, docs[3][1]), (3, "other text " + docs[4][1]), (None, docs[5][1]), (None, None)]
    docs.append((51, " ".join(f"w{k % 997}" for k in range(30000))))
    docs.append((52, "a" * 300000))
    docs.append((53, "nb sp " + docs[0][1]))
    return docs


@pytest.mark.parametrize("window, first", [(35, 9), (8, 3), (5, 5), (20, 4), (1, 9)])
def test_by_brute_force(spark, window, first):
    docs = corpus(window)
    df = spark.createDataFrame([(i, t, 1, [2]) for i, t in docs], "doc_id long, text string, k1 int, spans array<int>").repartition(3)
    got = sorted((tuple(r) for r in substring.dedup_substrings(df, window, first).collect()), key=repr)
    assert got == brute(docs, window)


def test_texts_with_one_32_bit_hash_keep_their_own_spans(spark):
    from pyspark.sql import functions as F

    passage, other = (" ".join(f"{x}{k}" for k in range(40)) for x in "pq")
    texts = spark.range(200_000).select(F.explode(F.array(F.concat(F.lit(passage + " "), "id"), F.concat(F.lit(other + " "), "id"))).alias("text"))
    alike = texts.groupBy(F.hash("text")).agg(F.min("text").alias("a"), F.max("text").alias("b")).where(F.col("a").startswith("p") & F.col("b").startswith("q")).orderBy("a").first()
    docs = [(None, alike["a"]), (None, alike["b"]), (7, passage + " x")]
    got = substring.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string"), 35, 9).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(docs, 35)


def test_words_made_to_collide_in_sums_are_kept(spark):
    """Thue-Morse words and their complements have equal sums in any base modulo 2**64."""
    word = "a"
    while len(word) < 8192:
        word += word.translate(str.maketrans("ab", "ba"))
    docs = []
    for n in (512, 1024, 2048, 4096, 8192):
        rest = " ".join(f"{n}x{k}" for k in range(34))
        docs += [(2 * n, f"{word[:n]} {rest}"), (2 * n + 1, f"{word[:n].translate(str.maketrans('ab', 'ba'))} {rest}")]
    got = substring.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string"), keep_text=False).collect()
    assert sorted(tuple(r) for r in got) == [x[:4] for x in sorted(brute(docs, 35))] and all(r["n_removed"] == 0 for r in got)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring.dedup_substrings(df).count() == 0


def test_levels():
    assert substring.levels(35, 9) == [9, 18]
    assert substring.levels(5, 5) == [5]
    assert substring.levels(64, 9) == [9, 18, 36]
