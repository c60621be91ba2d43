"""Quality resampling, decontamination, personal data."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tessera.llm import decontaminate, pii, quality

TOKEN = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^\s0-9A-Za-z_\x80-\xff]+")


def corpus(seed=1):
    rng = random.Random(seed)
    good = ["the", "of", "and", "in", "water", "stone", "light", "field", "river", "house"]
    bad = ["zz###", "qq%%%", "BUY!!", "|"]
    docs, labels = [], []
    for i in range(400):
        is_good = rng.random() < 0.8
        words = [rng.choice(good if is_good or rng.random() < 0.5 else bad) for _ in range(rng.randint(20, 80))]
        docs.append((i, " ".join(words), is_good))
        if i % 3 == 0:
            labels.append((i, int(is_good), int(rng.random() < 0.05)))
    return docs, labels


def test_held_out_documents_are_told_apart(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in docs], "doc_id long, text string, n_grams string")
    kept = quality.resample(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), keep_columns=True)
    ids = {r["doc_id"] for r in kept.collect()}
    labelled = {i for i, _, _ in labels}
    good = [i for i, _, g in docs if g and i not in labelled]
    bad = [i for i, _, g in docs if not g and i not in labelled]
    assert sum(i in ids for i in good) >= 0.95 * len(good)
    assert sum(i in ids for i in bad) <= 0.1 * len(bad)


def test_toxic_documents_go(spark):
    rng = random.Random(5)
    words = ["the", "of", "and", "in", "water", "stone", "light", "field", "river", "house"]
    docs, labels = [], []
    for i in range(900):
        text, toxic = [rng.choice(words) for _ in range(rng.randint(20, 300))], rng.random() < 0.15
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["idiot", "Scum", "TRASH"])
        docs.append((i, " ".join(text), toxic))
        if i % 3 < 2:
            labels.append((i, 1, int(toxic)))
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    ids = {r["doc_id"] for r in quality.resample(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    for toxic, least, most in ((True, 0, 0.02), (False, 0.98, 1)):
        unseen = [i in ids for i, _, t in docs if t == toxic and i % 3 == 2]
        assert least * len(unseen) <= sum(unseen) <= most * len(unseen)


def test_log_weights_by_plain_counts(spark):
    docs, labels = corpus(2)
    docs = docs[:60] + [(900, None, True), (901, "", True), (None, "of of  of", True), (902, "é é é, x x", True)]
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string").repartition(3)
    target = [i for i, q, t in labels if q and not t and i < 60]
    ratio = quality.gram_models(df, target, 500)
    rows = {r["doc_id"]: r for r in quality.log_weights(df, ratio).collect()}
    hasher = quality.Hasher()

    def grams(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        bucket, _ = quality.bucketed(hasher, data, np.array([0, len(data)]), 500)
        return bucket.tolist()

    raw, good = np.ones(500), np.ones(500)
    for i, t, _ in docs:
        tokens = TOKEN.findall((t or "").encode())
        again = sum(k > 0 and tokens[k] == tokens[k - 1] or k > 1 and tokens[k] == tokens[k - 2] for k in range(len(tokens)) if re.match(rb"[\w\x80-\xff]", tokens[k]))
        found = grams(t)
        assert len(found) == len(tokens) + max(0, len(tokens) - 1) + again
        np.add.at(raw, found, 1)
        if i in target:
            np.add.at(good, found, 1)
    want = np.log(good / good.sum()) - np.log(raw / raw.sum())
    assert np.allclose(want, ratio)
    for i, t, _ in docs:
        assert abs(rows[i]["log_weight"] - want[grams(t)].sum()) < 1e-5 if t else rows[i]["log_weight"] == 0
        if i is not None:
            h = xxhash.xxh64_intdigest(struct.pack("<i", quality.SEED), seed=xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42))
            noise = -math.log(-math.log(((h >> 11) + 0.5) * 2.0**-53))
            assert abs(rows[i]["gumbel_key"] - rows[i]["log_weight"] - noise) < 1e-9


def plain_buckets(text, buckets, hasher):
    """The n-grams of a text, token by token."""

    def one(words):
        data = np.frombuffer(b" ".join(words), np.uint8)
        hashes = hasher.word_hashes(hasher.split(data, np.array([0, len(data)])))
        return int(hasher.ngrams(hashes, 2)[0] if len(words) == 2 else hashes[0]) % (buckets - 1)

    tokens = TOKEN.findall((text or "").encode())
    again = [k for k in range(len(tokens)) if re.match(rb"[\w\x80-\xff]", tokens[k]) and tokens[k] in tokens[max(0, k - 2) : k]]
    return [one([t]) for t in tokens] + [one(list(p)) for p in zip(tokens, tokens[1:])] + [buckets - 1] * len(again)


def hashed(i, *more):
    h = xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42)
    for x in more:
        h = xxhash.xxh64_intdigest(struct.pack("<i", x), seed=h)
    return h


def test_resampling_by_brute_force(spark):
    docs, labels = corpus(7)
    labels = [(i, q, 0) for i, q, _ in labels]
    docs += [(1000, "the of " * 100_000, True), (1001, "", True)]
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string").repartition(3)
    rows = quality.resample(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    hasher, buckets = quality.Hasher(), quality.BUCKETS
    grams = {i: plain_buckets(t, buckets, hasher) if i != 1000 else [*plain_buckets("the of the of", buckets, hasher)] for i, t, _ in docs}
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    order = sorted(labels, key=lambda r: signed(hashed(r[0])))
    good, poor = [i for i, q, _ in order if q == 1], [i for i, q, _ in order if q == 0]
    fit, held_out = set(good[::2]), good[1::2]
    the, of, the_of, of_the, *_ = grams[1000][0], grams[1000][1], *grams[1000][4:6]
    grams[1000] = [the, of] * 100_000 + [the_of, of_the] * 99_999 + [the_of] + [buckets - 1] * 199_998
    raw, target = np.ones(buckets), np.ones(buckets)
    for i, found in grams.items():
        np.add.at(raw, found, 1)
        if i in fit:
            np.add.at(target, found, 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    noise = lambda i: -math.log(-math.log(((hashed(i, quality.SEED) >> 11) + 0.5) * 2.0**-53))
    key = {i: round(float(ratio[found].sum()), 6) + noise(i) for i, found in grams.items()}
    loss = lambda c: 10 * sum(key[i] < c for i in held_out) + sum(key[i] >= c for i in poor)
    cut = min((key[i] for i in held_out), key=lambda c: (loss(c), c))
    assert {r["doc_id"] for r in rows} == {i for i in key if key[i] >= cut - 1e-9}
    for r in rows:
        assert abs(r["gumbel_key"] - key[r["doc_id"]]) < 1e-3 and r["n_grams"] == len(grams[r["doc_id"]])


def test_the_cut_of_least_cost():
    assert quality.best_cut([], [1.0]) is None and quality.best_cut([3.0, 1.0], []) == 1.0
    assert quality.best_cut([5.0, 4.0, -9.0], [-3.0] * 11) == 4.0 and quality.best_cut([5.0, 4.0, -9.0], [-3.0] * 9) == -9.0


@pytest.mark.parametrize("k", [0, 1, 7, 99, 250, 300, 500])
def test_top_k(spark, k):
    rng = random.Random(k)
    keys = [rng.gauss(0, 1) * 10 ** rng.randint(-3, 6) for _ in range(250)] + [5.0] * 50
    scored = spark.createDataFrame([(i, x) for i, x in enumerate(keys)], "doc_id long, gumbel_key double")
    got = sorted(r["gumbel_key"] for r in quality.gumbel_top_k(scored, k).collect())
    cut = sorted(keys, reverse=True)[min(k, 300) - 1] if k else math.inf
    assert got == sorted(x for x in keys if x >= cut)


def test_without_labels_everything_stays(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None), (1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.resample(docs, labels).count() == 3
    assert quality.resample(docs.where("false"), labels).count() == 0


# --- decontamination -------------------------------------------------------


def tile_brute(doc, item, least):
    """Words of item under greedy tiles, by comparing every pair of places."""
    used_doc, used_item, covered = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for t in range(len(item)):
            for p in range(len(doc)):
                n = 0
                while t + n < len(item) and p + n < len(doc) and item[t + n] == doc[p + n] and not used_doc[p + n] and not used_item[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, t, p)
        n, t, p = best
        if n < least:
            return covered
        used_item[t : t + n] = [True] * n
        used_doc[p : p + n] = [True] * n
        covered += n


@pytest.mark.parametrize("coverage, seed_words", [(0.8, 5), (0.5, 3), (0.9, 1)])
def test_tiling_by_brute_force(spark, monkeypatch, coverage, seed_words):
    rng = random.Random(seed_words)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klm")
    items = [(k, " ".join(word() for _ in range(rng.randint(1, 30)))) for k in range(14)] + [(14, None), (15, ""), (3, "aK bl"), (None, "Al am bl bm cl cm")]
    docs = []
    for i in range(30):
        words = [word() for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.7:
            chosen = rng.choice(items[:14])[1].upper().split()
            cut = rng.randint(0, len(chosen))
            chosen = chosen[cut:] + chosen[:cut] if rng.random() < 0.5 else chosen[: max(1, len(chosen) - rng.randint(0, 3))]
            at = rng.randint(0, len(words))
            words[at:at] = chosen
        docs.append((i, " ".join(words)))
    docs += [(30, None), (30, ""), (31, docs[0][1]), (None, items[0][1] + " x"), (32, "al " * 400)]
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 5)
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(df, bench, coverage, seed_words).collect()
    got = sorted([(r["doc_id"], r["item_id"], r["n_words"], r["n_covered"]) for r in found], key=repr)
    want = []
    for i, t in docs:
        for k, u in items:
            doc, item = (t or "").lower().split(), (u or "").lower().split()
            if item:
                n = tile_brute(doc, item, min(seed_words, len(item)))
                if n >= coverage * len(item):
                    want.append((i, k, len(item), n))
    assert got == sorted(want, key=repr) and got
    bad = {(i, t) for i, t in docs for j, k, *_ in want if i == j}
    clean = decontaminate.clean_documents(df, bench, coverage, seed_words)
    assert clean.columns == df.columns
    dirty_texts = {t for i, t in docs if any(tile_brute((t or "").lower().split(), u.lower().split(), min(seed_words, len(u.split()))) >= coverage * len(u.split()) for _, u in items if u)}
    assert sorted([(r["doc_id"], r["text"]) for r in clean.collect()], key=repr) == sorted([d for d in docs if d[1] not in dirty_texts], key=repr) and bad


def test_reordered_passage_is_caught_and_empty_tables(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    moved = "seven eight nine ten eleven twelve and then one two three four five six"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, moved), (2, "one three five seven nine eleven two four")], "doc_id long, text string")
    (row,) = decontaminate.contaminated(docs, bench).collect()
    assert (row["doc_id"], row["n_tiles"], row["n_covered"]) == (1, 2, 12)
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0
    assert decontaminate.clean_documents(docs, bench.where("false")).count() == 2
    assert decontaminate.contaminated(docs.where("false"), bench).count() == 0


# --- personal data ---------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), m.end(), 0) for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), m.end(), 2) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def texts():
    rng = random.Random(8)
    pieces = ["a@b.c", "@", "x.y+z@mail-1.example.com", "1.2.3.4", "256.1.1.1", "0001.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 555-1234", "+", "+44 20 7946 0958", "12 ", "é", "٣", " ", ".", "-", "a@b@c.d", "9" * 16, "\n"]
    return ["".join(rng.choice(pieces) + rng.choice(["", " ", ""]) for _ in range(rng.randint(0, 12))) for _ in range(800)]


def test_tiles_of_repeated_words_take_little_memory():
    """4,000 repeated words and 50 such items: every seed of one meets every seed of the other."""
    tracemalloc.start()
    items = [(k, "again " * (40 + k)) for k in range(50)]
    found = list(decontaminate.Benchmark(items, 5, 0.8).search(decontaminate.Hasher(), pa.array(["again " * 4000, "once " * 3 + "again " * 45])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 << 20
    assert {(row, k) for row, k, *_ in found} == {(0, k) for k in range(50)} | {(1, k) for k in range(50) if 45 >= 0.8 * (40 + k)}
    assert all(tiles == [(0 if row == 0 else 3, 0, min(n, 45 if row else n))] for row, _, n, _, tiles in found)


def test_words_made_to_collide_in_sums():
    word = "a"
    while len(word) < 8192:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    for n in (512, 1024, 2048, 4096, 8192):
        test = decontaminate.Benchmark([(1, f"v w x y {word[:n]}")], 5, 0.8)
        found = [list(test.search(decontaminate.Hasher(), pa.array([f"v w x y {w[:n]} z"]))) for w in (word, other)]
        assert len(found[0]) == 1 and found[1] == []


def test_base_spans_by_the_plain_patterns():
    for t in texts():
        assert pii.base_spans(t) == plain_spans(t), t


def test_base_spans_of_very_long_runs():
    for t in ("1" * 200000, "a" * 200000 + "@", "1." * 100000, "+1" * 50000, "@" * 100000, "1 " * 50000):
        pii.base_spans(t)


def test_regions_are_the_runs_of_words_with_digits():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("ab1@ \t\n.-") for _ in range(rng.randint(0, 25)))
        plain = re.finditer(r"\S*[0-9@]\S*(?:[ \t]{1,2}\S*[0-9@]\S*)*", text)
        assert [m.span() for m in pii._REGION.finditer(text)] == [m.span() for m in plain]


def test_a_very_long_word_without_digits():
    assert list(pii.regions("x" * 2_000_000)) == []


def test_spans_that_touch_base_spans_are_not_added():
    rng = random.Random(6)

    class Chosen:
        def decode(self, region):
            return [(b, e, 3) for b, e in ((rng.randint(0, 30), rng.randint(31, 60)), (rng.randint(0, 50), 0)) if b < e]

    for _ in range(500):
        base = sorted({(b := rng.randint(0, 55), b + rng.randint(1, 6), rng.randint(0, 3)) for _ in range(rng.randint(0, 5))})
        state = rng.getstate()
        wanted = [s for s in Chosen().decode(None) if not any(x < s[1] and s[0] < y for x, y, _ in base)]
        rng.setstate(state)
        found = pii.all_spans("1" + "x" * 60, base, Chosen())
        assert sorted(found) == sorted(base + wanted)


def test_field_on_held_out_sentences():
    field = pii.trained()
    right = found = there = 0
    for text, spans in pii.training_sentences(200, 12345):
        got = {s for region in pii.regions(text) for s in field.decode(region)}
        right, found, there = right + len(got & set(spans)), found + len(got), there + len(spans)
    assert right >= 0.97 * found and right >= 0.97 * there


def test_decoding_by_all_segmentations():
    """The dynamic program finds the best of all segmentations of short regions."""
    field = pii.trained()

    def best(region, scores, out, at):
        n = len(region.classes)
        if at == n:
            return 0.0
        options = [out[at] + best(region, scores, out, at + 1)]
        options += [s + best(region, scores, out, j) for i, j, s in scores if i == at]
        return max(options)

    for text, _ in pii.training_sentences(60, 777):
        for region in pii.regions(text):
            if len(region.classes) > 12:
                continue
            scores = [(i, j, float(field.weights[ids].sum(axis=0).max())) for i, j, ids in field.lattice(region)]
            out = field.outside[field.outside_ids(region)]
            index = {(b, e): (i, j) for i, j, _ in scores for b, e in [(region.spans[i][0], region.spans[j - 1][1])]}
            chosen, total, at = [index[b, e] for b, e, _ in field.decode(region)], 0.0, 0
            lookup = {(i, j): s for i, j, s in scores}
            covered = set()
            for i, j in chosen:
                total += lookup[i, j]
                covered |= set(range(i, j))
            total += sum(out[k] for k in range(len(region.classes)) if k not in covered)
            assert abs(total - best(region, scores, out, 0)) < 1e-9


def test_personal_data_of_documents(spark):
    docs = [(i, t) for i, t in enumerate(texts()[:200])] + [(1000, None), (None, "a@b.c"), (1001, ""), (2005, "dup 1.2.3.4"), (2005, "dup 1.2.3.4")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, spans string").repartition(3)
    got = pii.find_personal_data(df).collect()
    assert len(got) == len(docs)
    want = {}
    for i, t in docs:
        base = plain_spans(t or "")
        want[i] = ([sum(k == x for *_, k in base) for x in range(4)], pii.joined(base))
    for r in got:
        counts, base = want[r["doc_id"]]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == counts
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
    assert pii.find_personal_data(df.where("false")).count() == 0


def test_rows_without_an_id_have_the_noise_of_their_text(spark):
    docs = spark.createDataFrame([(None, f"text {i % 40} of it") for i in range(60)] + [(5, "a"), (5, "b")], "doc_id long, text string")
    rows = quality.log_weights(docs, np.zeros(100)).collect()
    noise = {r.text: r.gumbel_key for r in rows if r.doc_id is None}
    assert len(set(noise.values())) == 40 and all(r.gumbel_key == noise[r.text] for r in rows if r.doc_id is None)
    assert len({r.gumbel_key for r in rows if r.doc_id == 5}) == 1
