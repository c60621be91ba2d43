"""The stages on the smallest tables: what each keeps, against brute force."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm import decontaminate, mixing, quality
from tessera.llm.common import written

from .test_jaccard import shingles


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small).cache()
        kept[name] = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        assert len(kept[name]) == docs.count()
        if name != "sharding":
            assert docs.columns == columns
    classified, deduped, clean, mixed, sharded = kept.values()
    labels = spark.read.parquet(f"{small}/labels.parquet")
    good = {r["doc_id"] for r in labels.where("quality = 1 and toxic = 0").collect()}
    assert len(good & set(classified)) >= 0.98 * len(good) and len(classified) < 200
    sets = {i: shingles(t, 5) for i, t in classified.items()}
    left = list(deduped)
    assert all(100 * len(sets[a] & sets[b]) < 80 * len(sets[a] | sets[b]) for k, a in enumerate(left) for b in left[:k])
    for i in set(classified) - set(deduped):
        assert any(100 * len(sets[i] & s) >= 80 * len(sets[i] | s) for j, s in sets.items() if j != i)
    items = [r["text"].lower().split() for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    held = lambda t: any(" ".join(item) in " ".join(t.lower().split()) for item in items)
    assert not any(held(t) for t in clean.values())
    assert all(i in clean for i, t in deduped.items() if not any(" ".join(x[k : k + 5]) in " ".join(t.lower().split()) for x in items for k in range(len(x) - 4)))
    assert clean == mixed == sharded
    shards = docs.groupBy("shard").agg({"slot": "max", "doc_id": "count"}).collect()
    assert all(r["max(slot)"] + 1 == r["count(doc_id)"] for r in shards)


def test_odd_documents_go_through(spark, small):
    """Ids without a label: the classifier has nothing to reject by, of equal rows one stays, the rest goes through with its further columns."""
    one, two = 10**9 + 1, 10**9 + 2
    rows = [(None, None, None, None, None), (one, "", "en", "a", 0), (one, "same text " * 9, "en", "a", 5), (one, "same text " * 9, "en", "a", 5), (two, "w " * 90000, None, None, None)]
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, shard string, n_grams int, mix_slot string")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small).cache()
        assert set(columns) <= set(docs.columns) and (docs.columns == columns or name == "sharding")
    got = docs.collect()
    assert sorted([(r["doc_id"], (r["text"] or "")[:4]) for r in got], key=repr) == sorted([(None, ""), (one, ""), (one, "same"), (two, "w w ")], key=repr)
    assert {(r["n_grams"], r["mix_slot"]) for r in got} == {(1, "y")}
    empty = spark.read.parquet(f"{small}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, small)
    assert empty.count() == 0


def test_run_is_the_stages(spark, small):
    got = corpus_pipeline.run(spark, small)
    assert got.count() > 0 and "slot" in got.columns
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
    assert quality.LABELLED == 20_000 and decontaminate.COVERAGE == 0.8


def test_shards_are_read_in_the_order_of_the_mix(spark, small):
    """From written tables, as in run(), and from the rows themselves; without the mixing stage the slots are others."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    turn = {r["doc_id"]: (r["mix_slot"], r["mix_seq"]) for r in mixing.mix_sources(docs).collect()}
    (_, mix), (_, shard) = corpus_pipeline.STAGES[-2:]
    mixed = mix(spark, docs, small)
    found = []
    for rows in (mixed, written(mixed), docs):
        slots = {r["doc_id"]: (r["shard"], r["slot"]) for r in shard(spark, rows, small).collect()}
        shards = {}
        for i, (s, _) in sorted(slots.items(), key=lambda x: x[1]):
            shards.setdefault(s, []).append(turn[i])
        assert sum(map(len, shards.values())) == len(turn)
        found.append((slots, all(x == sorted(x) for x in shards.values())))
        assert not set(mixing.COLUMNS) & set(shard(spark, rows, small).columns)
    assert found[0] == found[1] and found[0][1]
    assert not found[2][1] and found[2][0] != found[0][0] and {i: s for i, (s, _) in found[2][0].items()} == {i: s for i, (s, _) in found[0][0].items()}
