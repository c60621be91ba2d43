"""Quality classification by importance resampling.

Two generative models of hashed uni- and bigrams, of the target text and of all
text, give each document the log of its importance weight: the sum of the log
ratios of its n-grams. Gumbel top-k then draws k documents without replacement in
proportion to the weights.

A few toxic words vanish in such a sum, so toxic text is told by its strongest
n-gram alone: of the labelled documents, how much more often toxic ones have it than
others, less two standard errors. Documents beyond a limit have the weight 0. The
limit is set on labelled documents that are held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import restored, written
from .text import Hasher, blocks, inside

COLUMNS = ["n_grams", "log_weight", "gumbel_key"]
BUCKETS = 10_000
#: At most so many labelled rows fit the target model and set k.
LABELLED = 20_000
#: A held-out target document that is left out counts as so many held-out documents of quality 0 that are drawn, when k is set.
COST_OF_MISSED = 10
#: Toxic text is told by n-grams with a log ratio (less its error) of TOXIC_LEAST or more.
TOXIC_LEAST = 1.0
#: At most this share of the held-out documents that aren't toxic is taken for toxic.
TOXIC_MISSED = 0.005
SEED = 17


def bucketed(hasher: Hasher, data: np.ndarray, rows: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every uni- and bigram of tokens: runs of letters and digits, runs of signs.

    An n-gram that says "the same run of letters or digits as one or two tokens before", whatever
    it is, has the last bucket for itself: words again and again are usual words otherwise.
    """
    tokens = hasher.tokens(data, rows)
    words = hasher.word_hashes(tokens)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(tokens.of_row))
    pairs = hasher.ngrams(words, 2)
    ok = inside(tokens.of_row, 2, len(pairs))
    again = np.zeros(len(words), dtype=bool)
    for back in (1, 2):
        again[back:] |= (words[back:] == words[:-back]) & (row[back:] == row[:-back])
    again &= hasher.token[data[tokens.starts]] == 1
    grams = (np.concatenate([words, pairs[ok]]) % np.uint64(buckets - 1)).astype(np.int64)
    return np.append(grams, np.full(again.sum(), buckets - 1)), np.concatenate([row, row[: len(pairs)][ok], row[again]])


def labelled_sample(labels: DataFrame, limit: int = LABELLED) -> tuple[list[int], list[int], list[int]]:
    """Of up to ``limit`` labelled documents, taken by a hash of doc_id: target documents (quality 1, not toxic) to fit, such held out to set k, and those of quality 0, which set k too.

    Rows with a null doc_id or quality are left out; a document with several
    labels is target text if all say so, and of quality 0 if one does.
    """
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    rows = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(good.cast("int")).alias("good"), F.min("quality").alias("quality"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()
    good = [r["doc_id"] for r in rows if r["good"]]
    return good[::2], good[1::2], [r["doc_id"] for r in rows if r["quality"] == 0]


def gram_models(docs: DataFrame, target: list[int], buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio of target to raw probability by bucket, with add-one smoothing; raw counts are over all documents.

    Each task sends a row for each bucket it has seen, the driver gets at most
    one for each bucket.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.array(sorted(target), dtype=np.int64))

    def run(batches):
        hasher, wanted = Hasher(), shared.value
        raw, good = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            is_good = np.isin(np.asarray(batch.column(0).fill_null(-1)), wanted) & ~np.asarray(batch.column(0).is_null())
            for lo, hi, data, rows in blocks(batch.column(1)):
                bucket, row = bucketed(hasher, data, rows, buckets)
                raw += np.bincount(bucket, minlength=buckets)
                good += np.bincount(bucket[is_good[lo:hi][row]], minlength=buckets)
        seen = np.flatnonzero(raw)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(raw[seen]), pa.array(good[seen])], names=["bucket", "raw", "good"])

    rows = texts(docs).mapInArrow(run, "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()
    counts = np.ones((2, buckets))
    for r in rows:
        counts[:, r["bucket"]] += r["raw"], r["good"]
    raw_share, target_share = counts / counts.sum(axis=1, keepdims=True)
    return np.log(target_share) - np.log(raw_share)


def toxic_grams(hasher: Hasher, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every uni- and bigram, with A to Z as a to z."""
    tokens = hasher.tokens(np.where((data >= 65) & (data <= 90), data | np.uint8(32), data), rows)
    words = hasher.word_hashes(tokens)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(tokens.of_row))
    pairs = hasher.ngrams(words, 2)
    ok = inside(tokens.of_row, 2, len(pairs))
    return np.concatenate([words, pairs[ok]]), np.concatenate([row, row[: len(pairs)][ok]])


class Evidence:
    """N-grams by their hash, with their evidence that a text is toxic."""

    def __init__(self, grams: np.ndarray, evidence: np.ndarray):
        order = np.argsort(grams)
        self.grams, self.evidence = grams[order], evidence[order]
        self.low = np.uint64((1 << 20) - 1)
        self.some = np.zeros(1 << 20, dtype=bool)
        self.some[(grams & self.low).astype(np.int64)] = True

    def strongest(self, hasher: Hasher, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The greatest evidence of the n-grams of each row, 0 at least."""
        gram, row = toxic_grams(hasher, data, rows)
        at = np.flatnonzero(self.some[(gram & self.low).astype(np.int64)])
        gram, row = gram[at], row[at]
        place = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        most = np.zeros(len(rows) - 1)
        np.maximum.at(most, row, np.where(self.grams[place] == gram, self.evidence[place], 0.0))
        return most


def toxic_sample(labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """(doc_id, toxic, held) of up to ``limit`` labelled documents by a hash of doc_id; toxic if any label says so, every second one of a kind is held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    rows = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    found, turn = [], [0, 0]
    for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect():
        found.append((r["doc_id"], r["toxic"], turn[r["toxic"]] % 2))
        turn[r["toxic"]] += 1
    return labels.sparkSession.createDataFrame(found, "doc_id long, toxic int, held int")


def toxic_model(docs: DataFrame, labels: DataFrame) -> tuple[Evidence, float] | None:
    """The evidence of n-grams and the limit from which on a document is toxic; None where labels tell nothing.

    Half of the labelled documents give the evidence, half the limit.
    """
    sample = toxic_sample(labels)
    known = written(texts(docs).join(F.broadcast(sample), "doc_id").select("text", "toxic", "held"))  # LABELLED documents at most
    sizes = {(r["held"], r["toxic"]): r["n"] for r in known.groupBy("held", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not all(sizes.get((0, toxic)) for toxic in (0, 1)):
        return None

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            toxic = np.asarray(batch.column(1)) == 1
            for lo, hi, data, rows in blocks(batch.column(0)):
                gram, row = toxic_grams(hasher, data, rows)
                order = np.lexsort((row, gram))
                gram, row = gram[order], row[order]
                once = np.ones(len(gram), dtype=bool)
                once[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
                gram, bad = gram[once], toxic[lo:hi][row[once]]
                seen, at = np.unique(gram, return_inverse=True)
                counts = [np.bincount(at, weights=x, minlength=len(seen)).astype(np.int64) for x in (bad, ~bad)]
                yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), *map(pa.array, counts)], names=["gram", "bad", "fine"])

    grams = known.where("held = 0").select("text", "toxic").mapInArrow(run, "gram long, bad long, fine long").groupBy("gram").agg(F.sum("bad").alias("bad"), F.sum("fine").alias("fine"))
    share = f"ln((bad + 0.5) / {sizes[0, 1] + 1}) - ln((fine + 0.5) / {sizes[0, 0] + 1})"
    told = grams.withColumn("evidence", F.expr(f"{share} - 2 * sqrt(1 / (bad + 0.5) + 1 / (fine + 0.5))")).where(F.col("evidence") >= TOXIC_LEAST).select("gram", "evidence").collect()
    if not told:
        return None
    evidence = Evidence(np.array([r["gram"] for r in told], dtype=np.int64).view(np.uint64), np.array([r["evidence"] for r in told]))
    shared = docs.sparkSession.sparkContext.broadcast(vars(evidence))

    def score(batches):
        hasher, told = Hasher(), restored(Evidence, shared.value)
        for batch in batches:
            for _, _, data, rows in blocks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(told.strongest(hasher, data, rows))], names=["most"])

    fine = sorted((r["most"] for r in known.where("held = 1 and toxic = 0").select("text").mapInArrow(score, "most double").collect()), reverse=True)
    over = fine[int(len(fine) * TOXIC_MISSED)] if fine else 0.0
    return evidence, max(TOXIC_LEAST, float(np.nextafter(over, np.inf)))


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def gumbel(*key: Column | str, seed: int = SEED) -> Column:
    """Standard Gumbel noise that depends on the key and the seed alone."""
    u = (F.shiftrightunsigned(F.xxhash64(*[F.col(k) if isinstance(k, str) else k for k in key], F.lit(seed)), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
    return -F.ln(-F.ln(u))


def log_weights(docs: DataFrame, ratio: np.ndarray, toxic: tuple[Evidence, float] | None = None) -> DataFrame:
    """All columns of docs with n_grams, log_weight and gumbel_key (log_weight and noise) added, without documents that ``toxic`` tells.

    A text without tokens has no n-grams and the weight 1 (log 0). Rows that share a doc_id
    share their noise, those without one that of their text. Very long texts are scored whole, in blocks of rows.
    """
    shared, buckets = docs.sparkSession.sparkContext.broadcast((ratio, toxic and (vars(toxic[0]), toxic[1]))), len(ratio)
    kept = docs.drop(*COLUMNS)
    where = kept.columns.index("text")
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def run(batches):
        hasher, (ratios, toxic) = Hasher(), shared.value
        told = toxic and restored(Evidence, toxic[0])
        for batch in batches:
            n, total, stays = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows), np.ones(batch.num_rows, dtype=bool)
            for lo, hi, data, rows in blocks(batch.column(where)):
                bucket, row = bucketed(hasher, data, rows, buckets)
                n[lo:hi] = np.bincount(row, minlength=hi - lo)
                total[lo:hi] = np.bincount(row, weights=ratios[bucket], minlength=hi - lo)
                if toxic:
                    stays[lo:hi] = told.strongest(hasher, data, rows) < toxic[1]
            scored = pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array(np.round(total, 6))], names=[*batch.schema.names, "n_grams", "log_weight"])
            yield scored if stays.all() else scored.filter(pa.array(stays))

    scored = kept.mapInArrow(run, f"{names}, n_grams long, log_weight double")
    # a row without an id has the noise of its text
    return scored.withColumn("gumbel_key", F.col("log_weight") + gumbel(F.coalesce(F.col("doc_id"), F.xxhash64("text"))))


def kth_largest(scored: DataFrame, key: str, k: int, bins: int = 4096) -> float | None:
    """The k-th largest value of ``key``, by histograms of ever narrower ranges (null keys don't count)."""
    values = scored.where(F.col(key).isNotNull()).select(F.col(key).alias("v"))
    ends = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if k <= 0 or not ends["n"]:
        return None
    if k >= ends["n"]:
        return ends["lo"]
    lo, hi = ends["lo"], ends["hi"]
    while hi > lo and (hi - lo) / bins > 0 and lo + (hi - lo) / bins > lo:
        width = (hi - lo) / bins
        b = F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1))
        counts = values.where(F.col("v").between(lo, hi)).groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        for r in sorted(counts, key=lambda r: -r["b"]):
            if k <= r["n"]:
                break
            k -= r["n"]
        if (r["lo"], r["hi"]) == (lo, hi):
            break
        lo, hi = r["lo"], r["hi"]
    return lo if hi == lo else values.where(F.col("v").between(lo, hi)).orderBy(F.desc("v")).limit(k).agg(F.min("v")).first()[0]


def gumbel_top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k rows of the largest gumbel_key; rows equal to the k-th one (repeated documents) are all kept."""
    cut = kth_largest(scored, "gumbel_key", k)
    return scored.where(F.lit(False)) if cut is None else scored.where(F.col("gumbel_key") >= F.lit(cut))


def best_cut(good: list[float], poor: list[float], cost: float = COST_OF_MISSED) -> float | None:
    """The key from which on documents are drawn: it makes cost x (good keys below it) + (poor keys from it on) least, the lowest of several; None without good keys."""
    good, poor = np.sort(good), np.sort(poor)
    if not len(good):
        return None
    cuts = good[np.append(True, good[1:] != good[:-1])]
    loss = cost * np.searchsorted(good, cuts) + len(poor) - np.searchsorted(poor, cuts)
    return float(cuts[int(loss.argmin())])


def sample_size(scored: DataFrame, held_out: list[int], poor: list[int]) -> int:
    """k: as many documents as reach best_cut() of the labelled ones; all, without held-out target documents. Only labelled keys come to the driver."""
    known = scored.sparkSession.createDataFrame([(i, 1) for i in held_out] + [(i, 0) for i in poor], "doc_id long, good int")
    rows = scored.join(F.broadcast(known), "doc_id").groupBy("doc_id", "good").agg(F.min("gumbel_key").alias("key")).collect()
    cut = best_cut([r["key"] for r in rows if r["good"]], [r["key"] for r in rows if not r["good"]])
    return scored.count() if cut is None else scored.where(F.col("gumbel_key") >= F.lit(cut)).count()


def resample(docs: DataFrame, labels: DataFrame, keep_columns: bool = False) -> DataFrame:
    """The documents that importance resampling keeps, with n_grams, log_weight and gumbel_key.

    With keep_columns all columns of docs are kept, else doc_id. Null and empty
    texts are neutral (weight 1); without labels everything is kept. Documents told
    as toxic have the weight 0 and are never drawn.
    """
    fit, held_out, poor = labelled_sample(labels)
    ratio = gram_models(docs, fit)
    scored = log_weights(docs if keep_columns else texts(docs), ratio, toxic_model(docs, labels))
    keys = written(scored.select(F.col("doc_id").cast("long").alias("doc_id"), "n_grams", "log_weight", "gumbel_key"))
    k = sample_size(keys, held_out, poor)
    if not keep_columns:
        return gumbel_top_k(keys, k)
    cut = kth_largest(keys, "gumbel_key", k)
    return scored.where(F.lit(False)) if cut is None else scored.where(F.col("gumbel_key") >= F.lit(cut))
