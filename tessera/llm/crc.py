"""Importance resampling towards a target text, over features that are CRCs.

A feature is a run of consecutive words joined by one space; its bucket is the CRC-32 of
its bytes modulo the number of buckets. The strings of runs are never made: each word's CRC is
computed once, and the CRC of a run follows from those of its words. A CRC is linear over
GF(2), so appending n bytes to a text multiplies its CRC by the n-th power of one 32 x 32
bit matrix, and what was appended is added (exclusive or). The powers for n = 1, 2, 4 ... are kept as
tables by byte, and a length takes those of its binary digits.

Words are the maximal runs of ASCII letters and digits and of all characters beyond
ASCII; A-Z are lower-cased, nothing else is.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ranks
from .common import written
from .text import Words, blocks

COLUMNS = ["n_features", "weight", "score", "rank"]
BUCKETS = 10_000
#: Runs of SHORTEST to LONGEST words are features.
SHORTEST = LONGEST = 1
#: Documents with fewer words are never drawn; of the others PERCENT in 100 are.
LEAST_WORDS, PERCENT = 20, 10
SEED = 2024
_POLYNOMIAL = 0xEDB88320
#: Longer words are given to zlib one by one.
_SHORT = 64


def _byte_steps() -> np.ndarray:
    """The effect of one byte on a CRC register: eight shifts, each adding the polynomial for the bit that leaves."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = (step >> np.uint32(1)) ^ (np.uint32(_POLYNOMIAL) * (step & np.uint32(1)))
    return step


class Shifts:
    """Multiplication of CRCs by the matrices of appending 1, 2, 4 ... bytes.

    A matrix is kept as four tables of 256: what each value of each byte of a CRC becomes.
    """

    def __init__(self) -> None:
        step = _byte_steps()
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        #: what the 32 single bits become when one zero byte is appended
        columns = step[bits & np.uint32(255)] ^ (bits >> np.uint32(8))
        self.columns, self.tables = [columns], [self._table(columns)]

    @staticmethod
    def _table(columns: np.ndarray) -> np.ndarray:
        out = np.zeros((4, 256), dtype=np.uint32)
        values = np.arange(256)
        for byte in range(4):
            for bit in range(8):
                out[byte] ^= np.where(values >> bit & 1, columns[8 * byte + bit], np.uint32(0)).astype(np.uint32)
        return out

    @staticmethod
    def _times(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
        low = np.uint32(255)
        return table[0][crc & low] ^ table[1][crc >> np.uint32(8) & low] ^ table[2][crc >> np.uint32(16) & low] ^ table[3][crc >> np.uint32(24)]

    def appended(self, crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The part that ``crc`` has in the CRC of its text followed by so many bytes."""
        out, rest, k = crc.copy(), lengths.astype(np.int64), 0
        while rest.any():
            while k >= len(self.tables):  # the square of the last matrix
                self.columns.append(self._times(self.tables[-1], self.columns[-1]))
                self.tables.append(self._table(self.columns[-1]))
            odd = np.flatnonzero(rest & 1)
            out[odd] = self._times(self.tables[k], out[odd])
            rest, k = rest >> 1, k + 1
        return out


class Features:
    """CRCs of the words of rows of text and of runs of them."""

    def __init__(self) -> None:
        self.step, self.shifts = _byte_steps(), Shifts()
        self.classes = np.zeros(256, dtype=np.uint8)
        self.classes[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[0x41:0x5B] += 0x20
        self.space = np.uint32(zlib.crc32(b" "))

    def words(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(CRC of each word, its length, first word of each row and one entry more)."""
        w = Words(self.lower[data], rows, self.classes)
        sizes = w.ends - w.starts
        order = np.argsort(-sizes, kind="stable")
        long = int(np.searchsorted(-sizes[order], -_SHORT, side="left"))
        out = np.empty(len(sizes), dtype=np.uint32)
        for i in order[:long].tolist():
            out[i] = zlib.crc32(w.data[w.starts[i] : w.ends[i]])
        order = order[long:]
        starts, left = w.starts[order], sizes[order]
        crc = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
        for k in range(int(left[0]) if len(left) else 0):
            n = int(np.searchsorted(-left, -k, side="left"))  # words of more than k bytes come first
            crc[:n] = self.step[(crc[:n] ^ w.data[starts[:n] + k]) & np.uint32(255)] ^ (crc[:n] >> np.uint32(8))
        out[order] = crc ^ np.uint32(0xFFFFFFFF)
        return out, sizes, w.of_row

    def runs(self, crc: np.ndarray, sizes: np.ndarray, of_row: np.ndarray, n: int, before: np.ndarray) -> np.ndarray:
        """CRCs of the runs of n words from each position, out of ``before``, those of n - 1 words (rows are not looked at)."""
        if n == 1:
            return crc
        count = max(0, len(crc) - n + 1)
        spaced = self.shifts.appended(before[:count], np.ones(count)) ^ self.space
        return self.shifts.appended(spaced, sizes[n - 1 :]) ^ crc[n - 1 :]

    def buckets(self, data: np.ndarray, rows: np.ndarray, shortest: int, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, row) of every feature, and the words of each row."""
        crc, sizes, of_row = self.words(data, rows)
        n_words = np.diff(of_row)
        row_of = np.repeat(np.arange(len(n_words)), n_words)
        left = np.repeat(of_row[1:], n_words) - np.arange(len(crc))  # words from here to the end of the row
        found, of, runs = [], [], crc
        for n in range(1, longest + 1):
            runs = self.runs(crc, sizes, of_row, n, runs)
            if n >= shortest:
                at = np.flatnonzero(left[: len(runs)] >= n)
                found.append(runs[at] % np.uint32(buckets))
                of.append(row_of[at])
        return np.concatenate(found).astype(np.int64), np.concatenate(of), n_words


def bucket_counts(texts: DataFrame, shortest: int, longest: int, buckets: int) -> DataFrame:
    """(bucket, n): features of all texts; a task sends one row for each bucket that it has met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, data, rows in blocks(batch.column(0)):
                total += np.bincount(features.buckets(data, rows, shortest, longest, buckets)[0], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(texts: DataFrame, target: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket floor(1000 ln) of how much more of the target falls into it than of the texts, one added to each bucket.

    Counts are of all rows; at most ``buckets`` sums of each table come to the driver.
    """

    def counts(table: DataFrame) -> list[int]:
        found = {r["bucket"]: r["n"] for r in bucket_counts(table, shortest, longest, buckets).collect()}
        return [found.get(b, 0) for b in range(buckets)]

    s, t = counts(texts), counts(target)
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((y + 1) * all_s / ((x + 1) * all_t))) for x, y in zip(s, t, strict=True)], dtype=np.int64)


def noise(key: str) -> int:
    """Gumbel noise in thousandths, from the first 32 bits of the key's SHA-256."""
    h = int(sha256(key.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, keep: list[str], shortest: int, longest: int, seed: int) -> DataFrame:
    """The kept columns of docs with __words, n_features, weight and score."""
    spark, buckets = docs.sparkSession, len(gain)
    shared = spark.sparkContext.broadcast(gain)  # a plain array of one number for each bucket
    names = [f"c{i}" for i in range(len(keep))]
    own = [docs.schema[c] for c in keep]
    new = [T.StructField(c, T.LongType()) for c in ("__words", "n_features", "weight", "score")]
    schema = T.StructType([*[T.StructField(n, f.dataType) for n, f in zip(names, own, strict=True)], *new])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, values = Features(), shared.value
        for batch in batches:
            text, ids = batch.column(0), batch.column(1).to_pylist()
            for lo, hi, data, rows in blocks(text):
                bucket, of, n_words = features.buckets(data, rows, shortest, longest, buckets)
                n = np.bincount(of, minlength=hi - lo)
                total = np.zeros(hi - lo, dtype=np.int64)
                np.add.at(total, of, values[bucket])
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                keys = [f"{seed}:{i}" if i is not None else f"{seed}::{sha256(data[rows[k] : rows[k + 1]]).hexdigest()}" for k, i in enumerate(ids[lo:hi])]
                part = batch.slice(lo, hi - lo)
                made = [pa.array(x) for x in (n_words, n, weight, weight + np.array([noise(k) for k in keys], dtype=np.int64))]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(2, part.num_columns)], *made], names=[*names, "__words", *COLUMNS[:3]])

    rows = docs.select(F.col("text"), F.col("doc_id"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    found = rows.mapInArrow(score, schema)
    return found.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "__words", *COLUMNS[:3])


def resample_towards(
    docs: DataFrame, target: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, keep: list[str] | None = None
) -> DataFrame:
    """docs (doc_id, text and others; ``keep`` of them, doc_id included, all by default) with n_features, weight, score and rank.

    weight is the mean gain of a document's features, rounded down, score adds Gumbel
    noise of its doc_id, so that the ``percent`` highest scores of the documents with ``least_words`` words or more are a draw without
    replacement in proportion to the weights; rank is 1, 2, 3 ... in that order (ties: smaller doc_id, null first) and null for the rest.

    Null and empty texts have no features and the weight 0. Rows that share a doc_id share their noise, those without one have that of their text;
    rows alike are ranked in any order. Texts are taken in blocks of rows, a very long one is a block by itself. Without a target text every document has a weight near 0
    by the shares of its words in docs; empty tables give empty ones. Columns of docs named like a new one are replaced.

    The cut is found from the number of documents with each score. Scores are whole numbers in a range that the logarithms
    bound: fewer than 200,000 for tables of any size. Ranks come from ranges of the order, not from one task.
    """
    taken = {*COLUMNS, "__words"}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]
    rows = written(scored(docs, gains(docs, target, shortest, longest, buckets), keep, shortest, longest, seed))
    able = F.col("__words") >= least_words
    histogram = sorted(((r["score"], r["n"]) for r in rows.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    k, cut, above = percent * sum(n for _, n in histogram) // 100, None, 0
    for score, n in histogram:
        if above >= k:
            break
        cut, above = score, above + n
    if cut is None:
        return rows.drop("__words").withColumn("rank", F.lit(None).cast("long"))
    drawn = able & (F.col("score") >= cut)
    first = ranks.numbered(rows.where(drawn).drop("__words"), [], [F.col("score").desc(), F.col("doc_id").asc_nulls_first()], "rank")
    rest = rows.where(~drawn).drop("__words").withColumn("rank", F.lit(None).cast("long"))
    return first.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank"))).unionByName(rest)
