"""Substring dedup by level-wise doubling of repeated windows.

A window is ``window`` consecutive words of one document; it is removed if the
same words start anywhere else. Levels of n, 2n, 4n ... words narrow the windows
down: at a level each window stands for itself by the least hash of its n-grams of
that length (equal windows have equal ones, and neighbouring windows mostly
share theirs, so about 2 in window - n rows are moved for each word). Only windows whose
n-gram is repeated at one level are extended to twice the length; the last level compares
the whole windows that are left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .text import Hasher, Words, blocks, inside, mix

WINDOW = 35
FIRST = 9
#: Windows in one row of the last level; their marks fit a long.
RUN = 32
#: Windows that a task holds before it gives the kinds of runs among them.
HELD = 1 << 20

TEXT = ["doc_id", "text", "k1", "k2"]


def levels(window: int, first: int) -> list[int]:
    """Lengths below the window, each twice the one before."""
    found = []
    n = min(first, window)
    while n < window:
        found.append(n)
        n *= 2
    return found or [window]


def sliding(values: np.ndarray, width: int, of=np.minimum) -> np.ndarray:
    """The least (or, with np.maximum, the greatest) of each ``width`` neighbours."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = of(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


class Windows:
    """The windows of a block of rows: where they start, their row, and their n-gram at a level."""

    def __init__(self, hasher: Hasher, data: np.ndarray, rows: np.ndarray, window: int):
        self.hasher, self.window = hasher, window
        self.split: Words = hasher.split(data, rows)
        self.words = hasher.word_hashes(self.split)
        count = max(0, len(self.words) - window + 1)
        self.ok = inside(self.split.of_row, window, count)

    def least(self, n: int) -> np.ndarray:
        return sliding(self.hasher.ngrams(self.words, n), self.window - n + 1)

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.split.of_row, at, side="right") - 1

    def seeds(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of each place where some window's least n-gram stands."""
        if not self.ok.any():
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        grams = self.hasher.ngrams(self.words, n)
        width = self.window - n + 1
        most = np.where(self.ok, sliding(grams, width), np.uint64(0))
        pad = np.zeros(width - 1, dtype=np.uint64)
        over = sliding(np.concatenate([pad, most, pad]), width, np.maximum)
        at = np.flatnonzero((over == grams) & (grams > 0))
        return self.row_of(at), grams[at]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text, and the two values by which rows with equal ids and texts are the same."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("k1"),
        F.xxhash64(text).alias("k2"),
    )


class Left:
    """The n-grams that a batch's rows have left from the level before, by row."""

    def __init__(self, column: pa.Array):
        self.flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        self.sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0), dtype=np.int64)
        self.ends = np.append(0, np.cumsum(self.sizes))

    def keep(self, w: Windows, lo: int, hi: int, n: int) -> None:
        """Keep only the windows of rows lo to hi whose least n-gram is left."""
        if not w.ok.any():
            return
        mark = np.uint64(0x9E3779B97F4A7C15)
        of = np.repeat(np.arange(hi - lo, dtype=np.uint64), self.sizes[lo:hi])
        at = np.flatnonzero(w.ok)
        keep = np.isin(w.least(n)[at] ^ (w.row_of(at).astype(np.uint64) * mark), self.flat[self.ends[lo] : self.ends[hi]] ^ (of * mark))
        w.ok[at[~keep]] = False


def level(rows: DataFrame, window: int, n: int, before: int | None) -> DataFrame:
    """(k1, k2, left): the repeated n-grams of n words that stand for windows of a row.

    At the first level all windows are looked at, at a later one those that are left from ``before``.
    """
    names = ["gram", "k1", "k2", "places"]

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            k1, k2 = (np.asarray(batch.column(i)) for i in (2, 3))
            left = Left(batch.column(4)) if before else None
            for lo, hi, data, offsets in blocks(batch.column(1)):
                w = Windows(hasher, data, offsets, window)
                if left:
                    left.keep(w, lo, hi, before)
                row, gram = w.seeds(n)
                order = np.lexsort((gram, row))
                row, gram = row[order], gram[order]
                first = np.ones(len(row), dtype=bool)
                first[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
                at = np.flatnonzero(first)
                if len(at):
                    places = np.diff(np.append(at, len(row))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(gram[at].view(np.int64)), pa.array(k1[lo + row[at]]), pa.array(k2[lo + row[at]]), pa.array(places)], names=names)

    seeds = rows.mapInArrow(run, "gram long, k1 long, k2 long, places int")
    # a table, so that both sides of the join are plain shuffles, of which Spark splits large partitions
    again = written(seeds.groupBy("gram").agg(F.sum("places").alias("n")).where("n > 1").select("gram"))
    return seeds.join(again, "gram", "left_semi").groupBy("k1", "k2").agg(F.collect_set("gram").alias("left"))


class Runs:
    """Runs of neighbouring windows that are left and share their least n-gram (their core)."""

    def __init__(self, w: Windows, n: int):
        at = np.flatnonzero(w.ok)
        row, core = w.row_of(at), w.least(n)[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1]) | (core[1:] != core[:-1])
        begin = np.flatnonzero(new)
        inner = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
        self.begin = begin = np.flatnonzero(inner % RUN == 0)
        self.lengths = np.diff(np.append(begin, len(at)))
        self.row, self.core = row[begin], core[begin]
        self.start = (at[begin] - w.split.of_row[row[begin]]).astype(np.int32)
        self.hashes = w.hasher.ngrams(w.words, w.window)[at]
        place = (np.arange(len(at)) - np.repeat(begin, self.lengths)).astype(np.uint64)
        #: one hash for all windows of a run
        self.whole = np.add.reduceat(mix(self.hashes + place * np.uint64(0x9E3779B97F4A7C15)), begin) + self.lengths.astype(np.uint64)


def runs_of(batch: pa.RecordBatch, hasher: Hasher, window: int, n: int, before: int) -> Iterator[tuple[int, Runs]]:
    left = Left(batch.column(4))
    for lo, hi, data, offsets in blocks(batch.column(1)):
        if left.ends[hi] > left.ends[lo]:
            w = Windows(hasher, data, offsets, window)
            left.keep(w, lo, hi, before)
            if w.ok.any():
                yield lo, Runs(w, n)


def kinds_of_runs(rows: DataFrame, window: int, n: int, before: int) -> DataFrame:
    """(core, run, copies, twice, hashes): each kind of run that a task has, once, with the hashes of its windows.

    twice says that some windows of the run are equal.
    """
    names = ["core", "run", "copies", "twice", "hashes"]

    def batch_of(parts: list[Runs]) -> pa.RecordBatch:
        core, whole, lengths, hashes = (np.concatenate([getattr(r, k) for r in parts]) for k in ("core", "whole", "lengths", "hashes"))
        starts = np.cumsum(lengths) - lengths
        order = np.lexsort((whole, core))
        first = np.ones(len(order), dtype=bool)
        first[1:] = (core[order][1:] != core[order][:-1]) | (whole[order][1:] != whole[order][:-1])
        at = np.flatnonzero(first)
        copies = np.diff(np.append(at, len(order))).astype(np.int32)
        kept = order[at]
        sizes = lengths[kept]
        of_run = np.repeat(np.arange(len(kept)), sizes)
        inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        hashes = hashes[starts[kept][of_run] + inner]
        by_hash = np.lexsort((hashes, of_run))
        same = (hashes[by_hash][1:] == hashes[by_hash][:-1]) & (of_run[1:] == of_run[:-1])
        twice = np.bincount(of_run[1:][same], minlength=len(kept)) > 0
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(hashes.view(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(core[kept].view(np.int64)), pa.array(whole[kept].view(np.int64)), pa.array(copies), pa.array(twice), lists], names=names)

    def run(batches):
        hasher, parts, held = Hasher(), [], 0
        for batch in batches:
            for _, runs in runs_of(batch, hasher, window, n, before):
                parts.append(runs)
                held += len(runs.hashes)
                if held > HELD:
                    yield batch_of(parts)
                    parts, held = [], 0
        if parts:
            yield batch_of(parts)

    return rows.mapInArrow(run, "core long, run long, copies int, twice boolean, hashes array<long>")


def places_of_runs(rows: DataFrame, window: int, n: int, before: int) -> DataFrame:
    """(core, run, k1, k2, start): where each run is."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            k1, k2 = (np.asarray(batch.column(i)) for i in (2, 3))
            for lo, r in runs_of(batch, hasher, window, n, before):
                columns = [pa.array(r.core.view(np.int64)), pa.array(r.whole.view(np.int64)), pa.array(k1[lo + r.row]), pa.array(k2[lo + r.row]), pa.array(r.start)]
                yield pa.RecordBatch.from_arrays(columns, names=["core", "run", "k1", "k2", "start"])

    return rows.mapInArrow(run, "core long, run long, k1 long, k2 long, start int")


def repeated_runs(kinds: DataFrame) -> DataFrame:
    """(core, run, marks): for each run of windows, a bit for each window that is repeated.

    Runs that are equal as a whole are counted first. A core with one kind of
    run is settled by that; only the others are compared window by window.
    """
    counts = kinds.groupBy("core", "run").agg(F.sum("copies").alias("copies"), F.max(F.size("hashes")).alias("windows"), F.max("twice").alias("twice"))
    cores = counts.groupBy("core").agg(F.sum("copies").alias("all"), F.count(F.lit(1)).alias("kinds"), F.max("twice").alias("any_twice"), F.min("run").alias("run"), F.max("windows").alias("windows"))
    # both parts below read all columns, so that they share one shuffle
    cores = cores.where("(all > 1 or any_twice) and run is not null and windows > 0").withColumn("settled", F.expr("kinds = 1 and all > 1"))
    whole = cores.where("settled").select("core", "run", F.expr("shiftleft(1L, windows) - 1").alias("marks"))
    mixed = kinds.select("core", "run", "hashes", "copies").join(cores.where("not settled"), "core", "left_semi")
    mixed = mixed.groupBy("core", "run", "hashes").agg(F.sum("copies").alias("copies"))
    each = mixed.select("core", "run", "copies", F.posexplode("hashes").alias("at", "hash"))
    again = each.groupBy("core", "hash").agg(F.sum("copies").alias("n")).where("n > 1").select("core", "hash")
    marks = each.join(again, ["core", "hash"], "left_semi").groupBy("core", "run").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("marks"))
    return whole.unionByName(marks)


def removed_words(docs: DataFrame, window: int = WINDOW, first: int = FIRST) -> DataFrame:
    """doc_id, text, k1, k2 and spans: [first window, bits of repeated windows from it] of each document.

    Rows with the same doc_id and text share their spans (each repeats the other). It is
    one plan, so that all steps that need the texts by document share one shuffle of them.
    """
    grams = levels(window, first)
    rows = keyed(docs)
    left, before = level(rows, window, grams[0], None), grams[0]
    for n in grams[1:-1]:
        left, before = level(rows.join(left, ["k1", "k2"], "left").select(*TEXT, "left"), window, n, before), n
    texts = rows.join(left, ["k1", "k2"], "left").select(*TEXT, "left")
    marks = repeated_runs(kinds_of_runs(texts, window, grams[-1], before))
    found = places_of_runs(texts, window, grams[-1], before).join(marks, ["core", "run"])
    spans = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "marks")).alias("spans"))
    return rows.join(spans, ["k1", "k2"], "left")


def kept_words(words: list[bytes], spans: list[dict] | None, window: int) -> list[bytes]:
    if not spans:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int32)
    for span in spans:
        bits = np.array([k for k in range(RUN) if span["marks"] >> k & 1], dtype=np.int64) + span["start"]
        np.add.at(edge, bits, 1)
        np.add.at(edge, bits + window, -1)
    gone = np.cumsum(edge)[: len(words)] > 0
    return [x for x, out in zip(words, gone.tolist()) if not out]


def dedup_substrings(docs: DataFrame, window: int = WINDOW, first: int = FIRST, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with keep_text, kept (the words left, joined by one space).

    Words are runs outside white space, unchanged. Null, empty and short texts
    lose nothing; a window that overlaps itself (repeated words) counts as
    repeated. Rows with null or repeated doc_ids are rows of their own. Further columns are left out.
    """
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if keep_text else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                n, gone, sha, kept = [], [], [], []
                for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    words = (text or "").encode("utf-8").split()
                    rest = kept_words(words, spans, window)
                    joined = b" ".join(rest)
                    n.append(len(words))
                    gone.append(len(words) - len(rest))
                    sha.append(hashlib.sha256(joined).hexdigest())
                    if keep_text:
                        kept.append(joined.decode("utf-8"))
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.string())] * keep_text, names=names)

    return removed_words(docs, window, first).select("doc_id", "text", "spans", "k1", "k2").mapInArrow(run, schema)
