"""Benchmark decontamination by greedy string tiling.

Documents and test items meet in the shared n-grams that seed a match (found by
rolling Karp-Rabin hashes). For such a pair the longest match between unmarked
words is marked again and again, until none has the least length. The share of
the item's words under tiles is its coverage, whatever their order is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import restored
from .text import Hasher, blocks, inside

SEED_WORDS = 5
COVERAGE = 0.8
BLOCK_BYTES = 8 << 20
BLOCK_ITEMS = 50_000


def matching_runs(doc: np.ndarray, item: np.ndarray) -> np.ndarray:
    """(start in doc, start in item, length) of the longest runs in which seeds of doc and item agree.

    The item is walked seed by seed with the runs that are alive, so memory is in proportion to the document
    however often words are repeated.
    """
    order = np.argsort(doc, kind="stable")
    found = doc[order]
    ended, at, since = [], np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for t in range(len(item) + 1):
        lo, hi = (np.searchsorted(found, item[t], side) for side in ("left", "right")) if t < len(item) else (0, 0)
        here = order[lo:hi]
        if len(at):
            place = np.minimum(np.searchsorted(here, at + 1), max(len(here) - 1, 0))
            goes_on = (here[place] == at + 1) if len(here) else np.zeros(len(at), dtype=bool)
            gone = ~goes_on
            if gone.any():
                length = t - since[gone]
                ended.append(np.stack([at[gone] - length + 1, since[gone], length], axis=1))
            begun = np.full(len(here), t)
            begun[place[goes_on]] = since[goes_on]
        else:
            begun = np.full(len(here), t)
        at, since = here, begun
    return np.concatenate(ended) if ended else np.zeros((0, 3), dtype=np.int64)


def greedy_tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in doc, start in item, words), the longest first; doc and item are hashes of their seeds of ``least`` words.

    Of equal matches the one earlier in the item, then in the document, is taken. What
    a tile covers is cut out of the other matches.
    """
    tiles, runs = [], matching_runs(doc, item)
    p, t, n = runs[:, 0], runs[:, 1], runs[:, 2] + least - 1
    while len(p):
        best = np.lexsort((p, t, -n))[0]
        tile = int(p[best]), int(t[best]), int(n[best])
        tiles.append(tile)
        # what is left of each match before, between and behind the tile's words in the document and in the item
        cuts = np.sort(np.stack([tile[0] - p, tile[1] - t], axis=1), axis=1)
        begin = np.stack([np.zeros_like(p), np.clip(cuts[:, 0] + tile[2], 0, n), np.clip(cuts[:, 1] + tile[2], 0, n)])
        end = np.stack([np.clip(cuts[:, 0], 0, n), np.clip(cuts[:, 1], 0, n), n])
        left = end - begin >= least
        p, t, n = (p + begin)[left], (t + begin)[left], (end - begin)[left]
    return tiles


class Benchmark:
    """A block of test items: their words, and an index of their seeds."""

    def __init__(self, items: list[tuple[int, str]], seed_words: int, coverage: float):
        hasher = Hasher()
        column = pa.array([text for _, text in items], pa.large_string())
        self.coverage = coverage
        self.ids = [i for i, _ in items]
        self.words: list[list[bytes]] = [text.encode().translate(hasher.lower.tobytes()).split() for _, text in items]
        #: for each item its seeds in order; by seed length: sorted seeds, and for each the item; the seeds of all items
        self.of_item: list[np.ndarray] = []
        for lo, hi, data, rows in blocks(column):
            split = hasher.split(hasher.lower[data], rows)
            hashes = hasher.word_hashes(split)
            for r in range(hi - lo):
                words = hashes[split.of_row[r] : split.of_row[r + 1]]
                self.of_item.append(hasher.ngrams(words, max(1, min(seed_words, len(words)))))
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.every: dict[int, np.ndarray] = {}
        self.maps: dict[int, np.ndarray] = {}
        by_length: dict[int, list[int]] = {}
        for k, words in enumerate(self.words):
            if words:
                by_length.setdefault(min(seed_words, len(words)), []).append(k)
        for n, members in by_length.items():
            different = [np.unique(self.of_item[k]) for k in members]
            every, in_items = np.unique(np.concatenate(different), return_counts=True)
            grams, item = [], []
            for k, mine in zip(members, different):
                # tiles of n words or more need so many of the item's seeds; without the rest of them, taken by rarity, none is found
                needed = -(-int(np.ceil(coverage * len(self.words[k]))) // n)
                places = np.bincount(np.searchsorted(mine, self.of_item[k]), minlength=len(mine))
                order = np.argsort(in_items[np.searchsorted(every, mine)], kind="stable")
                used = int(np.searchsorted(np.cumsum(places[order]), len(self.of_item[k]) - needed + 1)) + 1
                grams.append(mine[order[:used]])
                item.append(np.full(len(grams[-1]), k, dtype=np.int32))
            grams, item = np.concatenate(grams), np.concatenate(item)
            order = np.argsort(grams, kind="stable")
            self.seeds[n], self.every[n] = (grams[order], item[order]), every

    def candidates(self, row: np.ndarray, grams: np.ndarray, n: int):
        """(row, item) pairs, each once, of rows that hold a seed of the index, a bounded number of seeds at a time."""
        seeds, item = self.seeds[n]
        left = np.searchsorted(seeds, grams, side="left")
        hits = np.searchsorted(seeds, grams, side="right") - left
        row, left, hits = row[hits > 0], left[hits > 0], hits[hits > 0]
        done: set[int] = set()
        for lo in range(0, len(row), 4096):
            h = hits[lo : lo + 4096]
            index = np.repeat(left[lo : lo + 4096] - np.append(0, np.cumsum(h)[:-1]), h) + np.arange(h.sum())
            for pair in np.unique(np.repeat(row[lo : lo + 4096], h) * len(self.ids) + item[index]).tolist():
                if pair not in done:
                    done.add(pair)
                    yield divmod(pair, len(self.ids))

    def search(self, hasher: Hasher, column: pa.Array):
        """(row, item id, words of the item, covered words, tiles) for each pair at or over the coverage."""
        for n, every in self.every.items():
            if n not in self.maps:
                self.maps[n] = np.zeros(1 << 24, dtype=bool)
                self.maps[n][every >> np.uint64(40)] = True
        for lo, _, data, rows in blocks(column):
            data = hasher.lower[data]
            split = hasher.split(data, rows)
            words = hasher.word_hashes(split)
            for n in self.seeds:
                grams = hasher.ngrams(words, n)
                near = np.flatnonzero(self.maps[n][grams >> np.uint64(40)])
                near = near[inside(split.of_row, n, len(grams))[near]]
                if not len(near):
                    continue
                row = np.searchsorted(split.of_row, near, side="right") - 1
                order = np.lexsort((grams[near], row))
                row, near = row[order], near[order]
                first = np.ones(len(row), dtype=bool)
                first[1:] = (row[1:] != row[:-1]) | (grams[near[1:]] != grams[near[:-1]])
                for r, k in self.candidates(row[first], grams[near[first]], n):
                    begin, end = split.of_row[r], split.of_row[r + 1]
                    mine, item, target = grams[begin : end - n + 1], self.of_item[k], self.words[k]
                    a, b = np.searchsorted(row, [r, r + 1])
                    known = grams[near[a:b]]
                    there = known[np.minimum(np.searchsorted(known, item), len(known) - 1)] == item
                    reach = np.convolve(there, np.ones(n, dtype=np.int64)) > 0
                    if reach.sum() < self.coverage * len(target):
                        continue
                    tiles = []
                    for p, t, size in greedy_tiles(mine, item, n):
                        at = slice(begin + p, begin + p + size)
                        # the words themselves, whatever their hashes say
                        if [data[x:y].tobytes() for x, y in zip(split.starts[at], split.ends[at])] == target[t : t + size]:
                            tiles.append((p, t, size))
                    covered = sum(x[2] for x in tiles)
                    if covered >= self.coverage * len(target):
                        yield lo + r, self.ids[k], len(target), covered, tiles


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, block_items: int = BLOCK_ITEMS):
    """The items in blocks of about block_bytes of text, each small enough to be sent to all tasks.

    Null texts and texts without words can't be found in a document and are
    left out. Items with a null id keep it.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    size = items.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    count = max(-(-(size["b"] or 0) // block_bytes), -(-size["n"] // block_items))
    for k in range(count):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        yield [(r["item_id"], r["text"]) for r in part.sort("item_id", "text").collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed_words: int = SEED_WORDS, id_column: str = "doc_id") -> DataFrame:
    """Pairs (doc_id, item_id, n_words, n_covered, n_tiles, longest, tiles) at or over the coverage.

    Words are runs outside white space, A-Z in lower case. Items of fewer than
    ``seed_words`` words count if the whole item is found. Null or empty texts
    match nothing; a null doc_id or item_id stays null in its pairs. An empty table on either side gives no pairs. Repeated documents and items give a pair each. A tile is
    [start word in the document, start word in the item, words]. Documents are
    read once for each block of items and are not shuffled. A text of one word again and again takes memory
    in proportion to its length. Further columns are left out.
    """
    spark = docs.sparkSession
    tiles = "array<struct<doc_start:int,item_start:int,words:int>>"
    schema = f"doc_id long, item_id long, n_words long, n_covered long, n_tiles long, longest long, tiles {tiles}"
    kind = pa.list_(pa.struct([("doc_start", pa.int32()), ("item_start", pa.int32()), ("words", pa.int32())]))
    types = [pa.int64()] * 6 + [kind]
    names = ["doc_id", "item_id", "n_words", "n_covered", "n_tiles", "longest", "tiles"]
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in benchmark_blocks(benchmark):
        shared = spark.sparkContext.broadcast(vars(Benchmark(items, seed_words, coverage)))

        def run(batches, shared=shared):
            test, hasher = restored(Benchmark, shared.value), Hasher()
            for batch in batches:
                ids = batch.column(0)
                rows = [
                    (ids[row].as_py(), item, n, covered, len(found), max(x[2] for x in found), [dict(zip(("doc_start", "item_start", "words"), x)) for x in found])
                    for row, item, n, covered, found in test.search(hasher, batch.column(1))
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), type=t) for x, t in zip(zip(*rows), types)], names=names)

        part = texts.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def clean_documents(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed_words: int = SEED_WORDS) -> DataFrame:
    """The documents, with all their columns, in which no test item reaches the coverage; the rest as in contaminated()."""
    spark = docs.sparkSession
    where = docs.columns.index("text")
    if docs.schema["text"].dataType.simpleString() != "string":
        raise TypeError("text must be a string column")
    for items in benchmark_blocks(benchmark):
        shared = spark.sparkContext.broadcast(vars(Benchmark(items, seed_words, coverage)))

        def run(batches, shared=shared):
            test, hasher = restored(Benchmark, shared.value), Hasher()
            for batch in batches:
                bad = {row for row, *_ in test.search(hasher, batch.column(where))}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_())) if bad else batch

        docs = docs.mapInArrow(run, docs.schema)
    return docs
