"""Periodic runs of words: stretches that repeat with a period and can't be extended.

Every run has a Lyndon word (a word smaller than all its rotations) of the length of its
period that is the longest Lyndon word at its start, under the order of the words or under the
reverse one. So the longest Lyndon word at each position under both orders gives all
candidates, and extending each to both sides gives the runs; their periods are the
smallest ones, since a Lyndon word isn't a power.

The longest Lyndon word at a position ends where the next smaller suffix begins. The stack of
next smaller suffixes is kept from right to left, as links. Suffixes that begin with the same
few words are compared by their longest common extension: a binary search over rolling
hashes (modulo 2**61 - 1). No suffix array is built. What the hashes say is held
against the words themselves, each stretch once for each distance; if they disagree, the text is
done again with another base.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b
from itertools import accumulate, chain, count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A run has LEAST words or more, and its period TIMES times or more.
LEAST, TIMES = 24, 3
COLUMNS = ["n_words", "runs", "collapsed"]
RUN = "struct<start:bigint,length:bigint,period:bigint>"
_PRIME = (1 << 61) - 1
#: So many words are compared one by one before hashes are asked.
_DIRECT = 8
_PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes, size: int = _PIECE) -> Iterator[list[bytes]]:
    """The words of a text, some at a time, so that a long text isn't a list of all its words."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + size) if at + size < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end].split()
        at = end


class Extensions:
    """Longest common extensions of a sequence of numbers, by rolling hashes; what they claim is kept for ``holds``."""

    def __init__(self, ids: list[int], base: int):
        self.ids, self.n, self.base = ids, len(ids), base
        self.sums: list[int] | None = None
        self.claims: list[tuple[int, int, int]] = []
        self.known: dict[int, tuple[int, int]] = {}

    def _equal(self, i: int, j: int, m: int) -> bool:
        if self.sums is None:
            base = self.base
            self.sums = list(accumulate(self.ids, lambda h, x: (h * base + x + 1) % _PRIME, initial=0))
            self.powers = list(accumulate(repeat(base, self.n), lambda a, b: a * b % _PRIME, initial=1))
        s = self.sums
        return (s[i + m] - s[j + m] - (s[i] - s[j]) * self.powers[m]) % _PRIME == 0

    def right(self, i: int, j: int) -> int:
        """Equal numbers from i and from j > i on.

        The last stretch found at this distance saves the search where this one runs into it.
        """
        ids, most, distance = self.ids, self.n - j, j - i
        lo, hi = self.known.get(distance, (self.n, 0))
        if lo <= i < hi:
            return hi - i
        k, near = 0, min(_DIRECT, most, lo - i) if i < lo < hi else min(_DIRECT, most)
        while k < near and ids[i + k] == ids[j + k]:
            k += 1
        if i + k == lo < hi:
            self.known[distance] = (i, hi)
            return hi - i
        if k < _DIRECT:  # a word differs, or the end
            return k
        k += self._search(i + k, j + k, most - k, 1)
        self.known[distance] = (i, i + k)
        self.claims.append((distance, i, i + k))
        return k

    def _search(self, i: int, j: int, most: int, way: int) -> int:
        """The greatest m <= most for which m numbers after (way 1) or before (way -1) i and j have equal hashes."""
        if self._equal(min(i, i + way * most), min(j, j + way * most), most):
            return most
        m, step = 0, _DIRECT
        while m + step < most and self._equal(min(i + way * m, i + way * (m + step)), min(j + way * m, j + way * (m + step)), step):
            m, step = m + step, step * 2
        while step:
            if m + step < most and self._equal(min(i + way * m, i + way * (m + step)), min(j + way * m, j + way * (m + step)), step):
                m += step
            step >>= 1
        return m

    def left(self, i: int, j: int) -> int:
        """Equal numbers before i and before j > i."""
        ids, k, near = self.ids, 0, min(_DIRECT, i)
        while k < near and ids[i - k - 1] == ids[j - k - 1]:
            k += 1
        if k < near or k == i:
            return k
        k += self._search(i - k, j - k, i - k, -1)
        self.claims.append((j - i, i - k, i))
        return k

    def holds(self, ids: np.ndarray) -> bool:
        """Whether the words are equal wherever a hash said so; stretches of one distance that overlap are looked at once."""
        self.claims.sort()
        at, last = -1, 0
        for distance, lo, hi in self.claims:
            if distance != last:
                at, last = -1, distance
            lo = max(lo, at)
            if lo < hi:
                if not np.array_equal(ids[lo:hi], ids[lo + distance : hi + distance]):
                    return False
                at = hi
        return True


def lyndon_ends(order: np.ndarray, near: Extensions) -> np.ndarray:
    """For each position the end of its longest Lyndon word: where the next smaller suffix begins (a suffix is smaller than what it begins).

    order has a number for each word that says its place in the order of words.
    """
    n = len(order)
    ids, extension = order.tolist(), near.right
    ends = list(range(1, n + 1))  # right where the next word is smaller
    for i in np.flatnonzero(order[:-1] <= order[1:])[::-1].tolist():
        x, j = ids[i], i + 1
        while j < n:
            y = ids[j]
            if x == y:
                k = extension(i, j)
                if j + k == n or ids[i + k] > ids[j + k]:
                    break
            elif x > y:
                break
            j = ends[j]
        ends[i] = j
    return np.array(ends, dtype=np.int64)


def candidates(ids: np.ndarray, ends: np.ndarray, least: int, times: int) -> np.ndarray:
    """Starts of Lyndon words that may be the first in a run of the length asked for: some of the words that must be equal are."""
    n = len(ids)
    at = np.arange(n)
    period = ends - at
    # the first Lyndon word of a run begins in its first period, so that many words repeat from there
    far = np.maximum(least, times * period) - 2 * period + 1
    at = at[at + period + far <= n]
    for part in (np.zeros_like(far), far - 1, far // 2):
        at = at[ids[at + part[at]] == ids[at + part[at] + period[at]]]
    return at


def find_runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run, by start and period; ``times`` is 2 or more."""
    if len(ids) < max(least, times):
        return []
    words = ids.tolist()
    attempt = 0
    while True:
        # the base depends on the text, so that no text is known beforehand for which hashes fail
        seed = blake2b(ids.tobytes(), digest_size=8, salt=attempt.to_bytes(8, "little")).digest()
        near = Extensions(words, int.from_bytes(seed, "little") % (_PRIME - 1000) + 500)
        found = set()
        for sign in (1, -1):
            ends, seen = lyndon_ends(ids * sign, near), {}
            for i in candidates(ids, ends, least, times).tolist():
                period = int(ends[i]) - i
                if i + period <= seen.get(period, -1):
                    continue  # inside the last run of this period
                end = i + period + near.right(i, i + period)
                start = i - near.left(i, i + period)
                seen[period] = end
                if end - start >= max(least, times * period):
                    found.add((start, end - start, period))
        if near.holds(ids):
            return sorted(found, key=lambda r: (r[0], r[2]))
        attempt += 1


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words any run holds after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) > 0


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, keep: list[str] | None = None) -> DataFrame:
    """docs (text and others; ``keep`` of them, all by default) with n_words, runs and collapsed.

    runs has (start, length, period) of each run of ``least`` words and ``times`` periods or more, by start and
    period, counted in words from 0; collapsed is the text's words without those that a run holds after its first period, joined by
    one space. Words are the maximal runs of characters other than space and \\x09 to \\x0D, unchanged.

    Null and empty texts have no words, no runs and an empty collapsed text. Each row is judged by itself, so equal rows get equal values; empty
    tables give empty ones. A text of any length is done in the task that reads it, in memory of some 200 bytes a word at
    most where it repeats, less elsewhere. Columns of docs named like a new one are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in COLUMNS]
    names = [f"c{i}" for i in range(len(keep))]
    fields = [T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, keep, strict=True)]
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("runs", T._parse_datatype_string(f"array<{RUN}>")), T.StructField("collapsed", T.StringType())])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, size, made = 0, 0, []
            for row in range(batch.num_rows):
                numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
                text = (batch.column(0)[row].as_py() or "").encode()
                parts = [np.fromiter(map(numbers.__getitem__, words), dtype=np.int32, count=len(words)) for words in pieces(text)]
                ids = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
                runs = find_runs(ids, least, times)
                if runs:
                    known = list(numbers)
                    collapsed = b" ".join([known[i] for i in ids[~dropped(len(ids), runs)].tolist()])
                else:
                    collapsed = b" ".join(chain.from_iterable(pieces(text)))
                made.append((len(ids), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], collapsed.decode()))
                size += len(text)
                if size > _PIECE or row == batch.num_rows - 1:
                    part = batch.slice(first, row + 1 - first)
                    columns = [pa.array(x, k) for x, k in zip(zip(*made, strict=True), (pa.int64(), kind, pa.string()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(1, part.num_columns)], *columns], names=[*names, *COLUMNS])
                    first, size, made = row + 1, 0, []

    found = docs.select("text", *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)]).mapInArrow(find, schema)
    return found.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], *COLUMNS)


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs, with periods planted in the documents whose crc32(doc_id) ends in 0.

    Of their n words, those from number crc32 // 10 % n on repeat the first of them, some 3 to 10
    times; the words are joined by one space. Other texts, those without words and those without doc_id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    split = docs.select("doc_id", "text").withColumn("_g", F.floor(h / 10)).withColumn("_words", words).withColumn("_n", F.size("_words").cast("long"))
    placed = split.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n"))).withColumn("_left", F.col("_n") - F.col("_a"))
    period = (1 + F.floor(F.col("_left") / (3 + F.col("_g") % 8))).cast("int")
    rest, a = F.col("_left").cast("int"), F.col("_a").cast("int")
    again = F.flatten(F.array_repeat(F.slice("_words", a + 1, period), F.ceil(rest / period).cast("int")))
    text = F.array_join(F.concat(F.slice("_words", F.lit(1), a), F.slice(again, F.lit(1), rest)), " ")
    return placed.withColumn("text", F.when(F.col("_n") > 0, text).otherwise(F.col("text"))).drop("_g", "_words", "_n", "_a", "_left")


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, the run of the greatest exponent, digests) of periodic_runs; without runs that run is null."""
    none = F.lit(None).cast(RUN)

    def higher(best: Column, run: Column) -> Column:
        return F.when(best.isNull() | (run.length * best.period > best.length * run.period), run).otherwise(best)

    lines = F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n")))
    return found.withColumn("best", F.aggregate("runs", none, higher)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
