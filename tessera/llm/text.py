"""Vectorised words and word n-grams over Arrow text columns.

Words are the maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D`` of the
UTF-8 text. Everything works on one block of rows at a time, so the arrays stay
small whatever the batch or the text length is (a text longer than a block is a
block of its own).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

_BLOCK_BYTES = 1 << 20
_SEED = 20240229
#: Longer words are hashed one by one.
_SHORT = 64
#: The lowest 0 to 8 bytes of a value.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (xor-shift and multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in their order; mixing at every step leaves no structure that equal sums could come from."""
    return mix(a * np.uint64(0x9E3779B97F4A7C17) + b)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of bytes for words (0: between words), for tokens (1: letters, digits, 2: signs), and lower case."""
    word = np.ones(256, dtype=np.uint8)
    word[[0x20, *range(0x09, 0x0E)]] = 0
    token = np.full(256, 2, dtype=np.uint8)
    token[[*range(0x30, 0x3A), *range(0x41, 0x5B), 0x5F, *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
    token[word == 0] = 0
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return word, token, lower


class Words:
    """The words of a block of rows (runs of one class of bytes): byte spans, and for each row its words."""

    def __init__(self, data: np.ndarray, rows: np.ndarray, classes: np.ndarray):
        self.data, self.rows = data, rows
        n = len(data)
        kind = classes[data]
        first = np.ones(n, dtype=bool)
        last = np.ones(n, dtype=bool)
        last[:-1] = first[1:] = kind[1:] != kind[:-1]
        edges = rows[rows < n]
        first[edges] = True
        edges = rows[rows > 0] - 1
        last[edges] = True
        word = kind > 0
        self.starts = np.flatnonzero(first & word)
        self.ends = np.flatnonzero(last & word) + 1
        #: for each row, its first word; one entry more than rows
        self.of_row = np.searchsorted(self.starts, rows)


class Hasher:
    """Hashes of words and of word n-grams.

    Words are taken 8 bytes at a time; each step mixes and then adds the bytes again, so
    that no step can be undone and no words are known that share a hash (a sum over
    bytes has such words, for example the Thue-Morse ones). Words of over 64 bytes get 64 bits of BLAKE2b.
    """

    def __init__(self) -> None:
        self.word, self.token, self.lower = _tables()

    def split(self, data: np.ndarray, rows: np.ndarray) -> Words:
        return Words(data, rows, self.word)

    def tokens(self, data: np.ndarray, rows: np.ndarray) -> Words:
        """Runs of letters and digits, and runs of signs, each a token."""
        return Words(data, rows, self.token)

    def word_hashes(self, w: Words) -> np.ndarray:
        sizes = w.ends - w.starts
        padded = np.append(w.data, np.zeros(8, dtype=np.uint8))
        eight = np.ndarray(len(w.data) + 1, dtype="<u8", buffer=padded, strides=(1,))
        out = mix(sizes.astype(np.uint64) + np.uint64(_SEED))
        for k in range(0, _SHORT, 8):
            at = np.flatnonzero(sizes > k) if k else slice(None)
            if k and not len(at):
                break
            part = eight[w.starts[at] + k] & _MASKS[np.minimum(sizes[at] - k, 8)]
            out[at] = mix(out[at] * np.uint64(0xD6E8FEB86659FD93) + part) + part * np.uint64(0xA0761D6478BD642F)
        for i in np.flatnonzero(sizes > _SHORT).tolist():
            out[i] = int.from_bytes(blake2b(w.data[w.starts[i] : w.ends[i]], digest_size=8).digest(), "little")
        return mix(out)

    def ngrams(self, words: np.ndarray, n: int) -> np.ndarray:
        """Hash of the n words from each position; rows are not looked at.

        Hashes of 1, 2, 4 ... words are joined to n as its binary digits say.
        """
        count = max(0, len(words) - n + 1)
        if not count:
            return np.zeros(0, dtype=np.uint64)
        power, width, rest, have, total = words, 1, n, 0, words
        while True:
            if rest & 1:
                total = joined(total[: len(words) - have - width + 1], power[have:]) if have else power
                have += width
            rest >>= 1
            if not rest:
                return mix(total + np.uint64(n))
            power = joined(power[:-width], power[width:])
            width *= 2


def inside(of_row: np.ndarray, n: int, count: int) -> np.ndarray:
    """Which of the first ``count`` positions begin n words of one row."""
    ok = np.zeros(count, dtype=bool)
    for_row = np.diff(of_row) - n + 1
    if not count or not (for_row > 0).any():
        return ok
    edge = np.zeros(count + 1, dtype=np.int32)
    keep = for_row > 0
    np.add.at(edge, of_row[:-1][keep], 1)
    np.add.at(edge, of_row[:-1][keep] + for_row[keep], -1)
    return np.cumsum(edge[:-1]) > 0


def blocks(column: pa.Array, limit: int = _BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of each block; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("") if column.null_count else column
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    ends = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, side="right")) - 1)
        yield lo, hi, data[ends[lo] : ends[hi]], (ends[lo : hi + 1] - ends[lo]).astype(np.int64)
        lo = hi
