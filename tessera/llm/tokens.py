"""Token counts by a two-tier lookup of pre-token lengths, without any shuffle of pre-tokens.

The first tier is a broadcast table of frequent pre-tokens, of a bounded size.
The second is a cache in each Python worker, filled by the tokenizer itself. Both
only save work: a length comes from the tokenizer in any case.
"""

from __future__ import annotations

import os
import re
import sys
import types
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The characters below U+0250 that the tokenizer's pattern takes as letters, numbers and white space.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = "\t-\r \u0085\u00a0"
#: Fixed value: the byte-level pattern that splits a text before merging.
PATTERN = f"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
#: Fixed value: the same pattern by Unicode's classes.
UNICODE_PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Ranges whose classes are the same in all versions of Unicode in use (IPA, marks, Greek, Cyrillic, Hebrew, Arabic, Devanagari,
#: Latin, punctuation, currencies, arrows to dingbats, CJK, kana, Hangul, emoji). Texts with others go to the tokenizer whole.
SETTLED = "\u0250-\u036f\u0400-\u052f\u05d0-\u05ea\u0620-\u0669\u0904-\u0939\u1e00-\u1eff\u2000-\u205e\u20a0-\u20bf\u2190-\u23ff\u2500-\u27bf\u3000-\u303f\u3041-\u3096\u30a1-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\U0001f300-\U0001f64f\u03b1-\u03c9\u0391-\u03a1\u03a3-\u03a9"
#: Fixed value: the one special token; a text that holds it is cut there.
SPECIAL = "<|endoftext|>"

FREQUENT = 1 << 16
CACHED = 1_000_000
SAMPLE_DOCUMENTS = 1000
LONGEST = 32
LIMIT = 512


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Splitter:
    """Splits texts into the tokenizer's pre-tokens."""

    def __init__(self) -> None:
        self.pattern, self.unicode_pattern = re.compile(PATTERN), regex.compile(UNICODE_PATTERN)
        self.beyond, self.unsettled = re.compile("[^\x00-\u024f]"), re.compile(f"[^\x00-\u024f{SETTLED}]")

    def parts(self, text: str) -> list[str] | None:
        """The pre-tokens, or None where characters aren't settled."""
        if not self.beyond.search(text):
            return self.pattern.findall(text)
        return None if self.unsettled.search(text) else self.unicode_pattern.findall(text)


class Counting:
    """Counts tokens; ``lengths`` starts as the frequent table and grows to ``cached`` more.

    Pre-tokens of more than LONGEST characters stay in it for one call only, so
    its memory is bounded whatever the texts are.
    """

    def __init__(self, tokenizer, frequent: dict[str, int], cached: int = CACHED):
        self.tokenizer, self.frequent, self.cached = tokenizer, frequent, cached
        self.lengths = dict(frequent)
        self.splitter = Splitter()

    def encoded(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str | None]) -> list[int]:
        """The tokens of each text. A text with characters that aren't SETTLED goes to the tokenizer whole."""
        totals = [0] * len(texts)
        split, whole = [], []
        for i, text in enumerate(texts):
            pieces = (text or "").split(SPECIAL)
            totals[i] = len(pieces) - 1
            for piece in filter(None, pieces):
                parts = self.splitter.parts(piece)
                if parts is None:
                    whole.append((i, piece))
                else:
                    split.append((i, parts))
        new = list(set().union(*[p for _, p in split]).difference(self.lengths))
        if len(self.lengths) + len(new) > len(self.frequent) + self.cached:
            self.lengths = dict(self.frequent)
            new = list(set().union(*[p for _, p in split]).difference(self.lengths))
        if new:
            self.lengths.update(zip(new, self.encoded(new)))
        length = self.lengths.__getitem__
        for i, parts in split:
            totals[i] += sum(map(length, parts))
        if whole:
            for (i, _), n in zip(whole, self.encoded([p for _, p in whole])):
                totals[i] += n
        for part in new:
            if len(part) > LONGEST:
                del self.lengths[part]
        return totals


def worker_counting(path: str, frequent: tuple[list[str], bytes]) -> Counting:
    """This worker's counter, kept from task to task."""
    state = sys.modules.setdefault("tessera_worker_state", types.ModuleType("tessera_worker_state"))
    key = (path, len(frequent[0]), hash(tuple(frequent[0])))
    if getattr(state, "counting_key", None) != key:
        state.counting = Counting(load_tokenizer(path), dict(zip(*frequent)))
        state.counting_key = key
    return state.counting


def frequent_lengths(docs: DataFrame, text: str, path: str) -> tuple[list[str], bytes]:
    """The most frequent pre-tokens of about SAMPLE_DOCUMENTS documents, and their lengths.

    At most FREQUENT entries of at most LONGEST characters. It only warms the
    lookup up: any table gives the same counts. The documents are drawn in the tasks that read them, and
    each of these counts its own; only counts are shuffled.
    """

    def run(batches):
        splitter, counts = Splitter(), Counter()
        for batch in batches:
            for x in batch.column(0):
                for piece in (x.as_py() or "").split(SPECIAL):
                    counts.update(p for p in splitter.parts(piece) or () if len(p) <= LONGEST)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["part", "n"])

    share = min(1.0, SAMPLE_DOCUMENTS / max(1, docs.count()))
    rows = (
        docs.select(F.col(text).cast("string"))
        .sample(share, seed=1)
        .mapInArrow(run, "part string, n long")
        .groupBy("part")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "part")
        .limit(FREQUENT)
        .collect()
    )
    parts = [r["part"] for r in rows]
    if not parts:
        return [], b""
    lengths = [len(e) for e in load_tokenizer(path).encode_batch_fast(parts, add_special_tokens=False)]
    return parts, bytes(lengths)


def count_tokens(docs: DataFrame, text: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit for the whole of each text.

    Tokens are counted as the tokenizer gives them without added special
    tokens; its special string inside a text is one token. A null or empty text
    has none. Columns of these names are replaced, other columns stay. Repeated rows give equal rows, an empty table an
    empty one; very long texts are counted whole.
    """
    path = path or default_tokenizer()
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, text, path))
    kept = docs.drop("n_bytes", "n_tokens", "over_limit")
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    where = kept.columns.index(text)

    def run(batches):
        counting = worker_counting(path, shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = part.column(where).to_pylist()
                n = counting.count(texts)
                added = [
                    pa.array([len((x or "").encode("utf-8")) for x in texts], pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([x > limit for x in n], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*part.schema.names, "n_bytes", "n_tokens", "over_limit"])

    return kept.mapInArrow(run, f"{names}, n_bytes long, n_tokens long, over_limit boolean")
