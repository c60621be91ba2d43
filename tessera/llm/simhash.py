"""SimHash near-duplicates: all links between 64-bit fingerprints, exact, by vantage-point trees.

A vantage-point tree splits fingerprints at a node by their Hamming distance to one of them:
those at most a radius away are the inner branch, the rest the outer one. A partner
of x within r bits lies at a distance from the vantage point that differs from that of x by at most r, so x
visits the other branch only if it lies within r of the radius.

Fingerprints are spread evenly over distances of about 32, where 4 bits reach most of a
tree. So the trees are built on the four 16-bit parts of a fingerprint: two fingerprints that differ in
4 bits or fewer differ in one bit at most in some part, and that part's tree is asked with r = 1. The trees are
drawn from the exact number of fingerprints with each value of a part (65,536 values at most, whatever
the table's size). Their leaves are the shards: a fingerprint goes to its own leaf in each tree, and visits
those leaves that lie across a boundary it is near to, later ones only, so that a pair meets once
in a tree. In a shard the whole fingerprints are compared, again by their distances to a vantage point.

A shard gives a spanning forest of its links, not all of them; components follow by large and small stars.
Documents with one fingerprint are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, free_name, written
from .components import components
from .runs import pieces

WORDS, BITS, SEED = 4, 4, 42
#: Parts of a fingerprint, and bits of a part.
PARTS, WIDTH = 4, 16
#: A leaf is split while it holds more fingerprints than this (and more than one value of its part).
LEAF = 512
#: Fingerprints of one shard that are held at once; a leaf of one value that has more is cut into several shards.
HELD = 4096
#: Vantage points tried at a node.
TRIED = 6
#: Hashes whose bits are counted at once.
_BLOCK = 1 << 15
_COLUMNS = ["fingerprint", "component_id"]


# --- fingerprints


def shingle_hashes(text: bytes, words: int = WORDS) -> Iterator[list[int]]:
    """XXH64 of the runs of ``words`` words of a text in lower case, some at a time; a shorter text is one run."""
    held: list[bytes] = []
    some = False
    for part in pieces(text.lower()):  # bytes: only A-Z
        held += part
        if len(held) >= words:
            some = True
            ends = list(accumulate([len(w) + 1 for w in held]))
            joined, digest = b" ".join(held), xxhash.xxh64_intdigest
            yield [digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[words - 1 :], strict=False)]
            held = held[len(held) - words + 1 :] if words > 1 else []
    if held and not some:
        yield [xxhash.xxh64_intdigest(b" ".join(held), SEED)]


def majority(texts: list[bytes], words: int = WORDS) -> np.ndarray:
    """The fingerprint of each text: bits that are set in over half of its hashes."""
    ones, number = np.zeros((len(texts), 64), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    hashes: list[int] = []
    rows: list[int] = []
    starts: list[int] = []

    def count() -> None:
        if hashes:
            bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
            np.add.at(ones, rows, np.add.reduceat(bits, starts, axis=0, dtype=np.int64))
            np.add.at(number, rows, np.diff([*starts, len(hashes)]))
        hashes.clear()
        rows.clear()
        starts.clear()

    for row, text in enumerate(texts):
        for some in shingle_hashes(text, words):
            rows.append(row)
            starts.append(len(hashes))
            hashes.extend(some)
            if len(hashes) > _BLOCK:
                count()
    count()
    return np.packbits(2 * ones > number[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, out: str, words: int = WORDS) -> DataFrame:
    """docs without their text, with ``out``: the fingerprint as a long (null and empty texts: 0)."""
    keep = [c for c in docs.columns if c.lower() not in ("text", out.lower())]
    names = [f"c{i}" for i in range(len(keep))]
    schema = T.StructType([*[T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, keep, strict=True)], T.StructField("fp", T.LongType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [majority([(batch.column(0)[i].as_py() or "").encode() for i in range(at, min(at + 64, batch.num_rows))], words) for at in range(0, batch.num_rows, 64)]
            found = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found.view(np.int64))], names=[*names, "fp"])

    rows = docs.select("text", *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    return rows.mapInArrow(find, schema).select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], F.col("fp").alias(out))


# --- trees


def _split(values: np.ndarray, weights: np.ndarray, rng: np.random.Generator) -> tuple[int, int]:
    """(vantage point, radius): of splits with a quarter on each side that with the fewest fingerprints on the boundary, else the most even one."""
    best: tuple[tuple[bool, float], int, int] | None = None
    for at in rng.choice(len(values), size=min(TRIED, len(values)), replace=False):
        by = np.bincount(np.bitwise_count(values ^ values[at]), weights=weights, minlength=WIDTH + 1)
        inner = np.cumsum(by)
        total = inner[-1]
        for radius in range(WIDTH):
            share = min(inner[radius], total - inner[radius]) / total
            if share > 0:
                order = (False, by[radius] / total) if share >= 0.25 else (True, -share)
                if best is None or order < best[0]:
                    best = (order, int(values[at]), radius)
    assert best  # two values differ, so one of them at radius 0 splits
    return best[1], best[2]


def tree(values: np.ndarray, weights: np.ndarray, leaf: int = LEAF, reach: int = 1, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(leaf of each value of a part, fingerprints in each leaf, visits): a vantage-point tree of the values that occur.

    visits are (value, leaf): leaves after the value's own that hold a value within ``reach`` bits; triangle
    bounds prune the branches on the way (a value has 16 neighbours at most, so it visits no more leaves). Values that don't occur have the leaf -1.
    """
    rng = np.random.default_rng(seed)
    home = np.full(1 << WIDTH, -1, dtype=np.int32)
    sizes: list[int] = []
    visits: list[tuple[np.ndarray, int]] = []
    todo = [(np.arange(len(values)), np.zeros(0, dtype=np.int64))]  # (own, visiting), as places in values; inner branches first
    while todo:
        own, visiting = todo.pop()
        weight = int(weights[own].sum())
        if len(own) < 2 or weight <= leaf:
            home[values[own]] = len(sizes)
            if len(visiting):
                met = (np.bitwise_count(values[visiting][:, None] ^ values[own][None, :]) <= reach).any(axis=1)
                visits.append((values[visiting[met]], len(sizes)))
            sizes.append(weight)
            continue
        vantage, radius = _split(values[own], weights[own], rng)
        own_at, visiting_at = (np.bitwise_count(values[x] ^ np.uint16(vantage)).astype(np.int64) for x in (own, visiting))
        inside = own[own_at <= radius]
        near = own[(own_at <= radius) & (own_at + reach > radius)]
        outer = np.concatenate([visiting[visiting_at + reach > radius], near])
        todo.append((own[own_at > radius], outer))
        todo.append((inside, visiting[visiting_at - reach <= radius]))
    return home, np.array(sizes, dtype=np.int64), [(v, n) for of, n in visits for v in of.tolist()]


def shard_plan(counts: list[tuple[np.ndarray, np.ndarray]], leaf: int = LEAF, held: int = HELD) -> dict[str, np.ndarray]:
    """Plain arrays that deal a fingerprint out: for each part and value the first shard of its leaf, the shards of a leaf, and the leaves it visits.

    counts: for each part the values that occur and how many fingerprints have each. At most 4 x 65,536 values with 16 visits each, so
    the arrays have some 20 MB at most, for tables of any size.
    """
    home, cuts, first, starts, lists, number = [], [], [], [0], [], 0
    for part, (values, weights) in enumerate(counts):
        of, sizes, visits = tree(values.astype(np.uint16), weights, leaf, seed=SEED + part) if len(values) else (np.full(1 << WIDTH, -1, dtype=np.int32), np.zeros(0, dtype=np.int64), [])
        n = np.maximum(1, -(-sizes // held))
        at = number + np.concatenate([[0], np.cumsum(n)])
        home.append(np.where(of >= 0, of + len(cuts), -1))
        visited = np.array(visits, dtype=np.int64).reshape(-1, 2)
        visited = visited[np.argsort(visited[:, 0], kind="stable")]
        starts += (starts[-1] + np.cumsum(np.bincount(visited[:, 0], minlength=1 << WIDTH))).tolist()
        lists.append(visited[:, 1] + len(cuts))
        first += at[:-1].tolist()
        cuts += n.tolist()
        number = int(at[-1])
    return {
        "home": np.concatenate(home).astype(np.int32), "first": np.array(first, dtype=np.int64), "cuts": np.array(cuts, dtype=np.int64),
        "starts": np.array(starts, dtype=np.int64), "leaves": np.concatenate(lists).astype(np.int32),
    }


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] numbers, and so on."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


def dealt(fp: np.ndarray, plan: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, whether it visits, fingerprint): all places of the fingerprints.

    A leaf cut into several shards has each of its fingerprints in one of them; it visits the later ones, and visitors visit all.
    """
    shards, kinds, places = [], [], []
    for part in range(PARTS):
        value = (fp >> np.uint64(WIDTH * part)).astype(np.int64) & ((1 << WIDTH) - 1)
        key = value + (part << WIDTH)
        own = plan["home"][key].astype(np.int64)
        cuts, first = plan["cuts"][own], plan["first"][own]
        mine = (fp % np.uint64(2**61 - 1) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % cuts
        at = np.arange(len(fp))
        shards.append(first + mine)
        kinds.append(np.zeros(len(fp), dtype=np.int8))
        places.append(at)
        later = cuts - mine - 1
        shards.append(_ranges(first + mine + 1, later))
        places.append(np.repeat(at, later))
        visits = plan["starts"][key + 1] - plan["starts"][key]
        leaves = plan["leaves"][_ranges(plan["starts"][key], visits)]
        shards.append(_ranges(plan["first"][leaves], plan["cuts"][leaves]))
        places.append(np.repeat(np.repeat(at, visits), plan["cuts"][leaves]))
        kinds.append(np.ones(len(places[-1]) + len(places[-2]), dtype=np.int8))
    return np.concatenate(shards), np.concatenate(kinds), fp[np.concatenate(places)]


class Shard:
    """The fingerprints of a shard in rings around a vantage point; gives the links that join what isn't joined yet."""

    def __init__(self, own: np.ndarray, bits: int):
        self.bits, self.vantage = bits, own[0]
        at = np.bitwise_count(own ^ self.vantage)
        order = np.argsort(at, kind="stable")
        self.own = own[order]
        self.group = np.arange(len(own))
        #: where the ring of each distance begins
        self.rings = np.searchsorted(at[order], np.arange(66))

    def _near(self, some: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(place in some, first place compared, which of the own from there on are near) for each that has any."""
        at = np.bitwise_count(some ^ self.vantage)
        for distance in np.unique(at).tolist():
            lo, hi = self.rings[max(0, distance - self.bits)], self.rings[min(64, distance + self.bits) + 1]
            ring = np.flatnonzero(at == distance)
            step = max(1, (1 << 20) // max(1, hi - lo))
            for k in range(0, len(ring), step):
                rows = ring[k : k + step]
                near = np.bitwise_count(some[rows][:, None] ^ self.own[None, lo:hi]) <= self.bits
                for i in np.flatnonzero(near.any(axis=1)).tolist():
                    yield int(rows[i]), int(lo), near[i]

    def inner_links(self) -> list[tuple[int, int]]:
        out = []
        for i, lo, near in self._near(self.own):
            places = lo + np.flatnonzero(near)
            while len(places := places[self.group[places] != self.group[i]]):
                out.append((int(self.own[i]), int(self.own[places[0]])))
                self.group[self.group == self.group[places[0]]] = self.group[i]
        return out

    def links_of(self, visitors: np.ndarray) -> list[tuple[int, int]]:
        out = []
        for i, lo, near in self._near(visitors):
            places = lo + np.flatnonzero(near)
            first = places[0]
            out.append((int(visitors[i]), int(self.own[first])))
            while len(places := places[self.group[places] != self.group[first]]):
                out.append((int(visitors[i]), int(self.own[places[0]])))
                self.group[self.group == self.group[places[0]]] = self.group[first]
        return out


def links(classes: DataFrame, bits: int = BITS, leaf: int = LEAF, held: int = HELD) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that differ in at most ``bits`` (4 or fewer) bits; their components are those of all links."""
    if not 0 <= bits <= PARTS:
        raise ValueError(f"the trees find fingerprints that differ in 0 to {PARTS} bits")
    spark, mask = classes.sparkSession, (1 << WIDTH) - 1
    values = F.array(*[F.struct(F.lit(p).alias("part"), F.shiftrightunsigned("fp", WIDTH * p).bitwiseAND(F.lit(mask)).alias("value")) for p in range(PARTS)])
    found = classes.select(F.explode(values).alias("x")).groupBy("x.part", "x.value").agg(F.count(F.lit(1)).alias("n")).toArrow()
    part, value, n = (found.column(i).to_numpy() for i in range(3))
    order = np.lexsort((value, part))
    part, value, n = part[order], value[order], n[order]
    plan = spark.sparkContext.broadcast(shard_plan([(value[part == p], n[part == p]) for p in range(PARTS)], leaf, held))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint64)
            for at in range(0, len(fp), 4096):
                shard, visits, places = dealt(fp[at : at + 4096], plan.value)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(visits), pa.array(places.view(np.int64))], names=["shard", "visits", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own, shard = None, [], None

        def linked(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            both = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            number, visits, fp = (np.asarray(batch.column(i)) for i in range(3))
            # runs of rows of one shard and kind; a shard's own come before its visitors
            edges = np.flatnonzero((np.diff(number) != 0) | (np.diff(visits) != 0)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(number)], strict=True):
                if lo == hi:
                    continue
                if number[lo] != current:
                    if own and shard is None:
                        yield linked(Shard(np.concatenate(own), bits).inner_links())
                    current, own, shard = int(number[lo]), [], None
                some = fp[lo:hi].view(np.uint64)
                if not visits[lo]:
                    own.append(some)
                elif own:
                    if shard is None:
                        shard = Shard(np.concatenate(own), bits)
                        yield linked(shard.inner_links())
                    yield linked(shard.links_of(some))
        if own and shard is None:
            yield linked(Shard(np.concatenate(own), bits).inner_links())

    spread = classes.select("fp").mapInArrow(deal, "shard long, visits byte, fp long").repartition("shard").sortWithinPartitions("shard", "visits")
    return spread.mapInArrow(compare, "a long, b long")


def simhash_components(docs: DataFrame, bits: int = BITS, words: int = WORDS) -> DataFrame:
    """docs without their text, with fingerprint (16 hex digits) and component_id: the smallest doc_id that links lead to, its own included.

    Two documents are linked if their fingerprints differ in at most ``bits`` bits. Null and empty texts have the fingerprint 0 and are
    linked like any other; repeated rows share a fingerprint; a null doc_id is never the smallest, and component_id is
    null where no other is reached. Texts of any length are hashed in pieces. Columns of docs named like a new one
    are replaced; empty tables give empty ones.
    """
    fp = free_name(docs, "_fp")
    rows = written(fingerprints(docs.drop(*[c for c in docs.columns if c.lower() in _COLUMNS]), fp, words))
    classes = written(rows.groupBy(F.col(fp).alias("fp")).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    joined = components(links(classes, bits))
    roots = classes.join(joined.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    roots = written(roots)
    smallest = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(roots.join(smallest, "root").select(F.col("fp").alias("of_fp"), "component_id", "n"))
    discard(classes, roots)
    # fingerprints with a thousandth of the rows or more, a thousand at most, are broadcast; the others are no hot keys
    total = named.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * 1000 >= total
    frequent = F.broadcast(named.where(hot).select("of_fp", "component_id"))
    out = [*[F.col(c) for c in rows.columns if c != fp], F.lpad(F.lower(F.hex(fp)), 16, "0").alias("fingerprint"), F.col("component_id")]
    first = rows.join(frequent, F.col(fp) == F.col("of_fp")).select(*out)
    rest = rows.join(frequent.select("of_fp"), F.col(fp) == F.col("of_fp"), "left_anti").join(named.where(~hot), F.col(fp) == F.col("of_fp")).select(*out)
    return first.unionByName(rest)
