"""N-gram Jaccard join by prefix trees, exact, and its connected components.

The n-grams of all documents have one global order: frequent ones last, by a count of all
n-grams in 2**28 slots of which the most frequent million have a place of their own, the rest by hash. Two
sets that reach the threshold share one of their first n - ceil(threshold n) + 1 n-grams in that order
(their prefixes). The sets under an n-gram go to the group of the least of them, so
n-grams that the same sets share lead to one group, and a set is sent once a group. A
group is a trie of whole sets in global order: a probe walks it once, sharing the
overlap of common beginnings, and leaves out subtrees in which the remaining lengths
can't reach the threshold, and those that are linked with it already. Equal sets are one from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, free_name, restored, written
from .components import components
from .text import Hasher, blocks, mix

WORDS = 4
PERCENT = 85
#: Bits of an n-gram's hash that are its slot in the count, and those of them that say which task counts it.
SLOT_BITS, PART_BITS = 28, 12
#: Slots with a place of their own in the order at most, and the sets that such a slot has at least.
FREQUENT, LEAST = 1 << 20, 16
#: N-grams that a task counts before it sends them.
HELD = 1 << 22
#: From this level (1,000 sets) on, the sets under an n-gram are first dealt to SALTS parts.
HOT_LEVEL, SALTS = 13, 64
#: Sets in a group that are compared by their counts in ranges, before texts are sent.
BOUNDED = 1000
#: N-grams in one block of a trie; a group with more is split into blocks.
BLOCK_GRAMS = 1_000_000


def least_overlap(x, y, percent: int):
    """The overlap from which sets of x and y elements reach the threshold."""
    return -(-percent * (x + y) // (100 + percent))


def shingle_sets(hasher: Hasher, data: np.ndarray, rows: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The sorted hashes of each row's n-grams, A-Z in lower case; of a shorter text, of all its words."""
    split = hasher.split(hasher.lower[data], rows)
    hashes = hasher.word_hashes(split)
    grams = hasher.ngrams(hashes, words)
    for begin, end in zip(split.of_row[:-1], split.of_row[1:]):
        if end - begin >= words:
            yield np.unique(grams[begin : end - words + 1])
        else:
            yield hasher.ngrams(hashes[begin:end], end - begin) if end > begin else grams[:0]


def fingerprint(grams: np.ndarray) -> int:
    total = mix(np.array([mix(grams + np.uint64(len(grams))).sum(dtype=np.uint64)], dtype=np.uint64))
    return int(total.view(np.int64)[0])


class Order:
    """The global order of n-grams: the level of their slot (0: not frequent), then 58 bits of the hash."""

    def __init__(self, slots: np.ndarray, levels: np.ndarray):
        by = np.argsort(slots)
        self.slots, self.levels = slots[by].astype(np.uint32), levels[by].astype(np.uint64)
        self.some = np.zeros(1 << 22, dtype=bool)
        self.some[self.slots >> np.uint32(SLOT_BITS - 22)] = True

    def ranked(self, grams: np.ndarray) -> np.ndarray:
        """The n-grams as values in the global order, sorted."""
        out = grams >> np.uint64(6)
        at = np.flatnonzero(self.some[(grams >> np.uint64(42)).astype(np.int64)])
        if len(at):
            slot = (grams[at] >> np.uint64(64 - SLOT_BITS)).astype(np.uint32)
            place = np.minimum(np.searchsorted(self.slots, slot), len(self.slots) - 1)
            out[at] |= np.where(self.slots[place] == slot, self.levels[place], np.uint64(0)) << np.uint64(58)
        return np.sort(out)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    id_ = F.col("doc_id").cast("long")
    return docs.select(id_.alias("doc_id"), text.alias("text"), F.coalesce(id_, F.lit(-(2**63))).alias("k1"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("k2"))


def counts_by_range(grams: np.ndarray) -> bytes | None:
    """How many of the n-grams are in each of 2**k equal ranges of hashes, two to four in one on average; None if over 255 are in one."""
    bits = max(len(grams) // 2, 1).bit_length() - 1
    counts = np.bincount((grams >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) if bits else np.array([len(grams)])
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def profiles(rows: DataFrame, words: int) -> DataFrame:
    """doc_id, k1, k2, n, fp and ranges (counts_by_range) of each row."""
    names = ["doc_id", "k1", "k2", "n", "fp", "ranges"]

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)):
                n, fp, ranges = [], [], []
                for grams in shingle_sets(hasher, data, offsets, words):
                    n.append(len(grams))
                    fp.append(fingerprint(grams))
                    ranges.append(counts_by_range(grams))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), pa.array(ranges, pa.binary())], names=names)

    return rows.select("doc_id", "text", "k1", "k2").mapInArrow(run, "doc_id long, k1 long, k2 long, n int, fp long, ranges binary")


def slots_of_tasks(rows: DataFrame, words: int) -> DataFrame:
    """(part, once, more): the slots of a task's different sets by part, in 16 bits each; ``more`` are those of several sets, followed by their counts in 32 bits each."""
    low_bits = SLOT_BITS - PART_BITS

    def batch_of(held: list[np.ndarray]) -> pa.RecordBatch:
        slots, sets = np.unique(np.concatenate(held), return_counts=True)
        edges = np.searchsorted(slots, np.arange((1 << PART_BITS) + 1, dtype=np.uint64) << np.uint64(low_bits))
        low, one = (slots & np.uint32((1 << low_bits) - 1)).astype(np.uint16), sets == 1
        used, once, more = np.flatnonzero(np.diff(edges)), [], []
        for part in used.tolist():
            here, single = slice(edges[part], edges[part + 1]), one[edges[part] : edges[part + 1]]
            once.append(low[here][single].tobytes())
            more.append(low[here][~single].tobytes() + sets[here][~single].astype(np.uint32).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["part", "once", "more"])

    def run(batches):
        hasher, seen, held, size = Hasher(), set(), [], 0
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                for grams in shingle_sets(hasher, data, offsets, words):
                    if len(grams) and (fp := fingerprint(grams)) not in seen:
                        seen.add(fp)
                        held.append((grams >> np.uint64(64 - SLOT_BITS)).astype(np.uint32))
                        size += len(grams)
                if size > HELD:
                    yield batch_of(held)
                    held, size = [], 0
        if held:
            yield batch_of(held)

    return rows.select("text").mapInArrow(run, "part int, once binary, more binary")


def frequent_slots(rows: DataFrame, words: int) -> DataFrame:
    """(slot, sets) of the slots that LEAST sets or more have; each part is counted in one array as its rows come in."""
    dealt = slots_of_tasks(rows, words).repartition("part").sortWithinPartitions("part")
    size = 1 << (SLOT_BITS - PART_BITS)

    def run(batches):
        part, counts = None, np.zeros(size, dtype=np.int64)

        def found():
            at = np.flatnonzero(counts >= LEAST)
            return (at + part * size).astype(np.int32), counts[at]

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["slot", "sets"])

        for batch in batches:
            out = []
            for p, once, more in zip(*[c.to_pylist() for c in batch.columns]):
                if p != part:
                    if part is not None:
                        out.append(found())
                    part, counts[:] = p, 0
                counts[np.frombuffer(once, np.uint16)] += 1
                n = len(more) // 6
                counts[np.frombuffer(more, np.uint16, n)] += np.frombuffer(more[2 * n :], np.uint32)
            if out:
                yield batch_of(out)
        if part is not None:
            yield batch_of([found()])

    return dealt.mapInArrow(run, "slot int, sets long")


def global_order(rows: DataFrame, words: int) -> Order:
    """The order by the count of all sets; at most FREQUENT slots come to the driver, whole levels from the most frequent down."""
    found = written(frequent_slots(rows, words))
    level = F.least(F.lit(63), F.floor(F.log2(F.col("sets") / LEAST) * 2) + 1).cast("int")
    least, total = 64, 0
    for r in found.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("slots")).orderBy(F.desc("level")).collect():
        total += r["slots"]
        if total > FREQUENT:
            break
        least = r["level"]
    known = found.where(level >= least).select("slot", level.alias("level")).toPandas()
    discard(found)
    return Order(known["slot"].to_numpy(), known["level"].to_numpy())


def prefixes(rows: DataFrame, order: Broadcast, words: int, percent: int) -> DataFrame:
    """(gram, fp, n, pos) of each prefix; a task gives those of equal sets once."""
    names, kinds = ["gram", "fp", "n", "pos"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def run(batches):
        hasher, ranks, seen = Hasher(), restored(Order, order.value), set()
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                out = []
                for grams in shingle_sets(hasher, data, offsets, words):
                    if len(grams) and (fp := fingerprint(grams)) not in seen:
                        seen.add(fp)
                        out.append((ranks.ranked(grams)[: prefix_length(len(grams), percent)], fp, len(grams)))
                if out:
                    sizes = [len(g) for g, _, _ in out]
                    columns = [
                        np.concatenate([g for g, _, _ in out]).view(np.int64),
                        np.repeat(np.array([f for _, f, _ in out], dtype=np.int64), sizes),
                        np.repeat(np.array([n for _, _, n in out], dtype=np.int32), sizes),
                        np.concatenate([np.arange(s, dtype=np.int32) for s in sizes]),
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return rows.select("text").mapInArrow(run, "gram long, fp long, n int, pos int")


class Trie:
    """Sets (sorted arrays of values) as a tree with one node for each stretch without a branch."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        self.values, local = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(self.size)
        self.sets = [local[e - n : e] for e, n in zip(ends, self.size)]
        order = sorted(range(len(sets)), key=lambda i: sets[i].byteswap().tobytes())
        begin, end, source, leaves, children = [0], [0], [order[0]], [[]], [[]]
        path = [0]
        for at, i in enumerate(order):
            common = 0
            if at:
                a, b = self.sets[order[at - 1]], self.sets[i]
                m = min(len(a), len(b))
                differ = np.flatnonzero(a[:m] != b[:m])
                common = int(differ[0]) if len(differ) else m
            while begin[path[-1]] >= common and len(path) > 1:
                path.pop()
            top = path[-1]
            if end[top] > common:
                # the stretch is cut in two: the old node keeps the upper part
                begin.append(common)
                end.append(end[top])
                source.append(source[top])
                leaves.append(leaves[top])
                children.append(children[top])
                end[top], leaves[top], children[top] = common, [], [len(begin) - 1]
            if common == len(self.sets[i]):
                leaves[top].append(i)
            else:
                children[top].append(len(begin))
                path.append(len(begin))
                begin.append(common)
                end.append(len(self.sets[i]))
                source.append(i)
                leaves.append([i])
                children.append([])
        parent = np.full(len(begin), -1)
        for node, below in enumerate(children):
            parent[below] = node
        self.end, self.leaves = np.array(end), leaves
        size = self.size.tolist()
        place = [0] * len(sets)
        for at, i in enumerate(order):
            place[i] = at
        least, most, low, high = ([x] * len(begin) for x in (1 << 40, 0, len(sets), -1))
        for node in np.argsort(-self.end, kind="stable").tolist():
            below = [(size[i], size[i], place[i], place[i]) for i in leaves[node]] + [(least[c], most[c], low[c], high[c]) for c in children[node]]
            least[node], most[node] = min(x[0] for x in below), max(x[1] for x in below)
            low[node], high[node] = min(x[2] for x in below), max(x[3] for x in below)
        #: the sets below a node: their sizes, and their places in the order of the leaves
        self.least, self.most, self.low, self.high = (np.array(x) for x in (least, most, low, high))
        self.order = np.array(order)
        self.mark = np.zeros(len(self.values), dtype=np.int32)
        self.run = [self.sets[s][b:e] for s, b, e in zip(source, begin, end)]
        order = np.argsort(parent, kind="stable")
        sorted_parents = parent[order]
        self.child_ids = order
        self.child_from = np.searchsorted(sorted_parents, np.arange(len(parent)), side="left")
        self.child_to = np.searchsorted(sorted_parents, np.arange(len(parent)), side="right")
        self.run_length = np.array([len(r) for r in self.run])
        self.run_start = np.append(0, np.cumsum(self.run_length))[:-1]
        self.run_values = np.concatenate(self.run)
        self.settle(np.arange(len(sets)))

    def settle(self, component: np.ndarray) -> None:
        """Note the components of the sets, and for each node that of all sets below it (-1: several)."""
        self.component = component
        leaves = component[self.order]
        changes = np.append(0, np.cumsum(leaves[1:] != leaves[:-1]))
        self.whole = np.where(changes[self.low] == changes[self.high], leaves[self.low], -1)

    def partners(self, i: int, percent: int) -> list[int]:
        """The stored sets of other components that reach the threshold with set i."""
        mine, n, own = self.sets[i], int(self.size[i]), self.component[i]
        mark = self.mark
        mark[mine] = 1
        found = []
        nodes, overlap = np.array([0]), np.array([0])
        while len(nodes):
            for node, shared in zip(nodes.tolist(), overlap.tolist()):
                for j in self.leaves[node]:
                    if self.component[j] != own and shared >= least_overlap(n, int(self.size[j]), percent):
                        found.append(j)
            counts = self.child_to[nodes] - self.child_from[nodes]
            within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            children = self.child_ids[np.repeat(self.child_from[nodes], counts) + within]
            overlap = np.repeat(overlap, counts)
            ok = (self.whole[children] != own) & (self.most[children] * 100 >= percent * n) & (self.least[children] * percent <= 100 * n)
            children, overlap = children[ok], overlap[ok]
            if not len(children):
                break
            lengths = self.run_length[children]
            inner = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            values = self.run_values[np.repeat(self.run_start[children], lengths) + inner]
            overlap = overlap + np.add.reduceat(mark[values], np.cumsum(lengths) - lengths)
            last = values[np.cumsum(lengths) - 1]
            rest = np.minimum(n - np.searchsorted(mine, last, side="right"), self.most[children] - self.end[children])
            ok = overlap + rest >= least_overlap(n, self.least[children], percent)
            nodes, overlap = children[ok], overlap[ok]
        mark[mine] = 0
        return found


def spanning_links(sets: list[np.ndarray], percent: int, probes: list[int] | None = None) -> list[tuple[int, int]]:
    """(set, least set of its component) for the components that the links of the probes (all sets) make."""
    if len(sets) < 2:
        return []
    trie, least = Trie(sets), list(range(len(sets)))

    def root(i: int) -> int:
        while least[i] != i:
            least[i] = least[least[i]]
            i = least[i]
        return i

    # the trie is told of components when as many sets have joined as it knows of, so a number of times that grows with the logarithm
    joined, told = 0, 0
    for i in range(len(sets)) if probes is None else probes:
        roots = sorted({root(j) for j in (i, *trie.partners(i, percent))})
        for other in roots[1:]:
            least[other] = roots[0]
        joined += len(roots) - 1
        if joined == len(sets) - 1:
            break
        if joined > 2 * told:
            told = joined
            trie.settle(np.array([root(j) for j in range(len(sets))]))
    return [(i, c) for i in range(len(sets)) if (c := root(i)) != i]


def dealt_sets(prefix: DataFrame, percent: int) -> DataFrame:
    """(pivot, fp, n): each set with the groups that it is compared in; a group's pivot is its least set.

    The sets under an n-gram, in the order of their sizes, are cut where a size can't reach the next one;
    each run of them goes to the group of its least set. A run of two is left out if their
    positions can't reach the threshold, either.
    """
    hot = F.shiftrightunsigned("gram", 58) >= HOT_LEVEL
    salted = prefix.withColumn("salt", F.when(hot, F.pmod("fp", F.lit(SALTS))).otherwise(0).cast("int"))
    by_size = Window.partitionBy("gram", "salt").orderBy("n", "fp")
    placed = salted.repartition("gram", "salt").distinct().withColumn("hot", hot)
    placed = placed.withColumn("cut", ~F.col("hot") & (F.coalesce(F.lag("n").over(by_size), F.lit(0)) * 100 < F.col("n") * percent))
    placed = placed.withColumn("last", F.coalesce(F.lead("cut").over(by_size), F.lit(True)))
    placed = placed.withColumn("run", F.count_if("cut").over(by_size)).where(F.col("hot") | ~(F.col("cut") & F.col("last")))
    under = Window.partitionBy("gram", "salt", "run")
    shared = placed.select(
        F.when(F.col("hot"), F.col("gram")).alias("gram"),
        "fp",
        "n",
        "pos",
        F.min("fp").over(under).alias("pivot"),
        F.count(F.lit(1)).over(under).alias("sets"),
        (F.sum("n").over(under) - F.col("n")).alias("n2"),
        (F.sum("pos").over(under) - F.col("pos")).alias("pos2"),
    )
    bound = F.least("pos", "pos2") + F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
    reach = bound >= F.expr(f"({percent} * (n + n2) + {99 + percent}) div {100 + percent}")
    found = written(shared.where(F.col("gram").isNotNull() | (F.col("sets") > 2) | reach).select("gram", "pivot", "fp", "n"))
    busy = found.where("gram is not null")
    pivots = busy.groupBy("gram").agg(F.min("pivot").alias("pivot"))
    of_busy = busy.select("gram", "fp", "n").join(pivots, "gram").select("pivot", "fp", "n")
    dealt = written(found.where("gram is null").select("pivot", "fp", "n").unionByName(of_busy).distinct())
    discard(found)
    return dealt


def may_link(sizes: list[int], ranges: list[bytes | None], percent: int) -> list[bool]:
    """For each set of a group whether the counts by range leave an overlap with another one that reaches the threshold."""
    order = sorted(range(len(sizes)), key=lambda i: sizes[i])
    counts = [None if r is None else np.frombuffer(r, np.uint8).astype(np.int32) for r in ranges]
    keep = [False] * len(sizes)
    for at, i in enumerate(order):
        for j in order[at + 1 :]:
            if sizes[j] * percent > 100 * sizes[i]:
                break
            if keep[i] and keep[j]:
                continue
            x, y = counts[i], counts[j]
            if x is not None and y is not None:
                y = y.reshape(len(x), -1).sum(axis=1)
                if int(np.minimum(x, y).sum()) < least_overlap(sizes[i], sizes[j], percent):
                    continue
            keep[i] = keep[j] = True
    return keep


def bounded(dealt: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """dealt without the sets that can't reach the threshold with another set of their group.

    Groups of over BOUNDED sets stay whole and don't come together in a task here.
    """
    sizes = dealt.groupBy("pivot").agg(F.count(F.lit(1)).alias("sets"))
    whole = sizes.where(F.col("sets") > BOUNDED).select("pivot")
    rows = dealt.join(whole, "pivot", "left_anti").join(reps.select("fp", "ranges"), "fp").select("pivot", "fp", "n", "ranges")
    grouped = rows.repartition("pivot").sortWithinPartitions("pivot")

    def run(batches):
        pivot, group = None, []

        def close():
            return [x[:2] for x, ok in zip(group, may_link([x[1] for x in group], [x[2] for x in group], percent)) if ok]

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1][0] for x in out], pa.int64()), pa.array([x[1][1] for x in out], pa.int32())], names=["pivot", "fp", "n"])

        for batch in batches:
            out = []
            for p, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if p != pivot:
                    out += [(pivot, x) for x in close()]
                    pivot, group = p, []
                group.append(row)
            yield batch_of(out)
        yield batch_of([(pivot, x) for x in close()])

    return grouped.mapInArrow(run, "pivot long, fp long, n int").unionByName(dealt.join(whole, "pivot", "left_semi").select("pivot", "fp", "n"))


def large_groups(dealt: DataFrame) -> DataFrame:
    """(pivot, blocks) of the groups of more than one block."""
    sizes = dealt.groupBy("pivot").agg(F.sum("n").alias("grams"))
    return sizes.where(F.col("grams") > BLOCK_GRAMS).select("pivot", F.ceil(F.col("grams") / BLOCK_GRAMS).cast("int").alias("blocks"))


def block_of(blocks_: Column) -> Column:
    return F.pmod(F.xxhash64("fp"), blocks_).cast("int")


def first_keys(dealt: DataFrame, large: DataFrame) -> DataFrame:
    """(pivot, low, high, probe, fp): every block of a group by itself, each with the pivot in it."""
    rows = dealt.join(large, "pivot", "left")
    blocks_ = F.coalesce("blocks", F.lit(1))
    places = F.when(F.col("fp") == F.col("pivot"), F.sequence(F.lit(0), blocks_ - 1)).otherwise(F.array(block_of(blocks_)))
    return rows.select("pivot", "fp", F.explode(places).alias("low")).select("pivot", "low", F.col("low").alias("high"), F.lit(True).alias("probe"), "fp")


def second_keys(dealt: DataFrame, large: DataFrame, roots: DataFrame) -> DataFrame:
    """(pivot, low, high, probe, fp): the pairs of blocks of a large group, for the sets that the first round didn't link with the pivot.

    These are probes; a block goes to another one only for the other's probes.
    """
    named = roots.select(F.col("node").alias("fp"), "root")
    of_pivot = large.join(named, F.col("pivot") == F.col("fp"), "left").select("pivot", "blocks", F.coalesce("root", "pivot").alias("pivot_root"))
    rows = dealt.join(of_pivot, "pivot").join(named, "fp", "left")
    rows = rows.select("pivot", "fp", "blocks", block_of(F.col("blocks")).alias("block"), (F.coalesce("root", "fp") != F.col("pivot_root")).alias("probe"))
    open_ = rows.where("probe").groupBy("pivot").agg(F.collect_set("block").alias("open"))
    others = F.when(F.col("probe"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.col("open"))
    rows = rows.join(open_, "pivot").select("pivot", "fp", "block", "probe", F.explode(others).alias("other")).where("block <> other")
    return rows.select("pivot", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "probe", "fp")


def links(rows: DataFrame, keys: DataFrame, reps: DataFrame, order: Broadcast, words: int, percent: int) -> DataFrame:
    """(a, b): links between fingerprints that join all that the threshold joins within each key (pivot, low, high).

    The text of one document of each set is sent once a key.
    """
    wanted = keys.groupBy("fp").agg(F.collect_list(F.struct("pivot", "low", "high", "probe")).alias("keys"))
    wanted = wanted.join(reps.select("fp", "k1", "k2"), "fp")
    texts = rows.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).select("fp", "text", F.explode("keys").alias("key")).select("key.*", "fp", "text")
    dealt = texts.repartition("pivot", "low", "high").sortWithinPartitions("pivot", "low", "high")

    def run(batches):
        hasher, ranks = Hasher(), restored(Order, order.value)
        key, fps, sets, probes = None, {}, [], []

        def close():
            names = list(fps)
            return [(names[i], names[j]) for i, j in spanning_links(sets, percent, probes)]

        for batch in batches:
            out = []
            columns = [c.to_pylist() for c in batch.columns[:5]]
            for lo, hi, data, offsets in blocks(batch.column(5)):
                for at, grams in zip(range(lo, hi), shingle_sets(hasher, data, offsets, words)):
                    pivot, low, high, probe, fp = (c[at] for c in columns)
                    if (pivot, low, high) != key:
                        out += close()
                        key, fps, sets, probes = (pivot, low, high), {}, [], []
                    if fp not in fps:
                        if probe:
                            probes.append(len(sets))
                        fps[fp] = None
                        sets.append(ranks.ranked(grams))
            yield batch_of_links(out)
        yield batch_of_links(close())

    return dealt.mapInArrow(run, "a long, b long")


def batch_of_links(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])


def classes_and_roots(rows: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A row for each document (profiles), for each set that isn't empty (fp, n, least_id, k1, k2), and for each linked set (node, root)."""
    profile = written(profiles(rows, words))
    reps = written(
        profile.where("n > 0")
        .groupBy("fp", "n")
        .agg(F.min("doc_id").alias("least_id"), F.min(F.struct("k1", "k2")).alias("k"), F.first("ranges").alias("ranges"), F.count(F.lit(1)).alias("docs"))
        .select("fp", "n", "least_id", "k.*", "ranges", "docs")
    )
    order = rows.sparkSession.sparkContext.broadcast(vars(global_order(rows, words)))
    shared = dealt_sets(prefixes(rows, order, words, percent), percent)
    dealt = written(bounded(shared, reps, percent))
    discard(shared)
    large = written(large_groups(dealt))
    first = written(links(rows, first_keys(dealt, large), reps, order, words, percent))
    if large.isEmpty():
        roots = components(first)
    else:
        keys = written(second_keys(dealt, large, components(first)))
        roots = components(first.unionByName(links(rows, keys, reps, order, words, percent)))
        discard(keys)
    discard(dealt, large, first)
    return profile, reps, roots


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs.

    Sets link when 100 * intersection >= percent * union; component_id is the
    least doc_id that links reach. Null texts and texts without words have
    empty sets and are linked with nothing. Rows with a null doc_id join
    components but never name one; a component of them alone has a null id.
    Repeated rows count as documents of their own.
    """
    profile, reps, roots = classes_and_roots(keyed(docs), words, percent)
    named = roots.join(reps.select(F.col("fp").alias("node"), "least_id"), "node")
    of_root = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = named.join(of_root, "root").select(F.col("node").alias("fp"), "component_id")
    of_fp = written(reps.select("fp", "least_id", "docs").join(named, "fp", "left").select(F.col("fp").alias("of"), F.coalesce("component_id", "least_id").alias("component_id"), "docs"))
    # sets with a thousandth of the documents or more, a thousand at most, are broadcast; the others are no hot keys
    hot = F.col("docs") * 1000 >= (of_fp.agg(F.sum("docs")).first()[0] or 0)
    same, columns = F.col("fp") == F.col("of"), ["doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id"]
    frequent, filled = F.broadcast(of_fp.where(hot).select("of", "component_id")), profile.where("n > 0").select("doc_id", "n", "fp")
    first = filled.join(frequent, same).select(*columns)
    rest = filled.join(frequent.select("of"), same, "left_anti").join(of_fp.where(~hot), same).select(*columns)
    return first.unionByName(rest).unionByName(profile.where("n = 0").select(columns[0], columns[1], F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each component, with all its columns: that of the least doc_id (null first).

    Of rows with equal doc_id and text one stays. Rows without words are linked with
    nothing and all stay.
    """
    rows = keyed(docs)
    _, reps, roots = classes_and_roots(rows, words, percent)
    grouped = reps.select("fp", F.struct("k1", "k2").alias("k")).join(roots, F.col("fp") == F.col("node"), "left")
    kept = written(grouped.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("k").alias("k")).select("k.*"))
    k1, k2, place = (free_name(docs, x) for x in ("_k1", "_k2", "_place"))
    text, id_ = F.col("text").cast("string"), F.col("doc_id").cast("long")
    empty = ~F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keys = kept.select(F.col("k1").alias(k1), F.col("k2").alias(k2))
    named = docs.where(~empty).withColumn(k1, F.coalesce(id_, F.lit(-(2**63)))).withColumn(k2, F.xxhash64(text))
    first = Window.partitionBy(k1, k2).orderBy(F.lit(0))
    stay = named.join(keys, [k1, k2], "left_semi").withColumn(place, F.row_number().over(first)).where(F.col(place) == 1)
    return stay.select(*docs.columns).unionByName(docs.where(empty))
