"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions alone.

A source's rows are cut into blocks. Time runs in slots, one block each. In the ideal
mix the sources that aren't used up run at the same time, in proportion to their exact
weights. A block has the slot in which the ideal mix begins it as its release time and
the end of the slot in which that is done with it as its deadline; in each slot, of the
released blocks the one with the earliest deadline goes. At any slot a source is then
less than one block away from the ideal mix, however many slots there are. The
schedule is drawn up in whole numbers, on the driver, by a heap of one block a source;
it has three numbers a block, and blocks grow with the table so that there are about a million at most.

With a length for ``frame``, time runs in frames of about so many slots in which a source
has a whole number of blocks, in proportion to its weight, one at least, until it is
used up; frames of one composition have one schedule. Inside a frame of L slots, block j
of the m blocks of a source has the release time floor(j L / m) and the deadline
ceil((j + 1) L / m). The bound then holds for the share that is rounded to whole blocks a frame; the
distance from the true weight grows with the number of frames unless they divide the frame exactly.
"""

from __future__ import annotations

from array import array
from fractions import Fraction
from heapq import heapify, heappop, heappush
from math import lcm

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, numbered

#: Rows of a block at least; a block has more where there would be over MOST_BLOCKS blocks (24 bytes each in the schedule).
BLOCK_ROWS = 16
MOST_BLOCKS = 1 << 20
#: Blocks in one row of the table of the schedule.
CHUNK = 1024
BUCKETS = 1024
COLUMNS = ["mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_seq"]
#: Up to so many sources the schedule's tables are broadcast (below 6 million slots), else they are joined by a shuffle.
BROADCAST_SOURCES = 256
#: Up to so many blocks (24 bytes each) the schedule is broadcast.
BROADCAST_BLOCKS = MOST_BLOCKS + BROADCAST_SOURCES

_EDF = """
aggregate(
  sequence(0L, length - 1),
  named_struct('next', transform(parts, p -> 0L), 'out', cast(array() as array<struct<part:int,block:bigint>>)),
  (state, slot) -> transform(
    array(array_min(filter(
      transform(state.next, (j, i) -> named_struct(
        'deadline', -((-(j + 1) * length) div parts[i].blocks),
        'part', i,
        'block', j,
        'ready', j < parts[i].blocks and (j * length) div parts[i].blocks <= slot)),
      c -> c.ready))),
    best -> named_struct(
      'next', transform(state.next, (j, i) -> if(i = best.part, j + 1, j)),
      'out', concat(state.out, array(named_struct('part', best.part, 'block', best.block)))))[0]
).out
"""


def rows_in_block(docs: DataFrame) -> int:
    """BLOCK_ROWS, or more where a table is so large that the schedule would have over MOST_BLOCKS blocks."""
    return max(BLOCK_ROWS, -(-docs.count() // MOST_BLOCKS))


def source_plan(docs: DataFrame, source: str, weights: DataFrame | None, block_rows: int, frame: int | None) -> DataFrame:
    """A row for each source: blocks, weight and, with frames, its share: the blocks of a full frame."""
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("rows"))
    if weights is None:
        counts = counts.withColumn("weight", F.sqrt("rows"))
    else:
        finite = F.when(F.col("weight").cast("double") < float("inf"), F.col("weight").cast("double"))
        named = weights.groupBy(F.col("source").alias("of")).agg(F.max(finite).alias("weight"))
        mean = named.where("weight > 0").agg(F.avg("weight")).scalar()
        counts = counts.join(named, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        counts = counts.withColumn("weight", F.coalesce(F.when(F.col("weight") > 0, F.col("weight")), mean, F.lit(1.0)))
    blocks = ((F.col("rows") + (block_rows - 1)) / block_rows).cast("long").alias("blocks")
    if frame is None:
        return counts.select("source", blocks, "weight")
    total = counts.agg(F.sum("weight")).scalar()
    return counts.select(
        "source",
        blocks,
        "weight",
        F.greatest(F.lit(1), F.round(F.col("weight") / total * frame)).cast("long").alias("share"),
    )


def exact_schedule(sources: list[tuple[int, float]]) -> list[tuple[array, array, array]]:
    """(slot, release, deadline) of each block of each source, sources being (blocks, weight)."""
    exact = [Fraction(weight) for _, weight in sources]
    scale = lcm(*[x.denominator for x in exact])
    blocks, weight = [n for n, _ in sources], [int(x * scale) for x in exact]
    ends = sorted(range(len(sources)), key=lambda i: Fraction(blocks[i], weight[i]))
    out = []
    for mine, w in zip(blocks, weight):
        # begun[j] and done[j]: the slots in which the ideal mix comes to j blocks, rounded down and up
        begun, done = array("q"), array("q")
        used, running, j = 0, sum(weight), 0
        for i in ends:
            until = min(mine, -(-blocks[i] * w // weight[i]))
            begun.extend(used + running * k // w for k in range(j, until))
            done.extend(used - (-running * k // w) for k in range(j, until))
            used, running, j = used + blocks[i], running - weight[i], max(j, until)
            if j == mine:
                break
        # all that is left ends together with this source or later
        total = sum(min(Fraction(n), Fraction(mine * v, w)) for n, v in zip(blocks, weight))
        done.append(-(-total.numerator // total.denominator))
        out.append((array("q"), begun, done[1:]))
    coming, ready = [(0, i) for i in range(len(sources))], []
    heapify(coming)
    for slot in range(sum(blocks)):
        while coming and coming[0][0] <= slot:
            i = heappop(coming)[1]
            heappush(ready, (out[i][2][len(out[i][0])], i))
        i = heappop(ready)[1]
        slots, begun, _ = out[i]
        slots.append(slot)
        if len(slots) < blocks[i]:
            heappush(coming, (begun[len(slots)], i))
    return out


def with_exact_times(rows: DataFrame, source: str, plan: DataFrame) -> DataFrame:
    """rows with the release, deadline and slot of their mix_block."""
    spark, known = rows.sparkSession, plan.orderBy("source").collect()
    own = {c: free_name(rows, "_mix_" + c) for c in ("source", "of", "at", "piece", "slot", "release", "deadline")}
    times = exact_schedule([(r["blocks"], r["weight"]) for r in known])
    pieces = [(i, lo // CHUNK) for i, r in enumerate(known) for lo in range(0, r["blocks"], CHUNK)]
    rows_of = [(i, c, *[times[i][k][c * CHUNK : (c + 1) * CHUNK].tolist() for k in range(3)]) for i, c in pieces]
    kinds = [T.IntegerType(), T.LongType()] + [T.ArrayType(T.LongType())] * 3
    schema = T.StructType([T.StructField(own[c], k) for c, k in zip(("at", "piece", "slot", "release", "deadline"), kinds)])
    table = spark.createDataFrame(rows_of, schema, verifySchema=False)
    names = spark.createDataFrame([(r["source"], i) for i, r in enumerate(known)], T.StructType([T.StructField(own["source"], plan.schema["source"].dataType), T.StructField(own["of"], T.IntegerType())]))
    names = F.broadcast(names) if len(known) <= BROADCAST_SOURCES else names
    table = F.broadcast(table) if sum(r["blocks"] for r in known) <= BROADCAST_BLOCKS else table
    rows = rows.join(names, F.col(source).eqNullSafe(F.col(own["source"])), "left")
    rows = rows.join(table, (F.col(own["of"]) == F.col(own["at"])) & (F.floor(F.col("mix_block") / CHUNK) == F.col(own["piece"])), "left")
    place = F.pmod(F.col("mix_block"), F.lit(CHUNK)).cast("int")
    for c in ("slot", "release", "deadline"):
        rows = rows.withColumn("mix_" + c, F.col(own[c])[place])
    return rows.drop(*own.values())


def frame_schedules(plan: DataFrame) -> DataFrame:
    """(phase, source, block, slot, first, length, in_frame): the schedule of one frame for each composition of frames.

    A composition holds from frame ``phase`` to the next phase; ``first`` is the slot
    where that frame begins, length its slots, in_frame the source's blocks in it.
    """
    ends = F.expr("blocks div share")
    breaks = plan.select(F.explode(F.array(F.lit(0).cast("long"), ends, ends + 1)).alias("phase")).distinct()
    every = breaks.agg(F.array_sort(F.collect_set("phase"))).scalar()
    parts = plan.select("source", "blocks", "share", F.explode(every).alias("phase"))
    used = F.least(F.col("blocks"), F.col("phase") * F.col("share"))
    now = F.least(F.col("blocks"), (F.col("phase") + 1) * F.col("share")) - used
    parts = parts.withColumn("used", used).withColumn("now", now)
    phases = (
        parts.groupBy("phase")
        .agg(
            F.sum("used").alias("first"),
            F.sum("now").alias("length"),
            F.array_sort(F.collect_list(F.when(F.col("now") > 0, F.struct("source", F.col("now").alias("blocks"))))).alias("parts"),
        )
        .where("length > 0")
    )
    slots = phases.select("phase", "first", "length", "parts", F.posexplode(F.expr(_EDF)).alias("slot", "pick"))
    part = F.col("parts")[F.col("pick")["part"]]
    return slots.select(
        "phase",
        part["source"].alias("source"),
        F.col("pick")["block"].alias("block"),
        F.col("slot").cast("long").alias("slot"),
        "first",
        "length",
        part["blocks"].alias("in_frame"),
    )


def mix_sources(
    docs: DataFrame,
    source: str = "source",
    id_column: str = "doc_id",
    weights: DataFrame | None = None,
    block_rows: int | None = None,
    frame: int | None = None,
) -> DataFrame:
    """All rows with mix_block, mix_release, mix_deadline, mix_slot and mix_seq added: read them by (mix_slot, mix_seq).

    ``weights`` has (source, weight); the greatest of several holds, a source
    without one (or with one of 0 or less, or null) has the mean of the others. Without a table
    the weight is the root of the source's rows. Rows with a null source are a source. Rows
    of a source come in the order of a hash bucket of all their columns and the id; rows alike in
    every column in any order. The last block of a source may be short; ``block_rows`` is rows_in_block() by default. No row is left out.
    Weights that aren't finite count as none. With ``frame`` weights are rounded to blocks a frame.
    Columns of the five names are replaced. Empty tables stay empty.
    """
    docs = docs.drop(*COLUMNS)
    block_rows = block_rows or rows_in_block(docs)
    plan = source_plan(docs, source, weights, block_rows, frame)
    small = docs.select(source).distinct().count() <= BROADCAST_SOURCES
    sized = F.broadcast if small else (lambda x: x)
    rank = free_name(docs, "_rank")
    # all columns, so that rows that share an id (or have none) are spread over the buckets
    every = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()], F.lit("mix"))
    rows = numbered(docs, [source], F.pmod(every, F.lit(BUCKETS)), [F.col(id_column), every], rank, buckets=BUCKETS, few=small)
    rows = rows.withColumn("mix_block", F.floor(F.col(rank) / block_rows)).withColumn("mix_seq", F.pmod(F.col(rank), F.lit(block_rows)).cast("int"))
    if frame is None:
        return with_exact_times(rows.drop(rank), source, plan)
    ends = F.expr("blocks div share")
    breaks = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(F.lit(0).cast("long"), ends, ends + 1)))))
    every = plan.agg(breaks).scalar()
    names = {c: free_name(rows, f"_mix_{c}") for c in ("source", "share", "breaks", "phase", "block", "slot", "first", "length", "in_frame", "j", "frame", "of")}
    shares = plan.select(F.col("source").alias(names["source"]), F.col("share").alias(names["share"]), every.alias(names["breaks"]))
    rows = rows.join(sized(shares), F.col(source).eqNullSafe(F.col(names["source"])), "left").drop(names["source"])
    share, block = F.col(names["share"]), F.col("mix_block")
    rows = rows.withColumn(names["frame"], F.floor(block / share)).withColumn(names["j"], F.pmod(block, share))
    phase = F.array_max(F.filter(F.col(names["breaks"]), lambda b: b <= F.col(names["frame"])))
    rows = rows.withColumn(names["of"], phase)
    times = frame_schedules(plan).select(*[F.col(c).alias(names[c]) for c in ("phase", "source", "block", "slot", "first", "length", "in_frame")])
    match = [
        F.col(names["of"]) == F.col(names["phase"]),
        F.col(names["j"]) == F.col(names["block"]),
        F.col(source).eqNullSafe(F.col(names["source"])),
    ]
    rows = rows.join(sized(times), match, "left")
    base = F.col(names["first"]) + (F.col(names["frame"]) - F.col(names["of"])) * F.col(names["length"])
    j, length, m = F.col(names["j"]), F.col(names["length"]), F.col(names["in_frame"])
    return (
        rows.withColumn("mix_slot", base + F.col(names["slot"]))
        .withColumn("mix_release", base + F.floor(j * length / m))
        .withColumn("mix_deadline", base + F.ceil((j + 1) * length / m))
        .drop(rank, *names.values())
    )
