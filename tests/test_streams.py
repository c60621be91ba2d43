"""Funnel state over several batches out of order, and the account of late rows."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.streaming import events, funnels, replay

START = datetime(2024, 1, 1)
LIMIT = 3600 * 1_000_000


def loop(rows, until):
    """Funnels of one user by a plain loop over events in order."""
    out, opened, clicked, views = [], None, None, 0
    for at, _, kind in sorted(rows):
        if opened is not None and at > opened + LIMIT:
            out.append((opened, clicked, None, views))
            opened = None
        if opened is None:
            if kind == "view":
                opened, clicked, views = at, None, 1
        elif kind == "view":
            views += 1
        elif kind == "click" and clicked is None:
            clicked = at
        elif kind == "purchase" and clicked is not None:
            out.append((opened, clicked, at, views))
            opened = None
    if opened is not None and opened + LIMIT <= until:
        out.append((opened, clicked, None, views))
    return out


def random_events(n, seed):
    rng = random.Random(seed)
    return [(i, START + timedelta(seconds=rng.randrange(0, 40_000, 50)), rng.choice([1, 2, None]), rng.choice(["view", "click", "purchase", "error"])) for i in range(n)]


@pytest.mark.parametrize("cuts", [1, 7])
def test_advance_in_steps(cuts):
    """However the events of a user are cut, the funnels are the same; ties in time go by id."""
    micros = lambda t: int((t - START).total_seconds() * 1_000_000)
    rows = [(micros(at), i, kind) for i, at, _, kind in random_events(150, 4)]
    ends = sorted({r[0] for r in rows})[:: max(1, 150 // cuts)] + [10**11]
    state, got, before = None, [], -1
    for end in ends:
        state, ended = funnels.advance(state, [r for r in rows if before < r[0] <= end], end, LIMIT)
        got += ended
        before = end
    assert got == loop(rows, 10**11) and state is None and len(got) > 10


class Handle:
    """A user's states and timers in memory, and the number of calls on them: each is a round trip in a stream."""

    def __init__(self):
        self.values, self.timers, self.calls, self.mark = {}, [], 0, 0

    def _state(self, name, *_):
        handle = self

        class State:
            def __getattr__(self, call):
                handle.calls += 1
                held = handle.values
                return {
                    "get": lambda: iter(list(held[name])) if isinstance(held.get(name), list) else held.get(name) or (() if name == "pending" else None),
                    "exists": lambda: name in held,
                    "appendValue": lambda x: held.setdefault(name, []).append(x),
                    "put": lambda x: held.update({name: list(x)}),
                    "update": lambda x: held.update({name: x}),
                    "clear": lambda: held.pop(name, None),
                    "iterator": lambda: iter(held.setdefault(name, {}).items()),
                    "updateValue": lambda k, x: held.setdefault(name, {}).update({k: x}),
                    "removeKey": lambda k: held[name].pop(k),
                }[call]

        return State()

    getListState = getValueState = getMapState = _state

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return self.mark


def test_a_batch_of_a_user_takes_few_calls_on_the_state(monkeypatch):
    """Blocks smaller than a batch, events left over by a watermark inside a block: the funnels of the loop, in calls that don't grow with the events."""
    micros = lambda t: int((t - START).total_seconds() * 1_000_000)
    rows = [(micros(at), i, kind) for i, at, _, kind in random_events(900, 12)]
    line = Row("user_id", "ts", "at", "event_id", "event_type")
    handle, user = Handle(), funnels.Funnels(LIMIT)
    monkeypatch.setattr(funnels, "BLOCK", 100, raising=False)
    user.init(handle)
    got = []
    for part, mark in ((rows[:600], 15_000_000), (rows[600:], 10**9)):
        part = [r for r in part if r[0] > handle.mark * 1000]
        list(user.handleInputRows((1,), (line(1, None, *r) for r in part), handle))
        handle.mark = mark
        got += [(r.opened, r.clicked, r.bought, r.n_views) for r in user.handleExpiredTimer((1,), handle, None)]
    want = rows[:600] + [r for r in rows[600:] if r[0] > 15_000_000_000]
    assert got == loop(want, 10**12) and len(got) > 10 and handle.calls < 30


def test_funnels_out_of_order(spark, tmp_path):
    """Batches that overlap in time, run with stops between them: as the loop over all events that weren't late."""
    rows = random_events(240, 9)
    rng = random.Random(1)
    order = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rng.randrange(0, 900)))
    source = None
    for k in range(4):
        spark.createDataFrame(order[60 * k : 60 * k + 60], "event_id long, ts timestamp_ntz, user_id long, event_type string").write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string").parquet(str(tmp_path / "in"))
        stream = source.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "15 minutes")
        spark.conf.set(events._STORE, events._ROCKSDB)
        try:
            query = funnels.funnels(stream, LIMIT).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            spark.conf.unset(events._STORE)
    until = max(r[1] for r in rows) - timedelta(minutes=15)
    want = []
    for user in (1, 2, None):
        mine = [(int((at - START).total_seconds() * 1_000_000), i, kind) for i, at, u, kind in rows if u == user and at <= until]
        for opened, clicked, bought, views in loop(mine, int((until - START).total_seconds() * 1_000_000)):
            time = lambda x: None if x is None else START + timedelta(microseconds=x)
            want.append((user, time(opened), time(clicked), time(bought), views, "bought" if bought is not None else "clicked" if clicked is not None else "viewed"))
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and {r[5] for r in got} == {"bought", "clicked", "viewed"}


def test_replay_accounts_for_every_row(spark):
    """On time and dropped rows are the input; Spark's own count of dropped rows agrees; null times, one time for many, an empty table."""
    data = [(i, START + timedelta(minutes=10 * i)) for i in range(600)] + [(1000 + i, START) for i in range(5)] + [(2000, None)]
    table = spark.createDataFrame(data, "event_id long, ts timestamp_ntz")
    rows = replay.sliced(table).withColumn("slice", F.coalesce("slice", F.lit(2)))
    judged, dropped = replay.replayed(rows)
    found = judged.collect()
    assert sorted((r.event_id for r in found)) == sorted(d[0] for d in data)
    late = {r.event_id for r in found if not r.on_time}
    assert len(late) == dropped > 0
    marks = {}
    for r in found:
        if r.ts is not None:
            marks[r.slice] = max(r.ts, marks.get(r.slice, r.ts))
    for r in found:
        before = [m for k, m in marks.items() if k < r.slice]
        assert (r.event_id in late) == bool(r.ts is not None and before and r.ts <= max(before) - timedelta(minutes=10))
    none, dropped = replay.replayed(replay.sliced(table.where("event_id < 0")), slices=2)
    assert none.count() == dropped == 0
