"""Every query with SQL gives the rows that DuckDB gives for it."""

from __future__ import annotations

import math

import pytest

import __spark_entry__ as entry
from tessera.plans import relational
from tessera.streaming import events

SQL = {name: sql for module in entry.OWN for name, sql in module.SQL.items()}
QUERIES = {name: query for module in entry.OWN for name, query in module.QUERIES.items()}


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return str(x) if not isinstance(x, (int, str, type(None))) else x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([value(r[i]) for i in order] for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    other = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(other.columns)
    mine, theirs = rows(df.columns, df.collect()), rows(other.columns, other.fetchall())
    assert mine == theirs
    assert mine


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 113
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_approx_is_near(spark, small):
    exact = {r[0]: r[1] for r in relational.distinct_parts(spark, small).collect()}
    for flag, n in relational.approx_parts(spark, small).collect():
        assert abs(n - exact[flag]) <= 0.1 * exact[flag]


def test_tumbling_stream_is_part_of_batch(spark, small):
    batch = {(r["start"].isoformat()[:19], r["n"]) for r in relational.tumbling_counts(spark, small).collect()}
    stream = {(r["start"].isoformat()[:19], r["n"]) for r in events.stream_tumbling(spark, small).collect()}
    assert stream < batch and len(batch - stream) <= 2
