"""Nested events by ranks, against comparing all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import profile

SCHEMA = "id long, name string, thread long, start long, end long"


def events(n, seed, threads, span, longest):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = rng.randrange(span)
        out.append((i, rng.choice("abc"), rng.choice(threads), s, s + rng.randrange(longest)))
    return out


def ordered(rows):
    by = {}
    for r in rows:
        if r[3] is not None and r[4] is not None:
            by.setdefault(r[2], []).append(r)
    return {t: sorted(rs, key=lambda r: (r[3], -r[4], r[0])) for t, rs in by.items()}


def pairs(rows):
    return sorted((t is None, t or 0, i + 1, j + 1) for t, rs in ordered(rows).items() for i, a in enumerate(rs) for j, b in enumerate(rs) if j > i and b[3] <= a[4])


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_nested(spark, block):
    """Ties of starts and ends, events without length or with an end before their start, a null thread, missing times, a hot thread."""
    rows = events(150, 1, [1, 1, 1, 1, 2, None], 60, 25) + [(200 + i, "x", 3, 5, 5) for i in range(6)]
    rows += [(300, "x", 4, 9, 2), (301, "x", 4, 3, 20), (302, "x", 4, None, 7), (303, "x", 4, 5, None), (304, None, 1, 0, 100)]
    got = profile.nested(spark.createDataFrame(rows, SCHEMA).repartition(3), block)
    assert sorted((r.thread is None, r.thread or 0, r.parent, r.child) for r in got.collect()) == pairs(rows)
    assert got.dtypes == [("thread", "bigint"), ("parent", "bigint"), ("child", "bigint")]


def test_order(spark):
    rows = events(120, 2, [7, 7, 7, None, 8], 30, 9)
    got = {(r.thread, r.id): r.position for r in profile.event_order(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(t, r[0]): i + 1 for t, rs in ordered(rows).items() for i, r in enumerate(rs)}


def test_hot_thread_is_spread(spark):
    """One event around all others of the only thread: its children come from all tasks."""
    rows = [(0, "root", 1, 0, 10_000)] + [(i, "leaf", 1, i, i) for i in range(1, 4000)]
    got = profile.nested(spark.createDataFrame(rows, SCHEMA), block=64)
    per = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(per) == 3999 and len(per) > 1 and max(per) < 2400


def test_long_events_plan(spark):
    """Levels of blocks are read once each: the plan grows with their number, not with 2 to its power."""
    lines = []
    for n in (64, 4096):
        rows = [(0, "root", 1, 0, n * 10)] + [(i, "leaf", 1, 10 * i, 10 * i + 5) for i in range(1, n)]
        out = profile.exclusive(spark.createDataFrame(rows, SCHEMA), cell=1)
        lines.append(out._jdf.queryExecution().analyzed().toString().count("\n"))
        assert {r.name: r.own for r in out.collect()} == {"root": n * 10 - 5 * (n - 1), "leaf": 5 * (n - 1)}
    assert lines[1] < 3 * lines[0]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert profile.nested(none).count() == profile.event_order(none).count() == profile.exclusive(none).count() == 0
