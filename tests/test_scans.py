"""Folds over ranges against plain loops, on keys that span many ranges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import rewards, scans


def loop(fold, rows):
    state, out = fold.start, []
    for at, values in rows:
        state, row = fold.step(state, values)
        if row is not None:
            out.append((at, row))
    return out


FOLDS = {"discounted": (scans.discounted(0.9, 0.5), 2), "advantages": (scans.advantages(0.99, 0.95, 0.2), 3), "hysteresis": (scans.hysteresis(0.4), 1), "rates": (scans.rates(3.0), 1), "limited": (scans.limited(0.6), 1)}


@pytest.mark.parametrize("name", FOLDS)
def test_against_loop(spark, name):
    """One key with most rows, keys of one row, a null key; as many ranges as there are partitions."""
    fold, width = FOLDS[name]
    rng = random.Random(4)
    rows, clock = [], 0.0
    for i in range(900):
        clock += rng.choice([0.01, 0.3, 2.0])
        key = 5 if i < 700 else None if i < 720 else i
        rows.append((key, i, *([clock] if name in ("rates", "limited") else [rng.uniform(-1, 2) for _ in range(width)])))
    df = spark.createDataFrame(rows, "k long, t long, " + ", ".join(f"v{i} double" for i in range(width))).repartition(3)
    got = scans.scanned(df, "k", F.col("t"), [F.col(f"v{i}") for i in range(width)], fold, "t")
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[1], r[2:]))
    want = {(k, at): row for k, rs in by.items() for at, row in loop(fold, rs)}
    have = {(r[0], r[1]): tuple(r[2:]) for r in got.collect()}
    assert set(have) == set(want)
    for k, row in want.items():
        assert have[k] == pytest.approx(row, rel=1e-12, abs=1e-12)


def test_ranges_are_folded_apart(spark):
    """No task holds the only key, and what came before is carried through ranges that hold nothing else."""
    df = spark.range(4000).select(F.lit("e").alias("k"), F.col("id").alias("t"), F.lit(1.0).alias("r"))
    got = scans.scanned(df, "k", -F.col("t"), [F.col("r"), F.lit(1.0)], scans.discounted(1.0), "back")
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000
    assert {-r.back: r.ret for r in got.collect()} == {t: 4000.0 - t for t in range(4000)}


def test_limiter():
    """Up to two periods are made up for; the first request waits a period, and a request waits for the one before."""
    fold = scans.limited(1.0)
    got = [row[0] for _, row in loop(fold, [(i, (t,)) for i, t in enumerate([0.0, 0.1, 0.2, 10.0, 10.0, 10.0, 10.0])])]
    assert got == pytest.approx([1.0, 2.0, 3.0, 10.0, 10.0, 11.0, 12.0])


def test_empty_and_nulls(spark):
    df = spark.createDataFrame([], "k long, t long, v double")
    assert scans.scanned(df, "k", F.col("t"), [F.col("v")], scans.hysteresis(1.0)).count() == 0
    one = spark.createDataFrame([(1, 1, None)], "k long, t long, v double")
    assert scans.scanned(one, "k", F.col("t"), [F.col("v")], scans.hysteresis(1.0)).first()["add"] == 0.0 and math.isnan(scans.hysteresis(1.0).start[0])


def test_joint_reward():
    """Nearer to the handle, gripped rightly, the joint moved, arrived once, back to rest; and a wrong grip, held from the start."""
    fold = rewards.articulated(1.0, 10.0, 5.0, 7.0, 20.0, 2.0, 3.0)
    rows = [(0.0, 0, 0, 4.0, 1.0, 0), (0.0, 0, 0, 3.0, 1.0, 0), (0.0, 1, 1, 0.0, 2.0, 0), (0.5, 1, 1, 0.0, 2.0, 0), (1.0, 1, 1, 0.0, 3.0, 1), (1.0, 0, 0, 1.0, 1.0, 1)]
    assert [x[0] for _, x in loop(fold, enumerate(rows))] == [0.0, 3.0, 5.0, 5.0, 18.0, 4.0]
    assert [x[0] for _, x in loop(fold, enumerate([(0.0, 0, 0, 1.0, 0.0, 0), (0.0, 1, 0, 1.0, 0.0, 0), (0.0, 0, 0, 1.0, 0.0, 0), (0.0, 1, 0, 1.0, 0.0, 0)]))] == [0.0, -7.0, 0.0, 0.0]
    assert [x[0] for _, x in loop(fold, enumerate([(0.0, 1, 0, 1.0, 0.0, 0), (0.0, 1, 0, 1.0, 0.0, 0)]))] == [0.0, 0.0]


def test_moving_reward():
    """The first object is fetched and put down, then the second counts, with its own pick; a second grip of the first pays nothing."""
    fold = rewards.moving(2, 1.0, 4.0, 9.0, 0.5)
    rows = [(-1, 5.0, 8.0, 3.0, 2.0), (-1, 5.0, 8.0, 1.0, 2.0), (0, 5.0, 8.0, 0.0, 2.0), (-1, 5.0, 8.0, 0.5, 2.0), (0, 1.0, 8.0, 0.0, 2.0), (-1, 0.2, 8.0, 0.1, 6.0), (1, 0.2, 7.0, 0.1, 0.0), (1, 0.2, 3.0, 0.1, 0.0)]
    assert [round(x[0], 9) for _, x in loop(fold, enumerate(rows))] == [0.0, 2.0, 4.0, -0.5, 4.0, 8.9, 5.0, 4.0]
