"""Rows that share a place are compared once; rays go no further than they show; the sign of a zero."""

import itertools
import math
import random
import re

from pyspark.sql import functions as F

from tessella.functions import geometry
from tessella.operators import spatial
from tessella.plans import frame_queries, sensor_queries, world_queries

rng = random.Random(4)
SPOTS = [(rng.randrange(9) / 2, 0.0, rng.randrange(9) / 2) for _ in range(12)]
ROWS = [(i, *SPOTS[i % 12]) for i in range(40)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "id long, x double, y double, z double")


def apart(a, b):
    return math.dist(a[1:], b[1:])


def counted(monkeypatch):
    """Rows that `within` is given on its left."""
    sizes, own = [], spatial.within
    monkeypatch.setattr(spatial, "within", lambda a, *rest, **more: (sizes.append(a.count()), own(a, *rest, **more))[1])
    return sizes


def test_nearest_others(spark, monkeypatch):
    sizes = counted(monkeypatch)
    rows = [*ROWS, (90, 1.0, 0.0, 77.0), (91, 1.5, 0.0, 77.0), (92, 2.005, 0.0, 77.0)]
    got = {(r.a_id, r.b_id) for r in spatial.nearest_others(frame(spark, rows), "id", 2.0, 0.01).collect()}
    want = set()
    for a in rows:
        near = [(apart(a, b), b[0]) for b in rows if b[0] != a[0] and apart(a, b) <= 2.0]
        want |= {(a[0], b) for d, b in near if d <= min(near)[0] + 0.01}
    assert got == want and max(sizes) == len({r[1:] for r in rows})


def test_near_pairs(spark, monkeypatch):
    sizes = counted(monkeypatch)
    got = sorted((r.a_id, r.b_id, r.distance) for r in spatial.near_pairs(frame(spark), "id", 1.0).collect())
    want = sorted((a[0], b[0], apart(a, b)) for a, b in itertools.permutations(ROWS, 2) if apart(a, b) <= 1.0)
    assert got == want and sizes == [len(set(SPOTS))]


def test_snapped(spark, monkeypatch):
    sizes = counted(monkeypatch)
    corners = [(i, *SPOTS[i % 5]) for i in range(15)]
    got = {r.id: r.vertex for r in spatial.snapped(frame(spark), frame(spark, corners).withColumnRenamed("id", "vertex"), 1.5).collect()}
    near = {a[0]: min(((apart(a, b), b[0]) for b in corners if apart(a, b) <= 1.5), default=None) for a in ROWS}
    assert got == {k: v[1] for k, v in near.items() if v} and sizes == [len(set(SPOTS))]


def test_crossed_counts_its_steps(spark):
    ends = [(i, 3, 4, 3 + dx, 4 + dy) for i, (dx, dy) in enumerate(itertools.product(range(-9, 10), range(-9, 10)))]
    rays = spark.createDataFrame(ends, "ray long, x0 long, y0 long, x1 long, y1 long")
    got = {(r.ray, r.step, r.x, r.y) for r in spatial.crossed(rays).collect()}
    line = geometry.supercover(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    want = {(r.ray, r.step, r.c.x, r.c.y) for r in rays.select("ray", F.posexplode(line).alias("step", "c")).collect()}
    assert got == want
    parts = [spatial.crossed(rays, a, b) for a, b in ((0, 2), (3, 3), (4, 90))]
    assert {(r.ray, r.step, r.x, r.y) for p in parts for r in p.collect()} == want


def test_rays_stop(spark, monkeypatch):
    """Long rays behind a wall are not walked."""
    made, own = [], spatial.crossed
    monkeypatch.setattr(spatial, "crossed", lambda *a: (made.append(own(*a).count()), own(*a))[1])
    rays = spark.createDataFrame([(i, 0, 0, 5000, i) for i in range(20)], "ray long, x0 long, y0 long, x1 long, y1 long")
    cells = spark.createDataFrame([(x, y, x != 3) for x in range(6) for y in range(-3, 4)], "x long, y long, open boolean")
    assert {(r.x, r.y) for r in spatial.seen(rays, cells).collect()} == {(0, 0), (1, 0), (2, 0)}
    assert sum(made) < 20 * 20


def test_negative_zeros(spark):
    """Rounded to -0.0, as in SQL: ahead and a little to one side is half a turn that way."""
    table = spark.createDataFrame([(1, 0, [-0.00001, 0.5, 1.0]), (2, 0, [0.00001, 0.5, 1.0])], "vec_id long, label long, embedding array<float>")
    t = lambda name: table
    assert {r.id: r.bearing for r in world_queries.geo1_lengths(t).collect()} == {1: 3.141593, 2: -3.141593}
    assert {r.id: r.phi for r in sensor_queries.geo5_point_goal(t).collect()} == {1: 3.141593, 2: -3.141593}
    assert {r.id: str(r.x) for r in frame_queries.points(t).collect()} == {1: "-0.0", 2: "0.0"}


def test_a_crowded_place_is_many_tasks(spark, monkeypatch):
    """All rows in one place, and a few elsewhere: blocks of it are dealt, and all pairs come out once."""
    monkeypatch.setattr(spatial, "BLOCK", 20)
    rows = [(i, 1.0, 0.0, 1.0) for i in range(300)] + [(900 + i, 1.5, 0.0, 1.0) for i in range(3)]
    got = spatial.near_pairs(frame(spark, rows), "id", 1.0, digits=1)
    want = sorted((a[0], b[0], apart(a, b)) for a, b in itertools.permutations(rows, 2))
    assert sorted((r.a_id, r.b_id, r.distance) for r in got.collect()) == want
    assert got.groupBy(F.spark_partition_id()).count().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def last_step(df):
    """The plan behind its last join, and the rest."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    last = re.split(r"\w*Join", plan)[0]
    return last, plan[len(last) :]


def test_pairs_become_rows_last(spark):
    """Nothing is joined, sorted or moved once a pair of places has become rows."""
    last, before = last_step(spatial.near_pairs(frame(spark), "id", 1.0))
    assert "explode(_b" in last and "Exchange" not in last and "Sort" not in last and "a_id" not in before


def test_gaps_are_rounded_once(spark):
    """For two places, not for all of their rows; which is the last step."""
    t = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    last, before = last_step(sensor_queries.geo14_box_gap(t))
    assert "explode(_b" in last and "round(" not in last and "a_id" not in before


def test_rays_go_abreast(spark, tmp_path, monkeypatch):
    """The same cells in every order, in less room."""
    ends = [(i, 3, 4, 3 + dx, 4 + dy) for i, (dx, dy) in enumerate(itertools.product(range(-9, 10), range(-9, 10)))]
    rays = spark.createDataFrame(ends, "ray long, x0 long, y0 long, x1 long, y1 long")
    want = sorted(map(tuple, spatial.crossed(rays).collect()))
    for group, stride in ((512, 256), (20, 4), (7, 1)):
        monkeypatch.setattr(spatial, "ABREAST", group)
        monkeypatch.setattr(spatial, "STRIDE", stride)
        assert sorted(map(tuple, spatial.crossed(rays, packed=True).collect())) == want
    assert spatial.crossed(rays.limit(0), packed=True).count() == 0
    monkeypatch.undo()
    long = spark.range(400).select(F.col("id").alias("ray"), F.lit(9).alias("x0"), F.lit(11).alias("y0"), (2000 + F.col("id") * 7).alias("x1"), (F.col("id") % 30).alias("y1"))
    size = {}
    for packed in (False, True):
        spatial.crossed(long, packed=packed).coalesce(1).write.parquet(f"{tmp_path}/{packed}")
        size[packed] = sum(f.stat().st_size for f in (tmp_path / str(packed)).glob("*.parquet"))
    assert size[True] < size[False] / 2


def test_supercover_is_packed(spark, monkeypatch):
    asked, own = [], spatial.crossed
    monkeypatch.setattr(spatial, "crossed", lambda *a, **more: (asked.append(more), own(*a, **more))[1])
    sensor_queries.geo19_supercover(lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet"))
    assert asked == [{"packed": True}]
