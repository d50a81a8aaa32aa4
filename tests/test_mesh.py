"""Nearest triangles against all pairs."""

import math
import random

import pytest

from tessella.operators import mesh, spatial

POINT = "id long, x double, y double, z double"
TRIANGLE = "triangle long, " + ", ".join(f"{c} double" for c in mesh.CORNERS)


def nearest_on(p, a, b, c, steps=60):
    """By the plane where the foot lies inside, else by the edges; checked against a fine net of points of the triangle."""
    sub = lambda u, v: [x - y for x, y in zip(u, v, strict=True)]
    dot = lambda u, v: sum(x * y for x, y in zip(u, v, strict=True))
    at = lambda v, w: [x + v * (y - x) + w * (z - x) for x, y, z in zip(a, b, c, strict=True)]
    gap = lambda q: math.dist(p, q)
    out = []
    for s, e in ((a, b), (b, c), (c, a)):
        way = sub(e, s)
        t = max(0, min(1, dot(sub(p, s), way) / dot(way, way))) if dot(way, way) else 0
        out.append(gap([x + t * y for x, y in zip(s, way, strict=True)]))
    u, w, q = sub(b, a), sub(c, a), sub(p, a)
    det = dot(u, u) * dot(w, w) - dot(u, w) ** 2
    if det > 1e-12:
        v = (dot(w, w) * dot(q, u) - dot(u, w) * dot(q, w)) / det
        t = (dot(u, u) * dot(q, w) - dot(u, w) * dot(q, u)) / det
        if v >= 0 and t >= 0 and v + t <= 1:
            out.append(gap(at(v, t)))
    net = min(gap(at(i / steps, j / steps)) for i in range(steps + 1) for j in range(steps + 1 - i))
    assert min(out) <= net + 1e-9
    return min(out)


def shapes(n, seed):
    """Small and large, thin and without area, some far from all others."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        size = rng.choice([0.3, 1, 1, 8, 60])
        a = [rng.uniform(-50, 50) for _ in range(3)]
        b, c = ([x + rng.uniform(-size, size) for x in a] for _ in range(2))
        kind = i % 9
        out.append((i, *a, *(a if kind == 7 else b), *(a if kind == 7 else [x + 2 * (y - x) for x, y in zip(a, b, strict=True)] if kind == 8 else c)))
    return out


@pytest.mark.parametrize("cell", [None, 40.0])
def test_brute_force(spark, cell):
    rng = random.Random(4)
    table = shapes(40, 5)
    dots = [(i, *[rng.uniform(-60, 60) for _ in range(3)]) for i in range(30)] + [(100, 700.0, -400.0, 30.0), (101, *table[3][1:4]), (101, 0.0, 0.0, 0.0), (102, 0.0, 0.0, 0.0)]
    odd = [(200, None, 0.0, 0.0), (201, float("nan"), 0.0, 0.0), (202, 0.0, float("inf"), 0.0), (None, 1.0, 1.0, 1.0)]
    got = mesh.nearest_triangle(spark.createDataFrame(dots + odd, POINT).repartition(3), spark.createDataFrame([*table, (900, None, *[0.0] * 8)], TRIANGLE), cell).collect()
    assert len(got) == len(dots) + 1 and sum(r.id is None for r in got) == 1
    for r in got:
        each = {t[0]: nearest_on((r.x, r.y, r.z), t[1:4], t[4:7], t[7:10], 12) for t in table}
        least = min(each.values())
        assert r.distance == pytest.approx(least, abs=1e-7) and each[r.triangle] == pytest.approx(least, abs=1e-7)
        assert math.dist((r.x, r.y, r.z), (r.snap_x, r.snap_y, r.snap_z)) == pytest.approx(r.distance, abs=1e-9)


def test_ties_and_empty(spark):
    one = (0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)
    meshes = spark.createDataFrame([(9, *one), (3, *one), (5, *one)], TRIANGLE)
    dots = spark.createDataFrame([(1, 0.2, 2.0, 0.2), (2, -3.0, 0.0, 0.0)], POINT)
    got = {r.id: (r.triangle, r.distance, r.snap_x, r.snap_y, r.snap_z) for r in mesh.nearest_triangle(dots, meshes).collect()}
    assert got == {1: (3, 2.0, 0.2, 0.0, 0.2), 2: (3, 3.0, 0.0, 0.0, 0.0)}
    assert mesh.nearest_triangle(dots, meshes.limit(0)).count() == 0 == mesh.nearest_triangle(dots.limit(0), meshes).count()


def test_navigable(spark):
    """On the mesh, above it, beside it, below another floor."""
    floor = [(1, 0.0, 0.0, 0.0, 10.0, 0.0, 0.0, 0.0, 0.0, 10.0), (2, 0.0, 3.0, 0.0, 10.0, 3.0, 0.0, 0.0, 3.0, 10.0)]
    dots = spark.createDataFrame([(1, 2.0, 0.2, 2.0), (2, 2.0, 1.4, 2.0), (3, -0.5, 0.0, 2.0), (4, 2.0, 2.8, 3.0), (5, 9.0, 0.0, 9.0)], POINT)
    snaps = mesh.nearest_triangle(dots, spark.createDataFrame(floor, TRIANGLE))
    assert sorted(r.id for r in spatial.navigable(dots, snaps.drop("x", "y", "z")).collect()) == [1, 4]


def test_copies_are_compared_once(spark, monkeypatch):
    """Triangles with the same corners make no pairs of their own; points of one cell are dealt to several parts and lose nothing."""
    rng, counts, formula = random.Random(7), [], mesh.closest
    monkeypatch.setattr(mesh, "closest", lambda df: (counts.append(df.count()), formula(df))[1])
    monkeypatch.setattr(mesh, "CROWD", 3)
    table = shapes(30, 8)
    dots = spark.createDataFrame([(i, *[rng.uniform(-20, 20) for _ in range(3)]) for i in range(40)], POINT)
    answers = []
    for copies in (1, 20):
        rows = [(t[0] + 1000 * k, *t[1:]) for k in reversed(range(copies)) for t in table]
        answers.append((sorted(map(tuple, mesh.nearest_triangle(dots, spark.createDataFrame(rows, TRIANGLE)).collect())), sum(counts)))
        counts.clear()
    assert answers[0] == answers[1]
    for p in answers[0][0]:
        assert p[-1] == pytest.approx(min(nearest_on(p[1:4], t[1:4], t[4:7], t[7:10], 12) for t in table), abs=1e-7)
