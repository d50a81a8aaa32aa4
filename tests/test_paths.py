"""Taut lines against the best of many lines through the same gates, and unreachable goals."""

import math
import random

import pytest

from tessella.operators import paths


def by_points(start, goal, gates, n=400):
    """The shortest way over n places of each gate: a little longer than the taut line."""
    here = [(0.0, start)]
    for left, right in gates:
        spots = [[a + (b - a) * i / n for a, b in zip(left, right, strict=True)] for i in range(n + 1)]
        here = [(min(d + math.dist(p, s) for d, p in here), s) for s in spots]
    return min(d + math.dist(p, goal) for d, p in here)


def walk(rng, steps):
    """Squares of a grid in a row, with the gates between them from left to right."""
    r, q, seen, gates = 0, 0, {(0, 0)}, []
    for _ in range(steps):
        dr, dq = rng.choice([(0, 1), (1, 0), (0, 1), (-1, 0), (0, -1)])
        if (r + dr, q + dq) in seen:
            continue
        x, z = max(q, q + dq), max(r, r + dr)
        p, o = (x, 0.0, z), ((x, 0.0, z + 1) if dq else (x + 1, 0.0, z))
        centre = (q + 0.5, 0.0, r + 0.5)
        p, o = tuple(map(float, p)), tuple(map(float, o))
        gates.append((o, p) if paths.turn(centre, p, o) > 0 else (p, o))
        r, q = r + dr, q + dq
        seen.add((r, q))
    return (0.3, 0.0, 0.6), (q + 0.7, 0.0, r + 0.2), gates


@pytest.mark.parametrize("seed", range(12))
def test_taut(seed):
    start, goal, gates = walk(random.Random(seed), 9)
    line = paths.taut(start, goal, gates)
    length = sum(math.dist(a, b) for a, b in zip(line, line[1:], strict=False))
    near = by_points(start, goal, gates, 60)
    assert length <= near + 1e-9 and near - length < 0.02
    assert line[0] == start and line[-1] == goal and set(line[1:-1]) <= {p for g in gates for p in g}
    assert paths.taut(start, start, []) == [start, start]


def test_straight_paths(spark):
    """A wall with a gap, a goal behind bars, the nearest of several goals; equally cheap corridors give the same one at every run."""
    width, wall = 6, {(2, c) for c in range(6) if c != 4} | {(5, 0), (4, 1), (3, 0)}
    cells = [(r, c) for r in range(6) for c in range(width) if (r, c) not in wall]
    name = {x: i for i, x in enumerate(cells)}
    spot = lambda x, z: [float(x), 0.0, float(z)]
    portals, centres = [], [(i, spot(c + 0.5, r + 0.5)) for (r, c), i in name.items()]
    for (r, c), i in name.items():
        for dr, dc in ((0, 1), (0, -1), (1, 0), (-1, 0)):
            if (j := name.get((r + dr, c + dc))) is not None:
                x, z = max(c, c + dc), max(r, r + dr)
                portals.append((i, j, spot(x, z), spot(x, z + 1) if dc else spot(x + 1, z)))
    own = spark.createDataFrame(portals, "src long, dst long, p array<double>, q array<double>")
    edges = own.selectExpr("src", "dst", "1.0D AS weight")
    openings = paths.gates(own, spark.createDataFrame(centres, "poly long, centre array<double>"))
    trip = lambda i, a, b: (i, name[b], name[a], name[b], spot(a[1] + 0.5, a[0] + 0.5), spot(b[1] + 0.5, b[0] + 0.5))
    trips = [trip(1, (0, 0), (0, 5)), trip(1, (0, 0), (3, 1)), trip(2, (0, 0), (4, 0)), trip(3, (1, 1), (1, 1))]
    df = spark.createDataFrame(trips, "id long, goal_id long, source long, goal long, start array<double>, end array<double>")
    got = {(r.id, r.goal_id): (r.distance, r.points) for r in paths.straight_paths(df, edges, openings).collect()}
    assert got[1, name[0, 5]][0] == pytest.approx(5.0) and len(got[1, name[0, 5]][1]) == 2
    # of the corridors with 11 squares the first by number goes along the first row, so its inner corners are (4, 1) to (4, 3)
    bent = math.dist((0.5, 0.5), (4, 1)) + 2.0 + math.dist((4, 3), (1.5, 3.5))
    assert got[1, name[3, 1]][0] == pytest.approx(bent) and {p[0] for p in got[1, name[3, 1]][1][1:-1]} == {4.0}
    assert got[2, name[4, 0]] == (math.inf, []) and got[3, name[1, 1]][0] == 0.0
    best = {r.id: (r.goal_id, r.distance) for r in paths.nearest(paths.straight_paths(df, edges, openings)).collect()}
    assert best[1] == (name[0, 5], 5.0) and best[2] == (-1, math.inf)
    assert paths.straight_paths(df, edges, openings, most=3).filter("id = 1 AND distance < 1000").count() == 0


def test_nothing_by_way_of_the_driver(spark, monkeypatch):
    """No round broadcasts the edges or the places reached, however few they are here."""
    plans, real = [], paths.cut
    monkeypatch.setattr(paths, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1])
    edges = spark.createDataFrame([(i, j, 1.0) for i in range(6) for j in (i - 1, i + 1)], "src long, dst long, weight double")
    wanted = spark.createDataFrame([(0, 5), (3, 1)], "source long, goal long")
    got = paths.corridors(edges, wanted)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert {(r.source, r.goal): r.corridor for r in got.collect()} == {(0, 5): [0, 1, 2, 3, 4, 5], (3, 1): [3, 2, 1]}
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)
