"""Patches by tiles against a flood fill."""

import random

import pytest

from tessella.operators import patches


def flood(cells):
    colour, out = dict(cells), {}
    for start in sorted(colour):
        if start in out:
            continue
        todo = [start]
        out[start] = start
        while todo:
            r, c = todo.pop()
            for near in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if near not in out and colour.get(near) == colour[start]:
                    out[near] = start
                    todo.append(near)
    return out


def snake(n):
    """One patch that winds through every tile, with its other colour between."""
    return [((r, c), "a" if r % 2 == 0 or c == (n - 1 if r % 4 == 1 else 0) else "b") for r in range(n) for c in range(n)]


@pytest.mark.parametrize("tile", [1, 4, 256])
@pytest.mark.parametrize("kind", ["random", "snake", "one", "holes"])
def test_coloured(spark, tile, kind):
    rng = random.Random(3)
    if kind == "snake":
        cells = snake(13)
    else:
        cells = [((r, c), "x" if kind == "one" else rng.choice("abb")) for r in range(-6, 9) for c in range(-5, 8) if kind != "holes" or rng.random() < 0.7]
    df = spark.createDataFrame([(r, c, v) for (r, c), v in cells] + [cells[0][0] + cells[0][1:], (50, 50, None), (None, 1, "a")], "row long, col long, colour string")
    got = patches.coloured(df.repartition(3), tile)
    assert {(r.row, r.col): (r.patch_row, r.patch_col) for r in got.collect()} == flood(cells)
    stats = {(r.patch_row, r.patch_col): (r.n, r.row0, r.row1, r.col0, r.col1) for r in patches.measured(got).collect()}
    want = {}
    for cell, first in flood(cells).items():
        want.setdefault(first, []).append(cell)
    assert stats == {k: (len(v), min(r for r, _ in v), max(r for r, _ in v), min(c for _, c in v), max(c for _, c in v)) for k, v in want.items()}


def test_faults(spark):
    df = spark.createDataFrame([(0, 0, "a"), (0, 0, "b")], "row long, col long, colour string")
    with pytest.raises(Exception, match="two colours"):
        patches.coloured(df).collect()
    assert patches.coloured(df.limit(0)).count() == 0


def test_on_mesh(spark):
    v = spark.createDataFrame([(i, i // 4, float(i), 0.0, -float(i)) for i in range(10)], "vertex long, colour int, x double, y double, z double")
    e = spark.createDataFrame([(0, 1), (1, 2), (3, 4), (5, 4), (6, 9), (7, 6)], "src long, dst long")
    got = {r.component: (r.colour, r.n, r.min_x, r.max_x, r.min_z) for r in patches.on_mesh(v, e).collect()}
    assert got == {0: (0, 3, 0.0, 2.0, -2.0), 3: (0, 1, 3.0, 3.0, -3.0), 4: (1, 2, 4.0, 5.0, -5.0), 6: (1, 2, 6.0, 7.0, -7.0), 8: (2, 1, 8.0, 8.0, -8.0), 9: (2, 1, 9.0, 9.0, -9.0)}
