import math
import random

import numpy as np
import pytest

from tessella.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(table, parts=16, entries=64, rounds=2):
    """By definition: every distance of every part to every entry."""
    kept = [(i, [math.floor(256 * np.float64(np.float32(v))) for v in x], label) for i, x, label in table if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([r[1] for r in kept], np.int64)
    x = x.reshape(len(kept), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        far = ((x[:, :, None, :] - books[None]) ** 2).sum(3)
        code, error = far.argmin(2), far.min(2).sum(1)
        if turn < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    own = x[code[:, p] == e, p]
                    if len(own):
                        books[p, e] = np.floor_divide(own.sum(0), len(own))
    return sorted((r[0] is None, r[0] or 0, bytes(c.astype(np.uint8)), int(w)) for r, c, w in zip(kept, code, error, strict=True)), books


def got(df):
    return sorted((r.vec_id is None, r.vec_id or 0, bytes(r.code), r.error) for r in df.collect())


def vectors(n, width, seed=1, grid=0):
    rng = random.Random(seed)
    one = lambda: rng.gauss(0, 0.3) if not grid else rng.randrange(grid) / 256
    return [(i, [one() for _ in range(width)], rng.choice([0, 1, None])) for i in range(n)]


@pytest.mark.parametrize(("n", "width", "grid"), [(700, 64, 0), (500, 16, 0), (600, 32, 3), (20, 64, 0)])
def test_brute_force(spark, n, width, grid):
    """Gaussian vectors; one position a part; a grid full of ties and equal entries; fewer vectors than entries."""
    table = vectors(n, width, n, grid)
    out, books = codes.train(spark.createDataFrame(table, SCHEMA).repartition(5))
    want, want_books = brute(table)
    assert got(out) == want and (books == want_books).all()


def test_awkward_rows(spark):
    table = vectors(300, 32, 9)
    table += [table[5], (5, table[6][1], None), (None, table[7][1], 1), (400, None, 1), (401, [None] * 32, 1), (402, [float("nan")] * 32, 0), (403, [float("inf")] + [0.0] * 31, 0), (404, [float("-inf")] * 32, None)]
    df = spark.createDataFrame(table, SCHEMA)
    short = spark.createDataFrame([(500, [1.0, 2.0], 1), (501, [], 1)], SCHEMA)
    for name in ("error", "code", "_x", "_code", "cell"):
        df, short = df.selectExpr("*", f"'x' AS {name}"), short.selectExpr("*", f"'x' AS {name}")
    out, _ = codes.train(df.union(short))
    assert got(out) == brute(table)[0]
    sums = {}
    for r in codes.by_label(out).collect():
        sums.setdefault(r.label, []).append((r.error, r.label_error))
    assert None in sums and all(sum(e for e, _ in v) == t for v in sums.values() for _, t in v)


def test_copies(spark):
    """A vector that most rows hold: its copies share a code, and means stay those of all rows."""
    table = vectors(100, 16, 3)
    table += [(1000 + i, table[1][1], 7) for i in range(900)]
    out, books = codes.train(spark.createDataFrame(table, SCHEMA).repartition(4))
    assert got(out) == brute(table)[0]


def test_empty_and_padding(spark):
    none, _ = codes.train(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0
    flat, _ = codes.train(spark.createDataFrame([(1, [], 1)], SCHEMA))
    assert got(flat) == [(False, 1, bytes(16), 0)]
    table = vectors(90, 18, 4)
    out, books = codes.train(spark.createDataFrame(table, SCHEMA))
    assert books.shape == (16, 64, 2) and got(out) == brute([(i, [*x, *[0.0] * 14], y) for i, x, y in table])[0]
    with pytest.raises(Exception, match="or more"):
        codes.train(spark.createDataFrame([(1, [1e30] * 16, 1)], SCHEMA))


def test_encode(spark):
    df = spark.createDataFrame(vectors(200, 32, 8), SCHEMA)
    out, books = codes.train(df)
    assert got(codes.encode(df, books)) == got(out)


def test_search_stops_early():
    """The list is scanned no farther than it must be, and the answer is that of a full scan, ties included."""
    rng = np.random.default_rng(5)
    books = rng.integers(-40, 40, (3, 50, 2))
    x = rng.integers(-40, 40, (400, 3, 2))
    far = ((x[:, :, None, :] - books[None]) ** 2).sum(3)
    near, wide = codes.balls(books)
    for start in (np.zeros((400, 3), np.int64), far.argmin(2), rng.integers(0, 50, (400, 3))):
        index, least = codes.nearest(x, start, books, near, wide)
        assert (index == far.argmin(2)).all() and (least == far.min(2)).all()
    start = far.argmin(2)
    scanned = (wide[np.arange(3)[None], start] <= 4 * far.min(2)[:, :, None]).sum(2)
    assert scanned.mean() < 20
