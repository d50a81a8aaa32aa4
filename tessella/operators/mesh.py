"""Triangle meshes: the nearest point of a mesh, and drawing points of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

AXES = ("x", "y", "z")
CORNERS = [f"{v}{d}" for v in "abc" for d in AXES]
#: Part of a round's radius within which what it finds counts, so that rounding at the edges of cells can't hide anything.
SAFE = 0.999
#: Points of one cell that one task compares with the cell's triangles.
CROWD = 2000

Point = tuple[Column, Column, Column]


def _dot(a: Point, b: Point) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a: Point, b: Point) -> Point:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _columns(prefix: str) -> Point:
    return tuple(F.col(f"{prefix}{d}") for d in AXES)


def area() -> Column:
    """Of a triangle with the columns ax .. cz."""
    a, b, c = (_columns(v) for v in "abc")
    n = _cross(tuple(y - x for x, y in zip(a, b, strict=True)), tuple(y - x for x, y in zip(a, c, strict=True)))
    return F.sqrt(_dot(n, n)) / 2


def closest(df: DataFrame) -> DataFrame:
    """(x, y, z, ax .. cz) -> adds _d2, snap_x, snap_y, snap_z: the point of the triangle nearest to (x, y, z) and the squared distance.

    Inside by the weights of the corners where the foot of the perpendicular has none below 0, else the nearest point of the
    three edges.  A triangle without area is its edges, one without length its corner."""
    named = lambda name, p: {f"_{name}{d}": v for d, v in zip(AXES, p, strict=True)}
    own = lambda name: _columns(f"_{name}")
    less = lambda a, b: tuple(x - y for x, y in zip(a, b, strict=True))
    a, b, c, p = _columns("a"), _columns("b"), _columns("c"), _columns("")
    out = df.withColumns(named("u", less(b, a)) | named("w", less(c, a)) | named("q", less(p, a)))
    u, w, q = own("u"), own("w"), own("q")
    out = out.withColumns(named("n", _cross(u, w)))
    square = _dot(own("n"), own("n"))
    out = out.withColumns({"_v": F.try_divide(_dot(_cross(q, w), own("n")), square), "_t": F.try_divide(_dot(_cross(u, q), own("n")), square)})
    along = lambda off, way: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(_dot(off, way), _dot(way, way)), F.lit(0.0))))
    out = out.withColumns({"_s1": along(q, u), "_s2": along(q, w), "_s3": along(less(q, u), less(w, u))})

    def found(foot: Point) -> Column:
        gap = less(p, foot)
        return F.struct(_dot(gap, gap).alias("d2"), *[v.alias(d) for v, d in zip(foot, AXES, strict=True)])

    plus = lambda start, way, s: tuple(x + y * s for x, y in zip(start, way, strict=True))
    edge = F.least(found(plus(a, u, F.col("_s1"))), found(plus(a, w, F.col("_s2"))), found(plus(b, less(w, u), F.col("_s3"))))
    inside = (F.col("_v") >= 0) & (F.col("_t") >= 0) & (F.col("_v") + F.col("_t") <= 1)
    out = out.withColumn("_foot", F.when(inside, found(plus(plus(a, u, F.col("_v")), w, F.col("_t")))).otherwise(edge))
    keep = [c for c in df.columns if c != "_foot"]
    return out.select(*keep, F.col("_foot.d2").alias("_d2"), *[F.col(f"_foot.{d}").alias(f"snap_{d}") for d in AXES])


def _finite(names: list[str]) -> Column:
    each = [F.col(n).isNotNull() & ~F.isnan(F.col(n).cast("double")) & (F.abs(F.col(n)) < float("inf")) for n in names]
    return reduce(lambda x, y: x & y, each)


def nearest_triangle(points: DataFrame, triangles: DataFrame, cell: float | None = None) -> DataFrame:
    """points (id, x, y, z), triangles (triangle, ax .. cz) -> id, x, y, z, triangle, snap_x, snap_y, snap_z, distance: for every point the
    nearest triangle, the smallest name of equally near ones, and its nearest place, however far away.

    A round of radius r meets a point with the triangles whose boxes reach into the box of r around it, and what lies
    within r is final; the points left over go on with four times the radius.  Triangles lie on the grid of their own size or
    the round's if that is coarser, so each is in 8 cells at most, and so is a point's box on every grid that is in
    use; a pair is made in one cell only.  Nothing grows with the span of the mesh but the number of rounds, which is its logarithm.

    `cell` is the edge of the finest cells, the mean extent of the triangles if not given.  Points that are alike are
    searched for once, and triangles with the same corners are compared once, by the smallest name.  A cell's points are dealt to as many
    parts as they fill, and only cells with points keep triangles.  Points and triangles with a missing, undefined or infinite coordinate
    take no part; without triangles there are no rows."""
    mesh = triangles.select("triangle", *[F.col(c).cast("double").alias(c) for c in CORNERS]).filter(_finite(CORNERS))
    mesh = mesh.groupBy(*CORNERS).agg(F.when(F.count("triangle") == F.count(F.lit(1)), F.min("triangle")).alias("triangle"))  # no name comes first
    ends = {f"_{n}{d}": f(*[F.col(f"{v}{d}") for v in "abc"]) for d in AXES for n, f in (("lo", F.least), ("hi", F.greatest))}
    mesh = mesh.withColumns(ends).withColumn("_extent", F.greatest(*[F.col(f"_hi{d}") - F.col(f"_lo{d}") for d in AXES]))
    size = mesh.agg(F.avg("_extent").alias("mean"), F.count(F.lit(1)).alias("n")).first()
    edge = float(cell or size["mean"] or 1.0)
    mesh = mesh.withColumn("_class", F.greatest(F.lit(0), F.ceil(F.log2(F.nullif(F.col("_extent"), F.lit(0.0)) / edge))).cast("int"))
    mesh = cut(mesh.fillna({"_class": 0}).drop("_extent"))
    classes = sorted(r["_class"] for r in mesh.select("_class").distinct().collect())  # a power of two each
    own = points.select("id", *[F.col(d).cast("double").alias(d) for d in AXES]).filter(_finite(list(AXES)))
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    todo, done, level = own.select(*AXES).distinct(), [], 0
    while size["n"]:
        radius = edge * 2.0**level / 2
        span = lambda low, high: F.sequence(F.floor(low / F.col("_edge")), F.floor(high / F.col("_edge")))
        grids = F.array(*[F.lit(g) for g in sorted({max(level, c) for c in classes})])
        near = todo.withColumn("_grid", F.explode(grids)).withColumn("_edge", F.pow(F.lit(2.0), "_grid") * edge)
        laid = mesh.withColumn("_g", F.greatest("_class", F.lit(level))).withColumn("_edge", F.pow(F.lit(2.0), "_g") * edge)
        for d in AXES:  # the first cell of either side says where a pair is made
            near = near.withColumn(f"_p{d}", F.floor((F.col(d) - radius) / F.col("_edge"))).withColumn(f"_c{d}", F.explode(span(F.col(d) - radius, F.col(d) + radius)))
            laid = laid.withColumn(f"_f{d}", F.floor(F.col(f"_lo{d}") / F.col("_edge"))).withColumn(f"_m{d}", F.explode(span(F.col(f"_lo{d}"), F.col(f"_hi{d}"))))
        # one predicate of each kind: the optimiser's search for what equal columns imply grows fast with their number
        place = lambda x: F.struct(*[F.col(f"{x}{d}").alias(d) for d in AXES])
        here = F.struct(F.col("_grid").alias("g"), place("_c").alias("c")).alias("_here")
        there = F.struct(F.col("_g").alias("g"), place("_m").alias("c")).alias("_there")
        once = F.array(*[F.col(f"_here.c.{d}") for d in AXES]) == F.array(*[F.greatest(f"_p{d}", f"_f{d}") for d in AXES])
        reach = F.greatest(*[x for d in AXES for x in (F.col(f"_lo{d}") - F.col(d), F.col(d) - F.col(f"_hi{d}"))]) <= radius
        near = near.select(*AXES, *[f"_p{d}" for d in AXES], here)
        laid = laid.select("triangle", *CORNERS, *[f"_{n}{d}" for d in AXES for n in ("lo", "hi", "f")], there)
        parts = cut(near.groupBy(F.col("_here").alias("_cell")).agg(F.ceil(F.count(F.lit(1)) / CROWD).alias("_parts")))
        part = lambda cell, k: F.struct(F.col(f"{cell}.g").alias("g"), F.col(f"{cell}.c").alias("c"), k.alias("k"))
        near = near.join(parts, F.col("_here") == F.col("_cell")).withColumn("_here", part("_here", F.pmod(F.xxhash64(*AXES), "_parts"))).drop("_cell", "_parts")
        laid = laid.join(parts, F.col("_there") == F.col("_cell")).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
        laid = laid.withColumn("_there", part("_there", F.col("_k"))).drop("_cell", "_parts", "_k")
        # a number of partitions of its own: what a row meets is not told by its bytes, so small partitions must not be merged
        pairs = near.repartition(tasks, "_here").join(laid, F.col("_here") == F.col("_there")).filter(reach & once)
        pairs = closest(pairs.select(*AXES, "triangle", *CORNERS))
        # within the aggregate: a filter would be pushed below and written out once for each use of each part of the formula
        found = F.when(F.col("_d2") <= (SAFE * radius) ** 2, F.struct("_d2", "triangle", *[f"snap_{d}" for d in AXES]))
        best = pairs.groupBy(*AXES).agg(F.min(found).alias("_best")).filter("_best IS NOT NULL")
        done.append(cut(best))
        todo = cut(todo.join(done[-1], list(AXES), "left_anti"))
        if not todo.limit(1).count():
            break
        level += 2
    if not done:
        return own.limit(0).select("id", *AXES, F.lit(None).cast(triangles.schema["triangle"].dataType).alias("triangle"), *[F.lit(0.0).alias(f"snap_{d}") for d in AXES], F.lit(0.0).alias("distance"))
    found = reduce(lambda x, y: x.unionByName(y), done)
    return own.join(found, list(AXES)).select("id", *AXES, "_best.triangle", *[F.col(f"_best.snap_{d}").alias(f"snap_{d}") for d in AXES], F.sqrt("_best._d2").alias("distance"))
