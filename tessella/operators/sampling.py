"""Drawing at random with rejection: places on meshes, spaced places, point-goal episodes."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import uniform, uniform_pair
from .lineage import cut
from .mesh import AXES, CORNERS, area
from .ranges import running

#: Areas are summed as whole numbers of this part of a unit, so that sums don't depend on how rows are dealt.
PARTS = 1_000_000
#: Scenes whose two numbers go to all tasks.
FEW = 10_000


def prefix_areas(triangles: DataFrame, scene: str = "scene") -> DataFrame:
    """scene, triangle, ax .. cz -> adds _lo, _hi (where the triangle's area begins and ends among its scene's, in order of
    triangle), _width (of a cell) and _cell, a row for each cell that a triangle touches; those without area are left out.

    A scene has as many cells as triangles, so there are at most two rows for each on average, and no cell has more than it touches."""
    tasks = int(triangles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = triangles.withColumn("_area", F.round(area() * PARTS).cast("long")).repartition(tasks, scene, "triangle").filter("_area > 0")
    own = running(own, [F.col(scene), F.col("triangle")], F.col("_area"), "_lo")
    per = own.groupBy(F.col(scene).alias("_s")).agg(F.min("_lo").alias("_first"), F.sum("_area").alias("_total"), F.count(F.lit(1)).alias("_n"))
    own = own.join(per, F.col(scene).eqNullSafe(F.col("_s"))).drop("_s")
    own = own.withColumns({"_lo": F.col("_lo") - F.col("_first"), "_width": F.ceil(F.col("_total") / F.col("_n")).cast("long")})
    own = own.withColumn("_hi", F.col("_lo") + F.col("_area"))
    at = lambda x: F.floor(x / F.col("_width")).cast("long")
    return own.withColumn("_cell", F.explode(F.sequence(at(F.col("_lo")), at(F.col("_hi") - 1)))).drop("_first", "_n", "_area")


def on_mesh(draws: DataFrame, areas: DataFrame, seed: str, keys: Sequence[str], scene: str = "scene", keep: Sequence[str] = ()) -> DataFrame:
    """draws (scene and keys) -> adds triangle, x, y, z (and the triangle's `keep`): a place of the scene's mesh, all places equally likely.

    One number finds the triangle among the summed areas (prefix_areas), two more the place in it.  Scenes without area have no rows.
    Draws aren't dealt by scene as long as scenes are few: the tasks would be as few."""
    total = areas.groupBy(F.col(scene).alias("_s")).agg(F.first("_total").alias("_t"), F.first("_width").alias("_w"))
    total = F.broadcast(total) if total.limit(FEW + 1).count() <= FEW else total
    names = [F.col(k) for k in (scene, *keys)]
    v, w = uniform_pair(seed, "place", *names)
    own = draws.join(total, F.col(scene).eqNullSafe(F.col("_s"))).drop("_s")
    own = own.withColumn("_at", F.floor(uniform(seed, "triangle", *names) * F.col("_t")).cast("long")).withColumns({"_c": F.floor(F.col("_at") / F.col("_w")).cast("long"), "_r": F.sqrt(v), "_q": w})
    laid = areas.select(F.col(scene).alias("_s"), "triangle", *CORNERS, *keep, "_lo", "_hi", "_cell")
    hit = own.join(laid, F.col(scene).eqNullSafe(F.col("_s")) & (F.col("_c") == F.col("_cell")) & (F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi")))
    place = {d: (1 - F.col("_r")) * F.col(f"a{d}") + F.col("_r") * (1 - F.col("_q")) * F.col(f"b{d}") + F.col("_r") * F.col("_q") * F.col(f"c{d}") for d in AXES}
    return hit.select(*draws.columns, "triangle", *keep, *[v.alias(d) for d, v in place.items()])


def first_accepted(keys: DataFrame, propose: Callable[[DataFrame], DataFrame], tries: int, batch: int = 2) -> DataFrame:
    """Rejection: of each row of keys (all different) the first attempt, from 0 to tries - 1, whose proposal is `ok`.

    `propose` takes the rows with a column attempt and returns them with more columns and `ok`, or without those that it has no
    proposal for; what it draws depends on a row's key and attempt alone.  Rounds of doubling numbers of attempts go on only for
    keys that have none accepted.  A key without one keeps its row, with null in attempt and all that propose adds."""
    todo, done, first = keys, [], 0
    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while first < tries:
        past = min(tries, first + batch)
        # a number of partitions of its own: what a key takes is not told by its bytes, so small partitions must not be merged
        good = propose(todo.repartition(tasks, *keys.columns).withColumn("attempt", F.explode(F.sequence(F.lit(first), F.lit(past - 1))))).filter("ok").drop("ok")
        rest = [c for c in good.columns if c not in keys.columns]
        best = cut(good.groupBy(*keys.columns).agg(F.min_by(F.struct(*rest), "attempt").alias("_best")).select(*keys.columns, "_best.*"))
        done.append(best)
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys.columns]
        todo = cut(todo.join(best.select(*[F.col(c).alias(f"_{c}") for c in keys.columns]), reduce(lambda x, y: x & y, same), "left_anti"))
        first, batch = past, 2 * batch
        if not todo.limit(1).count():
            break
    return reduce(lambda x, y: x.unionByName(y), done).unionByName(todo, allowMissingColumns=True)


def near_places(points: DataFrame, triangles: DataFrame, radius: float, tries: int = 10, seed: str = "near") -> DataFrame:
    """points (id, scene, x, y, z), triangles (scene, triangle, ax .. cz) -> id, scene, attempt, triangle, x, y, z: a random place of the
    scene's mesh within `radius` of the point on the ground; null where `tries` draws found none."""
    areas = cut(prefix_areas(triangles))
    keys = points.select("id", "scene", *[F.col(d).alias(f"from_{d}") for d in AXES])

    def propose(rows: DataFrame) -> DataFrame:
        out = on_mesh(rows, areas, seed, ["id", "attempt"])
        dx, dz = F.col("x") - F.col("from_x"), F.col("z") - F.col("from_z")
        return out.withColumn("ok", dx * dx + dz * dz < radius * radius)

    return first_accepted(keys, propose, tries).drop("from_x", "from_y", "from_z")


def spaced(points: DataFrame, distance: float, key: str = "id", dims: Sequence[str] = AXES) -> DataFrame:
    """The points that stay if, in order of `key` (all different), each is kept unless it is closer than `distance` to one kept before.

    Points lie in cells so small that two of one cell are too close.  Each round only the first undecided point of a cell
    speaks for it: one that comes before those of all cells in reach is kept, and what is too close to it goes.  A point meets a
    fixed number of cells, however many points share its own.  Rounds end when none is undecided."""
    edge = 0.999 * distance / math.sqrt(len(dims))
    reach = math.ceil(distance / edge)
    cells = [f"_c{d}" for d in dims]
    own = cut(points.select(key, *dims).withColumns({f"_c{d}": F.floor(F.col(d) / edge) for d in dims}))
    around = F.sequence(F.lit(-reach), F.lit(reach))

    def neighbours(df: DataFrame) -> DataFrame:
        for c in cells:
            df = df.withColumn("_o", F.explode(around)).withColumn(c, F.col(c) + F.col("_o")).drop("_o")
        return df

    todo, kept = own, []
    while True:
        first = todo.groupBy(*cells).agg(F.min(key).alias("_first"))
        least = neighbours(first).groupBy(*cells).agg(F.min("_first").alias("_least"))  # of all cells in reach of this one
        leaders = first.join(least, cells).filter("_first = _least").select(*cells, F.col("_first").alias(key))
        chosen = cut(leaders.join(todo, [*cells, key]).select(key, *dims, *cells))
        kept.append(chosen)
        names = [F.col(d).alias(f"_k{d}") for d in dims]
        gap = sum(((F.col(d) - F.col(f"_k{d}")) * (F.col(d) - F.col(f"_k{d}")) for d in dims), F.lit(0.0))
        close = todo.join(neighbours(chosen.select(*names, *cells)), cells).filter(gap < distance * distance).select(key)
        gone = close.unionByName(chosen.select(key)).distinct()
        todo = cut(todo.join(gone, key, "left_anti"))
        if not todo.limit(1).count():
            break
    ids = reduce(lambda x, y: x.unionByName(y), [k.select(key) for k in kept])
    return points.join(ids, key, "left_semi")


def ratio_rate(ratio: Column) -> Column:
    """How likely an almost straight episode stays."""
    return 20 * (ratio - 0.98) * (ratio - 0.98)


def point_goals(scenes: DataFrame, triangles: DataFrame, geodesic: Callable[[DataFrame], Column], near: float = 1.0, far: float = 30.0, ratio: float = 1.1, retries: int = 10, island: float = 1.5, rounds: int = 4, seed: str = "pointnav") -> DataFrame:
    """Draws point-goal episodes: scenes (scene, n), triangles (scene, triangle, ax .. cz, island_radius) -> scene, episode_id (0 to n - 1), target, attempt,
    start_x .. z, goal_x .. z, angle, rotation_y, rotation_w, geodesic.

    Targets are numbered; one on an island smaller than `island` is passed over, and so is one for which none of `retries` starts will do.  A start
    will do on an island that is large enough, at most 0.5 higher or lower than the target, with a `geodesic` distance (a Column over the rows with
    start and goal; null where there is no way) from near to far; if that is less than `ratio` times the straight one, it stays only at the rate of
    ratio_rate().  A scene's episodes are the first n of its targets; rounds of n targets go on, up to `rounds`, for scenes that lack some."""
    areas = cut(prefix_areas(triangles))
    scenes = cut(scenes.select("scene", "n"))
    todo, done = scenes.select("scene", "n", F.lit(0).cast("long").alias("_have")), []

    def propose(rows: DataFrame) -> DataFrame:
        out = on_mesh(rows, areas, f"{seed}-start", ["target", "attempt"], keep=["island_radius"]).withColumnsRenamed({d: f"start_{d}" for d in AXES}).drop("triangle")
        out = out.withColumn("geodesic", geodesic(out))
        gap = sum(((F.col(f"start_{d}") - F.col(f"goal_{d}")) * (F.col(f"start_{d}") - F.col(f"goal_{d}")) for d in AXES), F.lit(0.0))
        share = F.try_divide(F.col("geodesic"), F.sqrt(gap))
        luck = uniform(f"{seed}-ratio", F.col("scene"), F.col("target"), F.col("attempt"))
        fits = (F.abs(F.col("start_y") - F.col("goal_y")) <= 0.5) & F.col("geodesic").between(near, far) & ((share >= ratio) | (luck <= ratio_rate(share))) & (F.col("island_radius") >= island)
        return out.withColumn("ok", F.coalesce(fits, F.lit(False))).drop("island_radius")

    for turn in range(rounds):
        targets = todo.filter("n > 0").select("scene", F.explode(F.sequence(turn * F.col("n"), (turn + 1) * F.col("n") - 1)).alias("target"))
        goals = on_mesh(targets, areas, f"{seed}-goal", ["target"], keep=["island_radius"]).filter(F.col("island_radius") >= island)
        goals = cut(goals.select("scene", "target", *[F.col(d).alias(f"goal_{d}") for d in AXES]))
        done.append(first_accepted(goals, propose, retries).filter(F.col("attempt").isNotNull()))
        have = reduce(lambda x, y: x.unionByName(y), done).groupBy(F.col("scene").alias("_s")).agg(F.count(F.lit(1)).alias("_h"))
        todo = cut(scenes.join(have, F.col("scene").eqNullSafe(F.col("_s")), "left").select("scene", "n", F.coalesce("_h", F.lit(0)).alias("_have")).filter("_have < n"))
        if not todo.limit(1).count():
            break
    out = reduce(lambda x, y: x.unionByName(y), done).join(scenes.select(F.col("scene").alias("_s"), "n"), F.col("scene").eqNullSafe(F.col("_s")))
    out = out.withColumn("episode_id", (F.row_number().over(Window.partitionBy("scene").orderBy("target")) - 1).cast("long")).filter("episode_id < n")
    angle = uniform(f"{seed}-turn", F.col("scene"), F.col("target")) * (2 * math.pi)
    return out.drop("_s", "n").withColumn("angle", angle).withColumns({"rotation_y": F.sin(F.col("angle") / 2), "rotation_w": F.cos(F.col("angle") / 2)})
