"""Straight paths over polygons that share edges: a corridor of polygons, then the taut line through its gates."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

Spot = Sequence[float]


def turn(a: Spot, b: Spot, c: Spot) -> float:
    """Above 0 if c lies to the left of the way from a to b, seen along y with x to the right and z ahead."""
    return (b[0] - a[0]) * (c[2] - a[2]) - (b[2] - a[2]) * (c[0] - a[0])


def taut(start: Spot, goal: Spot, gates: Sequence[tuple[Spot, Spot]]) -> list[Spot]:
    """The shortest line from start to goal through gates (left end, right end), as its corners.

    A funnel from the last corner is narrowed gate by gate; where one side would cross the other, that other side's end is a corner and the
    funnel begins anew behind its gate."""
    ends = [(start, start), *gates, (goal, goal)]
    out, apex, left, right, at_left, at_right, i = [start], start, start, start, 0, 0, 1
    while i < len(ends):
        new_left, new_right = ends[i]
        corner = None
        if turn(apex, right, new_right) >= 0:
            if apex == right or turn(apex, left, new_right) <= 0:
                right, at_right = new_right, i
            else:
                corner, i = left, at_left
        if corner is None and turn(apex, left, new_left) <= 0:
            if apex == left or turn(apex, right, new_left) >= 0:
                left, at_left = new_left, i
            else:
                corner, i = right, at_right
        if corner is not None:
            if corner != out[-1]:
                out.append(corner)
            apex = left = right = corner
            at_left = at_right = i
        i += 1
    if goal != out[-1] or len(out) == 1:
        out.append(goal)
    return out


def corridors(edges: DataFrame, wanted: DataFrame, most: int = 256) -> DataFrame:
    """edges (src, dst, weight), wanted (source, goal) -> source, goal, cost, corridor: the polygons of the cheapest way, of equally cheap ones the
    first by its polygons; no row where there is none within `most` polygons.

    All sources are searched at once, each only as far as what improved in the last round leads, and each place keeps one way.  Edges are
    made once, not in every round, and no round sends rows by way of the driver."""
    edges = cut(edges.select("src", "dst", "weight"))
    best = cut(wanted.select("source").distinct().select("source", F.col("source").alias("vertex"), F.lit(0.0).alias("cost"), F.array("source").alias("way")))
    front, rank = best, lambda c, w: F.struct(F.col(c).alias("cost"), F.col(w).alias("way"))
    for _ in range(most - 1):
        step = front.hint("merge").join(edges.hint("merge"), F.col("vertex") == F.col("src"))
        step = step.select("source", F.col("dst").alias("vertex"), (F.col("cost") + F.col("weight")).alias("cost"), F.concat("way", F.array("dst")).alias("way"))
        new = step.groupBy("source", "vertex").agg(F.min(rank("cost", "way")).alias("_new"))
        both = cut(best.join(new, ["source", "vertex"], "full_outer").withColumn("_better", F.col("_new").isNotNull() & (F.col("cost").isNull() | (F.col("_new") < rank("cost", "way")))))
        pick = lambda f: F.when(F.col("_better"), F.col(f"_new.{f}")).otherwise(F.col(f)).alias(f)
        best = both.select("source", "vertex", pick("cost"), pick("way"), "_better")
        front = best.filter("_better").drop("_better")
        if not front.limit(1).count():
            break
        best = best.drop("_better")
    found = best.select(F.col("source").alias("_s"), F.col("vertex").alias("_v"), "cost", F.col("way").alias("corridor"))
    return wanted.select("source", "goal").distinct().join(found.hint("merge"), (F.col("source") == F.col("_s")) & (F.col("goal") == F.col("_v"))).drop("_s", "_v")


def gates(portals: DataFrame, centres: DataFrame) -> DataFrame:
    """portals (src, dst, p, q: ends of the shared edge), centres (poly, centre) -> src, dst, left, right as seen from inside src."""
    out = portals.join(centres.select(F.col("poly").alias("_p"), "centre").hint("merge"), F.col("src") == F.col("_p"))
    x = lambda n, i: F.get(F.col(n), F.lit(i))
    side = (x("p", 0) - x("centre", 0)) * (x("q", 2) - x("centre", 2)) - (x("p", 2) - x("centre", 2)) * (x("q", 0) - x("centre", 0))
    return out.select("src", "dst", F.when(side > 0, F.col("q")).otherwise(F.col("p")).alias("left"), F.when(side > 0, F.col("p")).otherwise(F.col("q")).alias("right"))


def _pulled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = []
        for r in batch.select(["start", "end", "gates"]).to_pylist():
            lines.append(taut(r["start"], r["end"], [(g["left"], g["right"]) for g in r["gates"]]))
        length = [sum(math.dist(a, b) for a, b in zip(x, x[1:], strict=False)) for x in lines]
        yield pa.record_batch([batch.column("id"), batch.column("goal_id"), pa.array(length, pa.float64()), pa.array(lines, pa.list_(pa.list_(pa.float64())))], names=["id", "goal_id", "distance", "points"])


def straight_paths(trips: DataFrame, edges: DataFrame, openings: DataFrame, most: int = 256) -> DataFrame:
    """trips (id, goal_id, source, goal: polygons; start, end: places in them), edges (src, dst, weight), openings (src, dst, left, right) -> id, goal_id,
    distance, points: the taut line through the cheapest corridor; infinity and no points where there is none."""
    ways = cut(corridors(edges, trips.select("source", "goal"), most)).select(F.col("source").alias("_s"), F.col("goal").alias("_g"), "corridor")
    own = trips.join(ways.hint("merge"), (F.col("source") == F.col("_s")) & (F.col("goal") == F.col("_g")), "left").drop("_s", "_g")
    steps = ways.select("_s", "_g", "corridor", F.posexplode(F.sequence(F.lit(0), F.size("corridor") - 1)).alias("at", "_i")).withColumns({"src": F.get("corridor", F.col("at")), "dst": F.get("corridor", F.col("at") + 1)}).filter("dst IS NOT NULL")
    told = steps.join(openings.hint("merge"), ["src", "dst"]).groupBy("_s", "_g").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "left", "right"))), lambda x: F.struct(x["left"].alias("left"), x["right"].alias("right"))).alias("gates"))
    none = F.array().cast("array<struct<left:array<double>,right:array<double>>>")
    rows = own.filter("corridor IS NOT NULL").join(told.hint("merge"), (F.col("source") == F.col("_s")) & (F.col("goal") == F.col("_g")), "left")
    rows = rows.select("id", "goal_id", "start", "end", F.coalesce("gates", none).alias("gates"))
    kind = {f.name: f.dataType.simpleString() for f in trips.schema}
    met = rows.mapInArrow(_pulled, f"id {kind['id']}, goal_id {kind['goal_id']}, distance double, points array<array<double>>")
    lost = own.filter("corridor IS NULL").select("id", "goal_id", F.lit(float("inf")).alias("distance"), F.array().cast("array<array<double>>").alias("points"))
    return met.unionByName(lost)


def nearest(paths: DataFrame) -> DataFrame:
    """Of each id the goal with the shortest path, the smallest goal_id of equal ones; goal_id -1 and no points if none is reached."""
    best = paths.groupBy("id").agg(F.min(F.struct("distance", "goal_id", "points")).alias("b"))
    there = F.col("b.distance") < float("inf")
    return best.select("id", F.when(there, F.col("b.goal_id")).otherwise(-1).alias("goal_id"), "b.distance", "b.points")
