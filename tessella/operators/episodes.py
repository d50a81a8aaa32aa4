"""Datasets of episodes: filters, orders, splits, samples and merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import running


def content_scenes(df: DataFrame, wanted: Sequence[str], scene: str = "scene_id") -> DataFrame:
    """'*' in the list keeps all scenes."""
    return df if "*" in wanted else df.filter(F.col(scene).isin(*wanted))


def cull(text: Column, include: Sequence[str], exclude: Sequence[str]) -> Column:
    """Holds any of the included and none of the excluded strings."""
    any_of = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w)) if words else F.lit(False)
    return any_of(include) & ~any_of(exclude)


def search(handle: Column, needle: str, contains: bool = True) -> Column:
    """Case-insensitive; an empty needle finds all."""
    if not needle:
        return F.lit(True)
    hit = F.lower(handle).contains(needle.lower())
    return hit if contains else ~hit


def excluded(handle: Column, names: Sequence[str]) -> Column:
    """Holds any of these names."""
    return F.exists(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(handle, n)) if names else F.lit(False)


def receptacle_fits(sets: Sequence[dict[str, Sequence[str]]], name: str = "name", parent: str = "parent", down: str = "down", gravity: tuple[float, float, float] = (0.0, -1.0, 0.0), tilt: float = 0.9) -> Column:
    """Whether a receptacle (unique name, handle of its parent or null for the stage, unit vector down) fits one of the sets in order.

    A set has lists of substrings: excluded_objects, excluded_receptacles, included_objects, included_receptacles.  An exclusion
    that holds ends the search without a match, and so does the first set for a receptacle of the stage, which needs a name
    constraint only; others need one of the objects and one of the receptacles.  One tilted too far doesn't fit."""
    n, p = F.col(name), F.col(parent)
    any_of = lambda text, words: F.coalesce(excluded(text, words), F.lit(False))
    match = F.lit(False)
    for s in reversed(list(sets)):
        barred = any_of(p, s.get("excluded_objects", ())) | any_of(n, s.get("excluded_receptacles", ()))
        named = any_of(n, s.get("included_receptacles", ()))
        match = F.when(barred, False).when(p.isNull(), named).when(any_of(p, s.get("included_objects", ())) & named, True).otherwise(match)
    level = sum((F.get(down, F.lit(i)) * gravity[i] for i in (1, 2)), F.get(down, F.lit(0)) * gravity[0])
    return match & (level >= tilt)


def best_match(df: DataFrame, handle: str, wanted: str) -> DataFrame:
    """The handle itself, else the first that holds it in order."""
    return df.filter(search(F.col(handle), wanted)).orderBy((F.col(handle) != wanted).cast("int"), handle).limit(1)


def compatible(near: float, far: float, height: str = "dy", geodesic: str = "geodesic", euclid: str = "euclid", radius: str = "island_radius", ratio: float = 1.1) -> Column:
    """Start and goal on one floor of a large island, at a finite distance in range that isn't a straight line."""
    g = F.col(geodesic)
    return (F.abs(F.col(height)) <= 0.5) & g.isNotNull() & (g < float("inf")) & g.between(near, far) & (F.try_divide(g, F.col(euclid)) >= ratio) & (F.col(radius) >= 1.5)


def goals_once(df: DataFrame, key: str, goals: str, ordinal: str) -> DataFrame:
    """Of each key the goals that came first."""
    return df.groupBy(key).agg(F.min_by(goals, ordinal).alias(goals))


def grouped_order(df: DataFrame, scene: str, ordinal: str) -> DataFrame:
    """position: scenes in the order in which they first appear, rows within as they were.

    Ranks come from one row for each scene and a window within each, never from one window over all rows."""
    per = df.groupBy(scene).agg(F.min(ordinal).alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(scene, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"), F.row_number().over(Window.orderBy("_first")).alias("scene_rank"))
    out = df.join(per, scene)
    return out.withColumn("position", F.col("_base") + F.row_number().over(Window.partitionBy(scene).orderBy(ordinal)) - 1).drop("_base")


def rotated(df: DataFrame, rank: str = "scene_rank") -> DataFrame:
    """scene_rank with the first group moved to the end."""
    n = df.agg(F.max(rank)).first()[0] or 1
    return df.withColumn("rotated_rank", F.pmod(F.col(rank) - 2, F.lit(n)) + 1)


def hash_order(key: Column, seed: str) -> Column:
    """A shuffle's sort key, the same on every run and engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows without repeats; ValueError if there are fewer."""
    if df.count() < n:
        raise ValueError(f"{n} rows are wanted and there are fewer")
    return df.orderBy(hash_order(F.col(key), seed), key).limit(n)


def splits(df: DataFrame, key: str, n: int, seed: str, per_split: int | None = None, uneven: bool = False, scene: str | None = None) -> DataFrame:
    """split (0 to n - 1) and position in it, for rows drawn in shuffled order.

    Every split has `per_split` rows, or as many as go evenly; the rest is left out unless `uneven`, which gives the first
    splits one more.  With `scene` the rows that are drawn are put together by scene, scenes in the order of their first draw.
    ValueError if there are too few rows."""
    total = df.count()
    size = total // n if per_split is None else per_split
    if uneven and per_split is not None:
        raise ValueError("uneven splits have no fixed size")
    if size * n > total or size == 0:
        raise ValueError("there are too few rows for the splits")
    larger = total - size * n if uneven else 0
    shuffled = [hash_order(F.col(key), seed), F.col(key)]
    out = running(df, shuffled, name="_rank").filter(F.col("_rank") < size * n + larger)
    if scene is not None:
        first = out.groupBy(F.col(scene).alias("_s")).agg(F.min("_rank").alias("_first"))
        out = out.join(first, F.col(scene).eqNullSafe(F.col("_s"))).drop("_s", "_rank")
        out = running(out, [F.col("_first"), *shuffled], name="_rank").drop("_first")
    head = larger * (size + 1)  # rows of the larger splits
    split = F.when(F.col("_rank") < head, F.floor(F.col("_rank") / (size + 1))).otherwise(larger + F.floor((F.col("_rank") - head) / size))
    at = F.when(F.col("_rank") < head, F.col("_rank") % (size + 1)).otherwise((F.col("_rank") - head) % size)
    return out.withColumns({"split": split.cast("int"), "position": at.cast("long")}).drop("_rank")


def weighted_pick(items: DataFrame, draws: DataFrame, weight: str, key: str, cells: int = 1024) -> DataFrame:
    """Each draw u (0 to 1) gets the item on whose part of the summed weights it falls, items in order of `key`.

    Parts are laid out on cells of equal width, so a draw meets only those of its own cell; an item has a row for each cell that it
    touches, which are as many rows as items and cells together at most."""
    total = items.agg(F.sum(weight)).first()[0]
    if not total:
        return draws.join(items.limit(0), F.lit(False))
    cum = running(items, [F.col(key)], F.col(weight), "_lo").withColumns({"_hi": (F.col("_lo") + F.col(weight)) / F.lit(total), "_lo": F.col("_lo") / F.lit(total)})
    cell = lambda u: F.least(F.floor(u * cells), F.lit(cells - 1)).cast("int")
    cum = cum.filter("_hi > _lo").withColumn("_cell", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_hi")))))
    out = draws.withColumn("_at", cell(F.col("u"))).join(cum, (F.col("_at") == F.col("_cell")) & (F.col("u") >= F.col("_lo")) & (F.col("u") < F.col("_hi")))
    return out.drop("_lo", "_hi", "_cell", "_at")


def balanced_scene(position: Column, per_scene: int) -> Column:
    return F.floor(position / per_scene).cast("int")


def allocate(requests: DataFrame, capacity: DataFrame, place: str, order: str) -> DataFrame:
    """Requests in order until a place is full."""
    ranked = requests.withColumn("_n", F.row_number().over(Window.partitionBy(place).orderBy(order)))
    return ranked.join(capacity.select(place, "capacity"), place).filter(F.col("_n") <= F.col("capacity")).drop("_n", "capacity")


def round_robin(df: DataFrame, key: str, n: int, seed: str, base: int) -> DataFrame:
    """environment (0 to n - 1) in shuffled order, and its seed."""
    out = running(df, [hash_order(F.col(key), seed), F.col(key)], name="_rank")
    return out.withColumn("environment", F.pmod("_rank", F.lit(n)).cast("int")).withColumn("environment_seed", F.col("environment") + base).drop("_rank")


def scene_workers(df: DataFrame, scene: str, n: int, seed: str) -> DataFrame:
    """worker (0 to n - 1) of each row: the scenes are dealt in shuffled order, each to one worker, none having two more than another."""
    scenes = round_robin(df.select(scene).distinct(), scene, n, seed, 0).select(F.col(scene).alias("_s"), F.col("environment").alias("worker"))
    return df.join(scenes, F.col(scene) == F.col("_s")).drop("_s")


def first_valid(candidates: DataFrame, key: str, order: str, valid: Column, tries: int) -> DataFrame:
    """Rejection sampling over drawn candidates: of each key the first valid one among its first `tries`; without one, no row."""
    return candidates.filter((F.col(order) < tries) & valid).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")


def best_of(candidates: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """Of each key the candidate of the highest score, the first in order of `tie` of equal ones."""
    return candidates.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(score).desc(), tie))).filter("_n = 1").drop("_n")


def generated(candidates: DataFrame, scene: str, order: str, n: int, near: float, far: float, ratio: float = 1.1) -> DataFrame:
    """Point-goal episodes: of each scene's candidate pairs (dy, geodesic, euclid, island_radius) the first n compatible ones in
    order, numbered from 0 in episode_id."""
    good = candidates.filter(compatible(near, far, ratio=ratio))
    out = good.withColumn("episode_id", F.row_number().over(Window.partitionBy(scene).orderBy(order)) - 1)
    return out.filter(F.col("episode_id") < n)


def collated(df: DataFrame, scene: str, ordinal: str, item: str) -> DataFrame:
    """A row for each scene, with its items in order and its place by first appearance."""
    per = df.groupBy(scene).agg(F.min(ordinal).alias("_first"), F.transform(F.sort_array(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(item).alias("i")))), lambda x: x["i"]).alias("items"))
    return running(per, [F.col("_first")], name="position").drop("_first")


def chunks(df: DataFrame, key: str, n: int, seed: str, within: Sequence[str]) -> DataFrame:
    """Minibatch number of each row, by shuffled order within a key."""
    return df.withColumn("minibatch", F.ntile(n).over(Window.partitionBy(*within).orderBy(hash_order(F.col(key), seed), F.col(key))))
