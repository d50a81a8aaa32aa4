"""Graphs as edge tables: islands, shortest paths, forests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def islands(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """vertex, island (the smallest vertex reached), for the vertices given and all ends of edges.  Labels fall to the neighbours' least and then to that label's own label, so
    long chains halve each round."""
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    ends = vertices.select("vertex").union(both.select(F.col("src").alias("vertex"))).distinct()
    now = cut(ends.select("vertex", F.col("vertex").alias("island")))
    while True:
        near = both.join(now.select(F.col("vertex").alias("dst"), "island"), "dst").groupBy(F.col("src").alias("vertex")).agg(F.min("island").alias("_near"))
        step = now.join(near, "vertex", "left").select("vertex", F.col("island").alias("_was"), F.least("island", F.coalesce("_near", "island")).alias("_i"))
        jump = step.select(F.col("vertex").alias("_v"), F.col("_i").alias("_j"))
        step = cut(step.join(jump, F.col("_i") == F.col("_v"), "left").select("vertex", "_was", F.least("_i", F.coalesce("_j", "_i")).alias("island")))
        if not step.filter("_was != island").limit(1).count():
            return step.select("vertex", "island")
        now = step.select("vertex", "island")


def shortest(edges: DataFrame, sources: DataFrame, rounds: int = 1000) -> DataFrame:
    """(src, dst, weight), (source, vertex, cost 0) -> least cost of each vertex reached from each source; only what improved goes on."""
    best = cut(sources.select("source", "vertex", F.lit(0.0).alias("cost")))
    front = best
    for _ in range(rounds):
        new = front.join(edges, F.col("vertex") == F.col("src")).groupBy("source", F.col("dst").alias("vertex")).agg(F.min(F.col("cost") + F.col("weight")).alias("_c"))
        both = cut(best.join(new, ["source", "vertex"], "full_outer").select("source", "vertex", "cost", "_c"))
        front = both.filter(F.col("_c").isNotNull() & (F.col("cost").isNull() | (F.col("_c") < F.col("cost")))).select("source", "vertex", F.col("_c").alias("cost"))
        if not front.limit(1).count():
            return best
        best = both.select("source", "vertex", F.least("cost", "_c").alias("cost"))
    raise ValueError("the paths haven't settled")


def nearest_goal(costs: DataFrame, goals: DataFrame) -> DataFrame:
    """Of each source the goal of least cost, ties by id; none reached: no row."""
    return costs.join(goals, "vertex", "left_semi").groupBy("source").agg(F.min(F.struct("cost", "vertex")).alias("b")).select("source", F.col("b.vertex").alias("goal"), "b.cost")


def roots(relations: DataFrame) -> DataFrame:
    """(child, parent) -> the parents that are no child."""
    return relations.select(F.col("parent").alias("root")).distinct().join(relations, F.col("root") == F.col("child"), "left_anti")


def placed(relations: DataFrame, offsets: DataFrame, root_places: DataFrame, rounds: int = 64) -> DataFrame:
    """Places and levels of all nodes below the roots: a child's place is its parent's plus its own offset, down the forest.
    (child, parent), (child, dx, dy, dz), (node, x, y, z).

    Every round a node takes over what its ancestor so far knows, so paths double and a forest of depth d takes log2(d) rounds.
    ValueError for a cycle."""
    axes = ("x", "y", "z")
    root = root_places.select("node", *axes)
    now = relations.join(offsets, "child").select(F.col("child").alias("node"), F.col("parent").alias("up"), *[F.col(f"d{a}").alias(a) for a in axes], F.lit(1).alias("level"))
    tops = root.select(F.col("node").alias("_r")).distinct()
    now = cut(now.join(tops, F.col("node") == F.col("_r"), "left_anti"))
    for _ in range(rounds):
        over = now.select(F.col("node").alias("_n"), F.col("up").alias("_up"), *[F.col(a).alias(f"_{a}") for a in axes], F.col("level").alias("_level"))
        step = now.join(over, F.col("up") == F.col("_n"), "left")
        add = lambda a: (F.col(a) + F.coalesce(f"_{a}", F.lit(0))).alias(a)
        step = cut(step.select("node", F.coalesce("_up", "up").alias("up"), *[add(a) for a in axes], add("level"), F.col("_n").isNotNull().alias("_moved")))
        now = step.drop("_moved")
        if not step.filter("_moved").limit(1).count():
            break
    else:
        raise ValueError("the relations have a cycle")
    tops = root.select(F.col("node").alias("_r"), *[F.col(a).alias(f"_{a}") for a in axes])
    below = now.join(tops, F.col("up") == F.col("_r")).select("node", *[(F.col(a) + F.col(f"_{a}")).alias(a) for a in axes], "level")
    return root.withColumn("level", F.lit(0)).unionByName(below)


def same_kind_edges(edges: DataFrame, kinds: DataFrame, vertex: str, kind: str) -> DataFrame:
    """The edges (src, dst) whose ends are of one kind: islands() of these are the connected patches of a colour."""
    k = kinds.select(F.col(vertex).alias("_v"), F.col(kind).alias("_k"))
    out = edges.join(k, F.col("src") == F.col("_v")).select("src", "dst", F.col("_k").alias("_a"))
    return out.join(k, F.col("dst") == F.col("_v")).filter(F.col("_a") == F.col("_k")).select("src", "dst")


def plans(start: DataFrame, actions: DataFrame, goals: DataFrame, depth: int) -> DataFrame:
    """Breadth-first search over sets of facts: state, plan (names of actions) and length of the shortest plans that reach the goals.

    start (facts array<string>), actions (name, needs, adds, removes: arrays of strings), goals (fact); with a column problem in start
    and goals, many searches at once, each of which ends with its own first plans.  A state is its sorted set of facts; a problem visits each
    once, by the first plan in order of names; states after `depth` actions aren't expanded.  Every round is an equi-join of the states
    reached last with the actions that need one of their facts, and an anti join with all states before."""
    many, sorted_ = "problem" in start.columns, lambda c: F.array_sort(F.array_distinct(c))
    keyed = lambda df: df if many else df.withColumn("problem", F.lit(0))
    none = F.array().cast("array<string>")
    wanted = cut(keyed(goals).groupBy(F.col("problem").alias("_p")).agg(F.collect_set("fact").alias("_goal")))
    able = cut(actions.select("name", "needs", "adds", "removes", F.coalesce(F.get("needs", F.lit(0)), F.lit("")).alias("_first")))
    front = cut(keyed(start).select("problem", sorted_(F.col("facts")).alias("state"), none.alias("plan")).distinct())
    seen, found = front.select("problem", "state"), []
    for length in range(depth + 1):
        met = front.join(wanted, F.col("problem").eqNullSafe(F.col("_p")), "left")
        found.append(cut(met.filter(F.size(F.array_except(F.coalesce("_goal", none), "state")) == 0).select("problem", "state", "plan", F.lit(length).alias("length"))))
        if length == depth:
            break
        over = found[-1].select(F.col("problem").alias("_p")).distinct()
        step = front.join(over, F.col("problem").eqNullSafe(F.col("_p")), "left_anti")
        step = step.withColumn("_fact", F.explode(F.concat("state", F.array(F.lit(""))))).join(able, F.col("_fact") == F.col("_first"))
        step = step.filter(F.size(F.array_except("needs", "state")) == 0)
        step = step.select("problem", sorted_(F.array_union(F.array_except("state", "removes"), F.col("adds"))).alias("state"), F.concat("plan", F.array("name")).alias("plan"))
        before = seen.select(F.col("problem").alias("_p"), F.col("state").alias("_s"))
        fresh = step.groupBy("problem", "state").agg(F.min("plan").alias("plan"))
        front = cut(fresh.join(before, F.col("problem").eqNullSafe(F.col("_p")) & (F.col("state") == F.col("_s")), "left_anti"))
        if not front.limit(1).count():
            break
        seen = cut(seen.union(front.select("problem", "state")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out if many else out.drop("problem")
