"""Connected components of a link table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut

#: So many links are few enough for one task; more are contracted by all.
LOCAL = 50_000


def _hung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links to the root of each of their nodes, the smallest that is reached."""
    up, kind = {}, None

    def root(x: object) -> object:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    nodes = list(up)
    if nodes:
        yield pa.record_batch([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], names=["node", "up"])


def components(links: DataFrame, label: DataFrame) -> DataFrame:
    """links (a, b), label (node, label) -> node, label: the smallest label that a node with a link reaches.

    Each round hangs every node under the smallest of its neighbours and itself, shortens these chains until each ends in its
    root, and keeps only the links between different roots.  A round's links and nodes are what the one before has left, so a crowd
    around a few nodes is gone after the first.  All rounds are pre-aggregated joins on written tables, until no more than LOCAL links are left:
    these one task joins at once.  Only counts come to the driver."""
    ordered = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    edges, rounds = cut(links.filter("a != b").select(*ordered("a", "b")).distinct()), []
    while (left := edges.count()) > LOCAL:
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("_o")).union(edges.select("b", "a"))
        up = cut(ends.groupBy("node").agg(F.min("_o").alias("_o")).select("node", F.least("node", "_o").alias("up")))
        while True:
            over = up.select(F.col("node").alias("_n"), F.col("up").alias("_up"))
            step = cut(up.join(over, F.col("up") == F.col("_n")).select("node", F.col("up").alias("_was"), F.col("_up").alias("up")))
            up = step.select("node", "up")
            if not step.filter("_was != up").limit(1).count():
                break
        rounds.append(up)
        root = lambda c: up.select(F.col("node").alias(c), F.col("up").alias(f"_{c}"))  # noqa: B023, E731
        apart = edges.join(root("a"), "a").join(root("b"), "b").filter("_a != _b")
        edges = cut(apart.select(*ordered("_a", "_b")).distinct())
    if left:
        kind = edges.schema["a"].dataType.simpleString()
        rounds.append(cut(edges.coalesce(1).mapInArrow(_hung, f"node {kind}, up {kind}")))
    if not rounds:
        return label.limit(0).select("node", "label")
    top = rounds[-1]
    for below in reversed(rounds[:-1]):
        over = top.select(F.col("node").alias("_n"), F.col("up").alias("_up"))
        top = below.join(over, F.col("up") == F.col("_n"), "left").select("node", F.coalesce("_up", "up").alias("up"))
    own = cut(top.join(label.select("node", "label"), "node"))
    least = own.groupBy(F.col("up").alias("_up")).agg(F.min("label").alias("_label"))
    return own.join(least, F.col("up") == F.col("_up")).select("node", F.col("_label").alias("label"))
