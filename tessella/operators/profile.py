"""Nested profiler events: inclusive and exclusive time, and the comparison of runs."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import running

#: Events of a thread in one cell of its time, about; what one task sweeps.
CELL = 20_000
#: Children of one event that a row stands for before it is taken apart.
BLOCK = 4096


def _within(df: DataFrame, thread: str, *places: str) -> DataFrame:
    """`places`, counted over the whole table, counted from the thread's first row instead; `places[0]` is each row's own."""
    first = df.groupBy(F.col(thread).alias("_k")).agg(F.min(places[0]).alias("_first"))
    out = df.join(first, F.col(thread).eqNullSafe(F.col("_k")))
    return out.withColumns({p: F.col(p) - F.col("_first") for p in places}).drop("_k", "_first")


def event_order(df: DataFrame, thread: str = "thread", start: str = "start", end: str = "end") -> DataFrame:
    """Adds `position` within the thread, from 1: by start, of equal starts the longer first, then by id.

    Ranges of the order are ranked each by itself, so a thread that holds most events is no task's alone."""
    placed = running(df, [F.col(thread), F.col(start), -F.col(end), F.col("id")], name="position")
    return _within(placed, thread, "position").withColumn("position", F.col("position") + 1)


def nested(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, thread, start, end) -> thread, parent, child: positions (see event_order) of all pairs in which the later event of a thread
    starts within the earlier one, both ends included.

    In the order of a thread the children of an event are the events right behind it, up to the last that starts by its end.
    So one ranking of all starts and ends says for each event where its children end, and they are counted off: nothing is
    compared with anything, and only true pairs are made.  An event with many children is dealt out in blocks of them.  Events
    without a start or an end are in no pair and in no count; `id` names an event of its thread."""
    e = events.filter(F.col("start").isNotNull() & F.col("end").isNotNull())
    row = lambda time, kind, last, value: e.select("thread", F.col(time).alias("_t"), F.lit(kind).alias("_kind"), last.alias("_last"), "id", F.lit(value).alias("_v"))
    both = row("start", 0, -F.col("end"), 1).unionByName(row("end", 1, -F.col("end"), 0))
    placed = running(both, [F.col(x) for x in ("thread", "_t", "_kind", "_last", "id")], F.col("_v"), "_at")
    one = lambda kind: F.max(F.when(F.col("_kind") == kind, F.col("_at")))
    reach = placed.groupBy("thread", "id").agg(one(0).alias("_own"), one(1).alias("_past"))  # starts before its own, starts up to its end
    reach = _within(reach, "thread", "_own", "_past").select("thread", (F.col("_own") + 1).alias("parent"), F.col("_past").alias("_last")).filter("_last > parent")
    parts = reach.withColumn("_from", F.explode(F.sequence(F.col("parent") + 1, F.col("_last"), F.lit(block).cast("long"))))
    tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts.repartition(tasks, "thread", "parent", "_from")
    return parts.select("thread", "parent", F.explode(F.sequence("_from", F.least(F.col("_from") + block - 1, "_last"))).alias("child"))


def sweep(names: list, begin: list[int], end: list[int], busy: dict) -> None:
    """Pieces of events of one cell, in the order of events -> adds to busy, by name, the time for which each is the last of those that run."""
    starts: dict[int, list[int]] = {}
    for i, s in enumerate(begin):
        starts.setdefault(s, []).append(i)
    edges = sorted({*begin, *end})
    running_: list[int] = []
    for at, past in zip(edges, edges[1:], strict=False):
        for i in starts.get(at, ()):
            heapq.heappush(running_, -i)
        while running_ and end[-running_[0]] <= at:
            heapq.heappop(running_)
        if running_:
            name = names[-running_[0]]
            busy[name] = busy.get(name, 0) + past - at


def _sweeps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces of many cells, each swept when the next begins."""
    key, held, busy = None, ([], [], []), {}
    out = lambda: pa.record_batch([pa.array(list(busy), pa.string()), pa.array(list(busy.values()), pa.int64())], names=["name", "own"])
    for batch in batches:
        column = {n: batch.column(n).to_pylist() for n in ("thread", "_cell", "name", "s", "e")}
        for i, cell in enumerate(zip(column["thread"], column["_cell"], strict=True)):
            if cell != key:
                sweep(*held, busy)
                key, held = cell, ([], [], [])
            for x, n in zip(held, ("name", "s", "e"), strict=True):
                x.append(column[n][i])
        if len(busy) > 10_000:
            yield out()
            busy.clear()
    sweep(*held, busy)
    yield out()


def exclusive(events: DataFrame, cell: int = CELL) -> DataFrame:
    """(id, name, thread, start, end) -> name, own: the time of a name's events in which no later event of the thread runs.

    At any moment the time belongs to the last in order of the events that run, so the thread's time is swept once and no pairs
    are made.  A thread's time is cut into cells of equal width, of about `cell` events each; an event is swept in the cells
    where it starts and ends, and of those that run through a whole cell only the last in order can own time in it.  That
    one is found level by level: a run of cells is two blocks of a power of two, and blocks are halved until they are cells."""
    e = events.select("id", "name", "thread", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).filter("end > start")
    per = e.groupBy(F.col("thread").alias("_t")).agg(F.min("start").alias("_lo"), F.max("end").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    per = per.withColumn("_w", F.ceil((F.col("_hi") - F.col("_lo") + 1) / F.ceil(F.col("_n") / F.lit(cell))).cast("long"))
    at = lambda x: F.floor((F.col(x) - F.col("_lo")) / F.col("_w")).cast("long")
    rows = e.join(per, F.col("thread").eqNullSafe(F.col("_t"))).withColumns({"_a": at("start"), "_z": at("end")})
    low = F.col("_lo") + F.col("_cell") * F.col("_w")
    piece = [F.greatest("start", low).alias("s"), F.least("end", low + F.col("_w")).alias("e")]
    columns = ["thread", "_cell", "id", "name", "start", "end"]
    pieces = rows.withColumn("_cell", F.explode(F.array_distinct(F.array("_a", "_z")))).select(*columns, *piece)
    # blocks of 2 ** level cells that an event runs through, from _cell on; the best of each block is handed down
    through = rows.withColumn("_k", F.col("_z") - F.col("_a") - 1).filter("_k > 0").withColumn("_level", F.floor(F.log2("_k")).cast("int"))
    last = F.max(F.struct("start", (-F.col("end")).alias("_e"), "id", "name", "end", "_lo", "_w")).alias("_m")
    blocks = through.withColumn("_cell", F.explode(F.array_distinct(F.array(F.col("_a") + 1, F.col("_z") - F.pow(F.lit(2), F.col("_level")).cast("long")))))
    blocks = blocks.groupBy("thread", "_level", "_cell").agg(last)
    deepest = through.agg(F.max("_level")).first()[0]
    for level in range(deepest or 0, 0, -1):  # each level reads the one above it once
        here: Column = F.col("_level") == level
        parts = F.when(here, F.array(F.col("_cell"), F.col("_cell") + (1 << (level - 1)))).otherwise(F.array("_cell"))
        blocks = blocks.select("thread", F.when(here, F.lit(level - 1)).otherwise(F.col("_level")).alias("_level"), F.explode(parts).alias("_cell"), "_m")
        blocks = blocks.groupBy("thread", "_level", "_cell").agg(F.max("_m").alias("_m"))
    if deepest is not None:
        whole = blocks.select("thread", "_cell", "_m.*")
        pieces = pieces.unionByName(whole.select(*columns, low.alias("s"), (low + F.col("_w")).alias("e")))
    tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.filter("e > s").repartition(tasks, "thread", "_cell").sortWithinPartitions("thread", "_cell", "start", F.col("end").desc(), "id")
    own = dealt.select("thread", "_cell", F.col("name").cast("string").alias("name"), "s", "e").mapInArrow(_sweeps, "name string, own long")
    return own.groupBy("name").agg(F.sum("own").alias("own"))


def summary(events: DataFrame) -> DataFrame:
    """(id, name, thread, start, end) -> name, n, inclusive, exclusive; times are whole numbers.

    Exclusive time is an event's own minus the union of what overlaps it from later events of its thread; children that outlive the
    event count up to its end."""
    own = events.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("inclusive"))
    return own.join(exclusive(events), "name", "left").select("name", "n", "inclusive", F.coalesce("own", F.lit(0)).alias("exclusive"))


def aligned(summaries: Sequence[DataFrame], value: str = "inclusive") -> DataFrame:
    """name, v0, v1, ..., sort_key: one column for each summary, null where the name is missing; the key is that of the first summary that has it."""
    parts = [s.select("name", F.col(value).alias(f"v{i}")) for i, s in enumerate(summaries)]
    out = reduce(lambda a, b: a.join(b, "name", "full_outer"), parts)
    return out.withColumn("sort_key", F.coalesce(*[F.col(f"v{i}") for i in range(len(parts))]))


def relative(df: DataFrame, n: int) -> DataFrame:
    """aligned() with the first column taken off the others where both are there."""
    return df.select("name", "v0", *[F.when(F.col("v0").isNotNull(), F.col(f"v{i}") - F.col("v0")).otherwise(F.col(f"v{i}")).alias(f"v{i}") for i in range(1, n)])
