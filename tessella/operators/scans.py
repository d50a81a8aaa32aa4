"""Folds over the ordered rows of each key with state carried from range to range, for keys of any length."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

State = tuple[float, ...]


@dataclass(frozen=True)
class Fold:
    """What a key's rows do to a state of numbers, in order.

    step(state, values) gives the next state and a row of `schema`, or None for no row.  `linear`: the state after some rows is an
    affine map of the state before them, so ranges can be composed without being read again."""

    start: State
    step: Callable[[State, tuple], tuple[State, tuple | None]]
    schema: str
    linear: bool = False


def discounted(gamma: float, last: float = 0.0) -> Fold:
    """From the last step to the first, values (reward, mask): return = reward + gamma * mask * the next step's return."""

    def step(state: State, row: tuple) -> tuple[State, tuple]:
        value = row[0] + gamma * state[0] * row[1]
        return (value,), (value,)

    return Fold((last,), step, "ret double", True)


def advantages(gamma: float, tau: float, last: float = 0.0) -> Fold:
    """From the last step to the first, values (reward, value, mask): generalised advantage plus value."""

    def step(state: State, row: tuple) -> tuple[State, tuple]:
        reward, value, mask = row
        gain = reward + gamma * state[1] * mask - value + gamma * tau * mask * state[0]
        return (gain, value), (gain + value,)

    return Fold((0.0, last), step, "ret double", True)


def hysteresis(least: float) -> Fold:
    """Values (force,): what it adds over the last level, and the sum of what rose by more than `least`.  The first force sets the level and adds 0;
    the level moves only on such a rise or on a fall, whose negative addition is told but not summed."""

    def step(state: State, row: tuple) -> tuple[State, tuple]:
        level, total = (row[0] if math.isnan(state[0]) else state[0]), state[1]
        added = row[0] - level
        if added > least:
            return (row[0], total + added), (added, total + added)
        if added < 0:
            return (row[0], total), (added, total)
        return (level, total), (0.0, total)

    return Fold((math.nan, 0.0), step, "add double, accum double")


def rates(window: float) -> Fold:
    """Values (time,): when more than `window` has passed since the last row (at first, since the first time), the number of times since then
    over what passed, itself included."""

    def step(state: State, row: tuple) -> tuple[State, tuple | None]:
        since, n = (row[0] if math.isnan(state[0]) else state[0]), state[1] + 1
        if row[0] - since > window:
            return (row[0], 0.0), (row[0], n / (row[0] - since))
        return (since, n), None

    return Fold((math.nan, 0.0), step, "at double, rate double")


def limited(period: float) -> Fold:
    """Values (time,) of requests: when each may go on.  A limiter's clock starts with the first request and moves on by a period with each; it
    is never more than two periods behind, so what was missed is made up for by two calls at most; a request waits for the one before it."""

    def step(state: State, row: tuple) -> tuple[State, tuple]:
        clock, busy = state
        if math.isnan(clock):
            clock, busy = row[0], row[0]
        now = max(row[0], busy)
        clock = max(clock, now - 2 * period)
        go = now + max(0.0, period - (now - clock))
        return (clock + period, go), (go,)

    return Fold((math.nan, math.nan), step, "released double")


def _rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """(key, order, values) of sorted rows, with a mark for the first row of a key: (fresh, key, at, values)."""
    before, first = None, True
    for batch in batches:
        key, at, *values = (c.to_pylist() for c in batch.columns[: 2 + width])
        for i, k in enumerate(key):
            yield first or k != before, k, at[i], tuple(v[i] for v in values)
            before, first = k, False


def _summary(fold: Fold, width: int) -> Callable:
    d = len(fold.start)
    unit = [tuple(1.0 if i == j else 0.0 for j in range(d)) for i in range(d)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        head = next((b for b in batches if b.num_rows), None)
        if head is None:
            return
        part, states, first, several, key = head.column("_part")[0].as_py(), [], None, False, None

        def rest() -> Iterator[pa.RecordBatch]:
            yield head
            yield from batches

        for fresh, k, _, values in _rows(rest(), width):
            if fresh:
                several = several or bool(states)
                first = (k,) if first is None else first
                states, key = [fold.start, *([(0.0,) * d, *unit] if fold.linear and not several else [])], k
            states = [fold.step(s, values)[0] for s in states]
        kind = head.schema.field(0).type
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([first[0]], kind), pa.array([key], kind), pa.array([several]), pa.array([[list(s) for s in states]], pa.list_(pa.list_(pa.float64())))], names=["part", "first", "last", "several", "states"])

    return run


def _apply(fold: Fold, width: int, carried: dict[int, State], names: list[str], schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        head = next((b for b in batches if b.num_rows), None)
        if head is None:
            return

        def rest() -> Iterator[pa.RecordBatch]:
            yield head
            yield from batches

        state, began, out = carried.get(head.column("_part")[0].as_py()), False, []
        for fresh, key, at, values in _rows(rest(), width):
            if fresh and (began or state is None):
                state = fold.start
            began = True
            state, row = fold.step(state, values)
            if row is not None:
                out.append((key, at, *row))
            if len(out) >= 10_000:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def scanned(df: DataFrame, key: str, order: Column, values: Sequence[Column], fold: Fold, name: str = "at") -> DataFrame:
    """key, `name` (the value of `order`) and what the fold gives for the rows of each key, ascending by `order` (all different within a key).

    The table is dealt into ranges of (key, order) and every range is folded by its own task, so neither a task nor an array holds
    a long key.  A range that begins within a key needs the state that the ranges before leave: it is known where the key began in the
    range before, and is composed from two numbers and more for each range if the fold is linear.  Else a key that fills whole ranges
    has them folded one after the other.  The driver holds one row for each range.  Values that are null count as 0."""
    tasks, width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(values)
    own = df.select(F.col(key).alias("key"), order.alias("at"), *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(f"v{i}") for i, v in enumerate(values)])
    dealt = cut(own.repartitionByRange(tasks, "key", "at").withColumn("_part", F.spark_partition_id())).sortWithinPartitions("key", "at")
    kind = {f.name: f.dataType.simpleString() for f in own.schema}
    told = dealt.mapInArrow(_summary(fold, width), f"part int, first {kind['key']}, last {kind['key']}, several boolean, states array<array<double>>")
    carried: dict[int, State] = {}
    before = None  # last key and its state
    for r in sorted(told.collect(), key=lambda r: r["part"]):
        states = [tuple(s) for s in r["states"]]
        goes_on = before is not None and before[0] == r["first"]
        if goes_on:
            carried[r["part"]] = before[1]
        if r["several"] or not goes_on:
            after = states[0]
        elif fold.linear:
            zero, units = states[1], states[2:]
            after = tuple(z + sum(c * (u[i] - z) for c, u in zip(before[1], units, strict=True)) for i, z in enumerate(zero))
        else:
            after = _through(dealt.filter(F.col("_part") == r["part"]), fold, width, before[1])
        before = (r["last"], after)
    out = f"{key} {kind['key']}, {name} {kind['at']}, {fold.schema}"
    arrow = pa.schema([(key, _arrow(dealt, "key")), (name, _arrow(dealt, "at")), *[(x.split()[0], pa.float64()) for x in fold.schema.split(", ")]])
    return dealt.mapInArrow(_apply(fold, width, carried, [key, name], arrow), out)


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _through(part: DataFrame, fold: Fold, width: int, state: State) -> State:
    """The state after a range that holds rows of one key only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, some = state, False
        for _, _, _, values in _rows(batches, width):
            now, some = fold.step(now, values)[0], True
        if some:
            yield pa.record_batch([pa.array([list(now)], pa.list_(pa.float64()))], names=["state"])

    return tuple(part.mapInArrow(run, "state array<double>").first()["state"])
