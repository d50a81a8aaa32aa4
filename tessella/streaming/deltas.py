"""Change streams: encoding, replay, consolidation and bounded histories, in batch and as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.scans import Fold


def changes(df: DataFrame, key: str, seq: str, state: str) -> DataFrame:
    """Only the rows whose state differs from the key's row before; the first always counts."""
    before, first = F.lag(state).over(w := Window.partitionBy(key).orderBy(seq)), F.row_number().over(w)
    return df.withColumn("_b", before).withColumn("_n", first).filter((F.col("_n") == 1) | ~F.col("_b").eqNullSafe(F.col(state))).drop("_b", "_n")


def rig_changes(df: DataFrame, key: str, seq: str, bone: str, state: str) -> DataFrame:
    """Of each key the whole poses (all bones of a seq) in which the state of any bone differs from that bone's row before; the first always counts."""
    before, first = F.lag(state).over(w := Window.partitionBy(key, bone).orderBy(seq)), F.row_number().over(w)
    moved = df.withColumn("_b", before).withColumn("_n", first).withColumn("_m", (F.col("_n") == 1) | ~F.col("_b").eqNullSafe(F.col(state)))
    return moved.withColumn("_any", F.max("_m").over(Window.partitionBy(key, seq))).filter("_any").drop("_b", "_n", "_m", "_any")


def replay(df: DataFrame, key: str, seq: str, op: str, state: str, until: int | None = None) -> DataFrame:
    """The live keys after keyframe `until` with their last state: what was deleted last is gone."""
    past = df if until is None else df.filter(F.col(seq) <= until)
    last = past.groupBy(key).agg(F.max_by(F.struct(op, state), seq).alias("_l"), F.max(seq).alias(seq))
    return last.filter(F.col(f"_l.{op}") != "delete").select(key, F.col(f"_l.{state}").alias(state), seq)


def consolidated(df: DataFrame, key: str, seq: str, op: str, state: str) -> DataFrame:
    """One row for each key of a batch: its last operation; a key created and deleted within the batch leaves nothing."""
    g = df.groupBy(key).agg(F.max_by(F.struct(op, state), seq).alias("_l"), F.max(seq).alias(seq), F.max((F.col(op) == "create").cast("int")).alias("_c"))
    g = g.filter(~((F.col(f"_l.{op}") == "delete") & (F.col("_c") == 1)))
    return g.select(key, F.col(f"_l.{op}").alias(op), F.when(F.col(f"_l.{op}") != "delete", F.col(f"_l.{state}")).alias(state), seq)


def last_fields(df: DataFrame, key: Sequence[str], seq: str, fields: Sequence[str]) -> DataFrame:
    """Last writer wins for each field by itself; a null doesn't write."""
    return df.groupBy(*key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(seq))).alias(f) for f in fields])


def history(df: DataFrame, key: str, seq: str, n: int = 4) -> DataFrame:
    """The last n rows of each key; age 0 is the newest."""
    return df.withColumn("age", F.row_number().over(Window.partitionBy(key).orderBy(F.col(seq).desc())) - 1).filter(F.col("age") < n)


def known(df: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Updates of live keys; others are passed over."""
    return df.join(live.select(key).distinct(), key, "left_semi")


def input_fold(df: DataFrame, key: str, seq: str) -> DataFrame:
    """(kind, button, amount) -> for each key its pressed buttons' last event and the sum of scrolling."""
    last = df.filter(F.col("kind").isin("down", "up")).groupBy(key, "button").agg(F.max_by("kind", seq).alias("kind"))
    down = last.filter("kind = 'down'").groupBy(key).agg(F.sort_array(F.collect_list("button")).alias("held"))
    scroll = df.groupBy(key).agg(F.sum(F.when(F.col("kind") == "scroll", F.col("amount")).otherwise(0.0)).alias("scroll"))
    return scroll.join(down, key, "left")


def merge_stream(stream: DataFrame, read_state: Callable[[SparkSession], DataFrame], write_state: Callable[[DataFrame, int], None], key: str, seq: str, op: str, state: str, checkpoint: str) -> StreamingQuery:
    """foreachBatch: each micro-batch is consolidated and laid over the kept snapshot; a batch that comes again changes nothing, since
    the later `seq` wins.  write_state must put the new snapshot in place before it returns."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = read_state(spark).withColumn(op, F.lit("update")).select(key, seq, op, state)
        write_state(replay(old.unionByName(batch.select(key, seq, op, state)), key, seq, op, state), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def change_stream(stream: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """changes() with the last state of a key kept between micro-batches; (key long, seq long, value double)."""

    def fold(k: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for pdf in frames:
            out.append(pdf)
        pdf = pd.concat(out).sort_values(seq)
        before = pdf[value].shift()
        before.iloc[0] = last
        state.update((float(pdf[value].iloc[-1]),))
        yield pdf[(pdf[value] != before)][[key, seq, value]]

    return stream.groupBy(key).applyInPandasWithState(fold, f"{key} long, {seq} long, {value} double", "last double", "append", GroupStateTimeout.NoTimeout)


def rates(stream: DataFrame, ts: str, width: str, late: str) -> DataFrame:
    """Rows in each event-time window, late rows up to `late` included."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def rate_track(times: Column, window: float) -> Column:
    """Of an ordered array of times the rates struct(at, rate): when more than `window` has passed since the last of them (at first, since the
    first time) the number of times since then over what passed, itself included."""
    start = F.struct(F.get(times, F.lit(0)).alias("since"), F.lit(0).alias("n"), F.array().cast("array<struct<at:double,rate:double>>").alias("out"))

    def step(a: Column, t: Column) -> Column:
        n, elapsed = a["n"] + 1, t - a["since"]
        due = elapsed > window
        told = F.concat(a["out"], F.array(F.struct(t.alias("at"), (n / elapsed).alias("rate"))))
        return F.struct(F.when(due, t).otherwise(a["since"]).alias("since"), F.when(due, 0).otherwise(n).alias("n"), F.when(due, told).otherwise(a["out"]).alias("out"))

    return F.aggregate(times, start, step)["out"]


def catch_up(df: DataFrame, key: str, seq: str, op: str, state: str, joined: int) -> DataFrame:
    """What a late joiner gets: the snapshot of all that is live when it joins, at seq `joined`, then the changes after that."""
    snapshot = replay(df, key, seq, op, state, joined).withColumn(op, F.lit("create")).withColumn("snapshot", F.lit(True))
    later = df.filter(F.col(seq) > joined).withColumn("snapshot", F.lit(False))
    columns = [key, seq, op, state, "snapshot"]
    return snapshot.select(*columns).unionByName(later.select(*columns))


def by_user(df: DataFrame, mask: str, users: int) -> DataFrame:
    """A message for each user (0 to users - 1) whose bit its mask has."""
    return df.withColumn("user", F.explode(F.filter(F.sequence(F.lit(0), F.lit(users - 1)), lambda i: F.getbit(F.col(mask), i) == 1)))


def recorded(df: DataFrame, step: str, scope: str, key: str, value: str) -> DataFrame:
    """A map of 'scope/key' to value for each step; the query fails on a key that comes twice in a step (its scopes included)."""
    name = F.when(F.length(scope) > 0, F.concat_ws("/", scope, key)).otherwise(F.col(key))
    return df.groupBy(step).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(name.alias("k"), F.col(value).alias("v"))))).alias("record"))


def stragglers(df: DataFrame, done: str, total: str, fraction: float, least: float = 0.25) -> DataFrame:
    """preempt: whether a worker that has done at least `least` of its steps stops, since more than `fraction` of the workers are done."""
    over = df.agg((F.avg((F.col(done) >= F.col(total)).cast("int")) > fraction).alias("_over"))
    return df.crossJoin(F.broadcast(over)).withColumn("preempt", F.col("_over") & (F.col(done) < F.col(total)) & (F.col(done) >= least * F.col(total))).drop("_over")


def states(df: DataFrame, owner: str, state: str, value: str, seq: str, defaults: dict[str, object]) -> DataFrame:
    """state, object, value: the last value of every object in every state of `defaults`, its default where it was never set."""
    told = df.filter(F.col(state).isin(*defaults)).groupBy(F.col(state).alias("state"), F.col(owner).alias("object")).agg(F.max_by(value, seq).alias("_v"))
    known = F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), F.lit(v))])
    every = df.select(F.col(owner).alias("object")).distinct().select("object", F.explode(known).alias("state", "_d"))
    return every.join(told, ["object", "state"], "left").select("state", "object", F.coalesce("_v", "_d").alias("value"))


def objects_in(snapshot: DataFrame, state: str, value: object) -> DataFrame:
    """The objects that have a value in a state."""
    return snapshot.filter((F.col("state") == state) & (F.col("value") == F.lit(value))).select("object")


def folded_stream(stream: DataFrame, key: str, order: str, values: Sequence[str], fold: Fold) -> DataFrame:
    """What scans.scanned() gives, over a stream: a key's state is kept between micro-batches; of each batch its rows come in order.

    key long, order long; rows must not come later than ones behind them in order of an earlier batch."""
    kept = ", ".join(f"s{i} double" for i in range(len(fold.start)))
    told = [x.split()[0] for x in fold.schema.split(", ")]

    def run(k: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, out = tuple(state.get) if state.exists else fold.start, []
        for row in pd.concat(list(frames)).sort_values(order)[[order, *values]].itertuples(index=False):
            now, made = fold.step(now, tuple(float(v) for v in row[1:]))
            if made is not None:
                out.append((k[0], row[0], *made))
        state.update(now)
        yield pd.DataFrame(out, columns=[key, order, *told])

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} long, {order} long, {fold.schema}", kept, "append", GroupStateTimeout.NoTimeout)


def fan_out(stream: DataFrame, user: str, seq: str, payload: str, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Writes to each user, batch by batch, a line {"keyframes": [...]} with the payloads meant for them in order of seq (path/batch=n/user=m).

    `every` is the least time between batches (as '20 milliseconds'); without it what is there is written at once and the query ends.  A batch that
    comes again replaces what it wrote."""

    def step(batch: DataFrame, number: int) -> None:
        frames = F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(payload).alias("p")))), lambda x: x["p"])
        line = F.concat(F.lit('{"keyframes": ['), F.array_join(frames, ", "), F.lit("]}"))
        batch.groupBy(user).agg(line.alias("value")).write.mode("overwrite").partitionBy(user).text(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
