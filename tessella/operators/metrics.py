"""Episode metrics over step logs, as windows and aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def over(key: Sequence[str], order: Sequence[str | Column]) -> WindowSpec:
    return Window.partitionBy(*key).orderBy(*order)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def windowed_mean(value: Column, w: WindowSpec, n: int) -> Column:
    """Mean of the last n rows; n <= 0: of all so far."""
    return F.avg(value).over(w.rowsBetween(-(n - 1), 0) if n > 0 else so_far(w))


def emitted(value: Column, w: WindowSpec, rate: int) -> Column:
    """The value at every rate-th row, else null."""
    return F.when(F.row_number().over(w) % rate == 0, value)


def delta_ratio(total: Column, count: Column, w: WindowSpec, n: int) -> Column:
    """Growth of a running total over that of a running count (1 at least) across the last n snapshots; of one snapshot its own values."""
    frame = w.rowsBetween(-(n - 1), 0)
    rows = F.count(F.lit(1)).over(frame)
    d = lambda c: F.when(rows == 1, c).otherwise(F.last(c).over(frame) - F.first(c).over(frame))
    return d(total) / F.greatest(d(count), F.lit(1))


def step_length(x: Column, y: Column, z: Column, w: WindowSpec) -> Column:
    d = [c - F.lag(c).over(w) for c in (x, y, z)]
    return F.coalesce(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]), F.lit(0.0))


def spl(success: Column, start: Column, path: Column) -> Column:
    """success * start / max(start, path); null for a start distance of 0 and no path, or an infinite one."""
    return success * F.try_divide(start, F.greatest(start, path))


def soft_spl(now: Column, start: Column, path: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.try_divide(now, start)) * F.try_divide(start, F.greatest(start, path))


def ever(flag: Column, w: WindowSpec) -> Column:
    return F.max(flag).over(so_far(w))


def first_time(flag: Column, w: WindowSpec) -> Column:
    """True at the first row at which the flag holds."""
    return flag & (F.sum(flag.cast("int")).over(so_far(w)) == 1)


def alternates(action: Column, w: WindowSpec, n: int, turns: tuple[str, str]) -> Column:
    """Whether the last n actions are the two turns by turns."""
    last = F.lag(action).over(w)
    swap = (action.isin(*turns) & last.isin(*turns) & (action != last)).cast("int")
    return swap, lambda c: (F.min(c).over(w.rowsBetween(-(n - 2), 0)) == 1) & (F.count(c).over(w.rowsBetween(-(n - 2), 0)) == n - 1)


def rank_of(scores: Column, label: Column) -> Column:
    """1 + how many of the scores (an array) exceed that in place `label`, from 0."""
    own = F.get(scores, label.cast("int"))
    return (1 + F.size(F.filter(scores, lambda x: x > own))).cast("long")


def first_time_reward(flag: Column, w: WindowSpec, reward: float) -> Column:
    """The reward at the first row of w at which the flag holds, else 0."""
    return F.when(first_time(flag, w), F.lit(reward)).otherwise(0.0)


def mean_of_all(values: DataFrame, key: str, value: str, episodes: DataFrame | None = None) -> DataFrame:
    """A metric's sum over the number of all episodes (the rows of `episodes`, else of values): one without the metric counts 0."""
    total = (values if episodes is None else episodes).agg(F.count(F.lit(1)).alias("_n"))  # one row
    return values.groupBy(key).agg(F.sum(value).alias("_s")).crossJoin(F.broadcast(total)).select(key, (F.col("_s") / F.col("_n")).alias("mean"))


def mean_of_having(values: DataFrame, key: str, value: str) -> DataFrame:
    return values.groupBy(key).agg(F.avg(value).alias("mean"))


def mean_ci(df: DataFrame, key: str, value: str, t: float = 2.228) -> DataFrame:
    return df.groupBy(key).agg(F.avg(value).alias("mean"), (t * F.stddev_pop(value) / F.sqrt(F.count(value))).alias("ci"))


def distributed_moments(df: DataFrame, worker: str, value: str) -> DataFrame:
    """Mean of the workers' means, then mean of their mean squared deviations from it."""
    by = df.groupBy(worker).agg(F.avg(value).alias("m"), F.avg(F.col(value) * F.col(value)).alias("q"))
    return by.agg(F.avg("m").alias("mean"), F.avg("m").alias("_g"), F.avg("q").alias("_q"), F.avg("m").alias("_m")).select("mean", (F.col("_q") - 2 * F.col("_g") * F.col("_m") + F.col("_g") * F.col("_g")).alias("var"))


def ema(values: Column, decay: float = 0.95) -> Column:
    """Exponential mean of an ordered array."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda a, x: F.when(a.isNull(), x).otherwise(a * decay + x * (1 - decay)))


def merge_moments(batches: Column) -> Column:
    """Fold of structs (n, mean, var), in order, into one by the parallel-variance rule."""
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("var"))

    def step(a: Column, b: Column) -> Column:
        n, d = a["n"] + b["n"], b["mean"] - a["mean"]
        m2 = a["var"] * a["n"] + b["var"] * b["n"] + d * d * a["n"] * b["n"] / n
        return F.struct(n.alias("n"), ((a["mean"] * a["n"] + b["mean"] * b["n"]) / n).alias("mean"), (m2 / n).alias("var"))

    return F.aggregate(batches, zero, step)


def discounted(rewards: Column, masks: Column, gamma: float, last: float = 0.0) -> Column:
    """Returns of an ordered reward array, from its end: r + gamma * next * mask, masks[i] belonging to the step after i."""
    pairs = F.reverse(F.zip_with(rewards, masks, lambda r, m: F.struct(r.alias("r"), m.alias("m"))))
    out = F.aggregate(pairs, F.array(F.lit(last)), lambda acc, x: F.concat(F.array(x["r"] + gamma * F.get(acc, F.lit(0)) * x["m"]), acc))
    return F.slice(out, 1, F.size(rewards))


def gae(rewards: Column, values: Column, masks: Column, gamma: float, tau: float, last: float = 0.0) -> Column:
    """Generalised advantages plus values; same layout as discounted()."""
    n = F.size(rewards)

    def step(acc: Column, i: Column) -> Column:
        r, v, m = F.get(rewards, i), F.get(values, i), F.get(masks, i)
        after = F.coalesce(F.get(values, i + 1), F.lit(last))
        ahead = F.coalesce(F.get(acc, F.lit(0))["g"], F.lit(0.0))
        g = r + gamma * after * m - v + gamma * tau * m * ahead
        return F.concat(F.array(F.struct(g.alias("g"), (g + v).alias("o"))), acc)

    none = F.array().cast("array<struct<g:double,o:double>>")
    return F.transform(F.aggregate(F.reverse(F.sequence(F.lit(0), n - 1)), none, step), lambda x: x["o"])


def hysteresis(values: Column, least: float) -> Column:
    """Of an ordered array of forces struct(add, accum) at each step: what the force adds over the last level, and the sum of what
    rose by more than `least`.  The first force sets the level and adds 0; the level moves only on such a rise or on a fall, whose
    negative addition is told but not summed."""
    start = F.struct(F.get(values, F.lit(0)).alias("level"), F.lit(0.0).alias("accum"), F.array().cast("array<struct<add:double,accum:double>>").alias("out"))

    def step(a: Column, v: Column) -> Column:
        d = v - a["level"]
        up = d > least
        moved, accum = up | (d < 0), a["accum"] + F.when(up, d).otherwise(0.0)
        added = F.struct(F.when(moved, d).otherwise(0.0).alias("add"), accum.alias("accum"))
        return F.struct(F.when(moved, v).otherwise(a["level"]).alias("level"), accum.alias("accum"), F.concat(a["out"], F.array(added)).alias("out"))

    return F.aggregate(values, start, step)["out"]


def force_penalty(added: Column, rate: float, most: float) -> Column:
    """The reward's part for force: minus `rate` times what was added, between 0 and `most`."""
    return -F.greatest(F.lit(0.0), F.least(rate * added, F.lit(most)))


def best_cut(df: DataFrame, time: str, bin_size: float, least_share: float, key: Sequence[str] = ()) -> DataFrame:
    """Of the ends of bins the one with the most rows a second of all that come after `least_share` of the rows."""
    b = (F.ceil(F.col(time) / bin_size) * bin_size).alias("cut")
    bins = df.groupBy(*key, b).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*key).orderBy("cut")
    total = F.sum("n").over(Window.partitionBy(*key))
    bins = bins.select(*key, "cut", F.sum("n").over(so_far(w)).alias("done"), total.alias("total"))
    bins = bins.filter((F.col("done") >= least_share * F.col("total")) & (F.col("cut") > 0))
    return bins.groupBy(*key).agg(F.max_by(F.struct("cut", "done"), F.struct(F.col("done") / F.col("cut"), -F.col("cut"))).alias("b")).select(*key, "b.cut", "b.done")


def reduced(df: DataFrame, key: Sequence[str], **wanted: tuple[str, str]) -> DataFrame:
    """The workers' counters over all workers: name=(sum, min, max or avg, column)."""
    how = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}
    return df.groupBy(*key).agg(*[how[f](col).alias(name) for name, (f, col) in wanted.items()])


def added(df: DataFrame, key: Sequence[str], counts: Sequence[str], lists: Sequence[str]) -> DataFrame:
    """Counters added field by field, lists joined."""
    return df.groupBy(*key).agg(*[F.sum(n).alias(n) for n in counts], *[F.flatten(F.collect_list(n)).alias(n) for n in lists])


def tree_means(df: DataFrame, key: str, info: str) -> DataFrame:
    """key, n, mean of every leaf of the rows' JSON trees, nested names parted by '.'; a leaf counts where it is there."""
    from .trees import scalars

    leaves = scalars(df, key, info, banned=())
    return leaves.groupBy(F.col("name").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


def argmax(values: Column) -> Column:
    """The first place, from 0, of an array's largest value; null for an empty one."""
    return F.array_position(values, F.array_max(values)) - 1


def cumulative(values: Column) -> Column:
    """Running sums of an array of whole numbers."""
    last = lambda acc: F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0).cast("bigint"))
    return F.aggregate(values, F.array().cast("array<bigint>"), lambda acc, x: F.concat(acc, F.array(last(acc) + x)))


def unique_counts(values: Column) -> Column:
    """The sorted distinct values of an array with how often each comes: structs (value, n)."""
    return F.transform(F.array_sort(F.array_distinct(values)), lambda v: F.struct(v.alias("value"), F.size(F.filter(values, lambda x: x == v)).alias("n")))


def normalised(value: Column, mean: Column, var: Column, floor: float = 1e-2) -> Column:
    """(value - mean) over the root of the variance, which counts `floor` at least."""
    return (value - mean) / F.sqrt(F.greatest(var, F.lit(floor)))


def outdoor(samples: DataFrame, key: str, hit: str, share: float = 0.95) -> DataFrame:
    """outdoor: whether at most `share` of a key's samples have something above them; n samples."""
    return samples.groupBy(key).agg((F.avg(F.col(hit).cast("int")) <= share).alias("outdoor"), F.count(F.lit(1)).alias("n"))


def social(steps: DataFrame, episode: str, step: str, distance: str, never: int = 1500) -> DataFrame:
    """found, first_step (`never` if not), follow, backup, close, distance and spl of each episode.

    steps have flags found, follows and backs, and `best`: the fewest steps in which the other could be found.  follow is the
    share of following steps since the first find, backup and close those of all steps, distance the mean since the find, and spl
    best / max(best, first_step) of those that found."""
    s = steps.withColumn("_ever", F.max("found").over(so_far(over([episode], [step]))))
    n, since = F.count(F.lit(1)), F.greatest(F.count_if("_ever"), F.lit(1))
    out = s.groupBy(episode).agg(
        F.max("found").alias("found"),
        F.coalesce(F.min(F.when(F.col("found"), F.col(step))), F.lit(never)).alias("first_step"),
        (F.count_if(F.col("follows") & F.col("_ever")) / since).alias("follow"),
        (F.count_if("backs") / n).alias("backup"),
        (F.count_if("follows") / n).alias("close"),
        F.avg(F.when(F.col("_ever"), F.col(distance))).alias("distance"),
        F.first("best").alias("_best"),
    )
    return out.withColumn("spl", F.when(F.col("found"), F.col("_best") / F.greatest("_best", "first_step")).otherwise(0.0)).drop("_best")
