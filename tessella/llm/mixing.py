"""Mixing sources to target weights (free style; all built-in functions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .native import narrow, words
from .store import cut

WEIGHTS = (1, 2, 3)
#: At most so many passes over a source.
EPOCHS = 3
#: Rows of a source in one range of random keys; what one task sorts and sums.
RANGE_ROWS = 2_000
#: Hexadecimal digits by which a level of ranges is longer than the one above it.
STEP = 3
SEED = "mix"


def targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size -> the same with weight and target.

    Sources by code point, the null source last, weigh `weights` in turn and share the sum of all sizes in proportion.
    A target that would exceed `epochs` times its source's size stops there and the excess goes to the others by
    weight, until none is above.  Each step is one distributed sum; only three numbers come to the driver."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = per_source.withColumn("_at", F.row_number().over(order) - 1)  # a row for each source
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_at") % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", weight.alias("weight"))
    top = epochs * F.col("source_size")
    share, full, last = None, F.lit(False), -1
    while True:
        x = ranked.select(
            F.sum("source_size").alias("total"),
            F.sum(F.when(full, top).otherwise(0)).alias("capped"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weight"),
            F.sum(full.cast("int")).alias("n"),
        ).first()
        if x["n"] is None or not x["weight"] or x["n"] == last:
            break
        last, rest, by = x["n"], x["total"] - x["capped"], x["weight"]
        share = (F.col("weight") * F.lit(int(rest)).cast("long")).cast("double") / F.lit(float(by))
        full = full | (share > top)
    target = F.when(full, top.cast("double")).otherwise(share if share is not None else F.lit(0.0)) if share is not None else F.lit(0.0)
    return ranked.withColumn("target", target)


def key_of(doc_id: Column) -> Column:
    """A random key, the same at every run; as 32 hex digits its order is that of its bytes."""
    return F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit(""))))


def range_starts(sums: DataFrame, digits: int, step: int = STEP) -> DataFrame:
    """source, _range, _sum -> source, _range, _start: the sum of the source's ranges before this one.

    Level by level: a range's start is that of its parent, `step` digits shorter, plus the sums of its siblings before it, so no
    window has more than 16 ** step rows, however many ranges a source has."""
    parent = lambda d: F.substring("_range", 1, d)
    starts = None
    for top in range(0, digits, step):
        low = min(top + step, digits)
        level = sums.groupBy("source", parent(top).alias("_p"), parent(low).alias("_r")).agg(F.sum("_sum").alias("_sum"))
        before = Window.partitionBy("source", "_p").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
        level = level.select("source", "_p", F.col("_r").alias("_range"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
        if starts is not None:
            up = starts.select(F.col("source").alias("_s"), F.col("_range").alias("_q"), F.col("_start").alias("_more"))
            level = level.join(up, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_p") == F.col("_q"))).withColumn("_start", F.col("_start") + F.col("_more"))
        starts = level.select("source", "_range", "_start")
    return starts


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row.

    Rows of a source are ordered by a hash of doc_id (ties by doc_id and size, so rows that are alike may swap without
    effect).  Of its target a source takes whole epochs, and of the rest the words up to the exact budget in that order:
    the document on the edge gives a part of its words.  The order is cut into ranges of keys, each small enough for one
    task also in a hot source; the prefix sum of a row is that of its range plus that within it.  A null text has size 0
    and takes 0; a null source is a source of its own; sources of size 0 have target 0.  An empty table gives an empty one; other columns
    aren't read."""
    size = F.size(words(F.col("text"))).cast("long")
    sized = narrow(docs, "doc_id", "text", "source").select("doc_id", "source", size.alias("size"), key_of(F.col("doc_id")).alias("_key"))
    sized = cut(sized)  # narrow rows: the texts are read and split once
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    most = per.agg(F.max("_rows")).first()[0] or 1
    digits = max(1, min(8, (most // range_rows).bit_length() // 4 + (1 if most > range_rows else 0)))
    sized = sized.withColumn("_range", F.substring("_key", 1, digits))
    budget = targets(per.select("source", "source_size"), weights, epochs)
    whole = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).cast("long")
    budget = budget.withColumn("_whole", F.least(whole, F.lit(epochs)).cast("long")).withColumn("_rest", F.floor(F.col("target") - F.col("_whole") * F.col("source_size")).cast("long"))
    sums = sized.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    starts = range_starts(sums, digits)
    b = budget.select(F.col("source").alias("_s"), "source_size", "target", "_whole", "_rest")
    starts = starts.join(b, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").select(F.col("source").alias("_s"), F.col("_range").alias("_r"), "source_size", "target", "_whole", "_rest", "_start")
    within = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = sized.withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0)))
    out = out.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("_rest") - F.col("_start") - F.col("_in")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("_whole") * F.col("size") + part).cast("long").alias("taken"))
