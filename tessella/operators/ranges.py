"""Sums and ranks over the order of a whole table, without a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def running(df: DataFrame, order: Sequence[Column], value: Column | None = None, name: str = "before") -> DataFrame:
    """Adds the sum of `value` (the number of rows without it) over the rows that come before in `order`, ascending.

    The table is dealt into ranges of the order, as many as there are shuffle partitions; a row's sum is that of the ranges before
    its own, one row for each, plus that within its range.  Rows that tie in `order` come in any order."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = F.lit(1) if value is None else value
    keys = {f"_o{i}": c for i, c in enumerate(order)}
    dealt = df.withColumns({**keys, "_v": value})
    dealt = cut(dealt.repartitionByRange(tasks, *keys).withColumn("_part", F.spark_partition_id()))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_part").agg(F.sum("_v").alias("_sum"))  # a row for each range
    parts = parts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(before(Window.orderBy("_part"))), F.lit(0)).alias("_base"))
    within = F.coalesce(F.sum("_v").over(before(Window.partitionBy("_part").orderBy(*keys))), F.lit(0))
    out = dealt.withColumn("_in", within).join(F.broadcast(parts), F.col("_part") == F.col("_p"))
    return out.withColumn(name, F.col("_base") + F.col("_in")).drop(*keys, "_v", "_part", "_p", "_base", "_in")
