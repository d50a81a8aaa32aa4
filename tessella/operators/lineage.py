"""Cutting lineage in the shared folder of the session."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def afresh(df: DataFrame) -> DataFrame:
    """The rows of a checkpoint as a table of unknown size.

    A checkpoint passes on the size that the optimiser guessed for its plan, and guesses for joins are products: after some
    rounds of an iteration they are numbers of millions of digits, which fill the driver's memory and take it minutes."""
    spark, rows = df.sparkSession, df._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows.queryExecution().toRdd(), rows.schema(), False), spark)


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder of the session (its own folder only in a local session without the setting)."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return afresh(df.checkpoint())
