"""Cutting lineage in the shared folder that the cluster names."""

from __future__ import annotations

import gc
import tempfile

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Bytes of rows that go to Python at a time, where the session doesn't say otherwise.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def folder(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; only a local session without that setting gets one of its own."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if not named:
        have = context._jsc.sc().getCheckpointDir()
        if have.isDefined():
            return have.get()
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        named = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(named)
    return named


def uri(spark: SparkSession) -> str:
    """folder() as an address that says in which store it is."""
    where = folder(spark)
    return where if "://" in where else "file://" + where.removeprefix("file:")


def afresh(df: DataFrame) -> DataFrame:
    """The rows of a checkpoint as a table of unknown size.

    A checkpoint passes on the size that the optimiser guessed for its plan, and guesses for joins are products: after some
    rounds of an iteration they are numbers of millions of digits, which fill the driver's memory and take it minutes."""
    spark, rows = df.sparkSession, df._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows.queryExecution().toRdd(), rows.schema(), False), spark)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; later stages survive lost executors without recomputing it."""
    spark = df.sparkSession
    where = folder(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return afresh(df.checkpoint())


def tidy(spark: SparkSession) -> None:
    """Lets go of what earlier steps left behind.

    Spark drops shuffle files, broadcasts and checkpoints only after the driver's JVM has collected the objects that stand for
    them, which a job of many steps may never make it do."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """df.mapInArrow over batches of bounded bytes.

    By number alone a batch is 10,000 whole texts.  The JVM holds it outside its heap, twice while it grows, and the worker once more, for each
    core.  Spark reads the setting as the job runs, so it stays with the session."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
