"""Profiler exports in SQLite files, and configuration templates."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "path string, id long, start long, end long, name string, thread long"


def sqlite_events(spark: SparkSession, path: str, table: str = "NVTX_EVENTS") -> DataFrame:
    """path, id, start, end, name, thread of the closed events in SQLite files (path: a file, folder or pattern); a file without the
    table has none.

    Files are read whole by Spark and opened in memory, so any store will do; one file is one row of one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in EVENTS.split(", ")]
        for pdf in frames:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                con = sqlite3.connect(":memory:")
                con.deserialize(bytes(content))
                there = con.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", (table,)).fetchone()
                if there:
                    found = con.execute(f'SELECT rowid, start, "end", text, globalTid FROM "{table}" WHERE "end" IS NOT NULL')
                    while rows := found.fetchmany(50_000):
                        yield pd.DataFrame([(file, *r) for r in rows], columns=names)
                con.close()

    if not table.isidentifier():
        raise ValueError(f"{table!r} is no table's name")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sqlite").load(path)
    return files.select("path", "content").mapInPandas(run, EVENTS)


def sqlite_files(spark: SparkSession, path: str) -> DataFrame:
    """The paths of a folder's SQLite files, sorted."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.sqlite").load(path).select("path").sort("path")


def template(spark: SparkSession, source: str) -> dict:
    """A configuration: the object in a JSON string, or in the file at a path that Spark reads.  ValueError for what is no object."""
    text = source if source.lstrip().startswith("{") else "\n".join(r.value for r in spark.read.text(source, wholetext=True).limit(1).collect())
    try:
        out = json.loads(text)
    except json.JSONDecodeError as error:
        raise ValueError(f"no JSON in {source[:60]!r}") from error
    if not isinstance(out, dict):
        raise ValueError(f"no object in {source[:60]!r}")
    return out


def templates(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """handle, template (JSON text) of all files below a folder whose name ends in the suffix; the handle is the path."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("handle"), F.col("value").alias("template")).filter(F.try_parse_json("template").isNotNull())
