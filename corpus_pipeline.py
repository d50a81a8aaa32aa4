"""From raw documents to a training mixture, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, so the
stages can be written as Parquet and read again in between, as run() does.  Every stage takes an empty table to an empty one,
keeps null and empty texts, and treats rows that repeat alike; further columns of documents, whatever their names, go with
their rows up to the mixture."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontam, forest, mixing, pii, toxicity
from tessella.llm.store import folder, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects; a text without words scores as the share of toxic labels."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (5-word shingles, 80 % of the union), that with the smallest id; all without words stay."""
    return forest.deduplicate(docs)


def benchmarks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item; ids are judged as one, also the missing one."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pseudonyms_in(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms of the same format, under the session's key."""
    return pii.pseudonymise(docs, pii.key_of(spark), counts=False)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mixture takes."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("near_dedup", near_copies_out),
    ("decontamination", benchmarks_out),
    ("pii", pseudonyms_in),
    ("mixing", mixture),
]
#: SQL can express neither the classifier nor the pseudonyms; tests compare each stage with brute force on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage is written to the shared folder, so a lost executor costs at most one stage."""
    docs, home = table(spark, sf_dir, "documents"), f"{folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
