"""Files that the readers read back, and rounding at any depth."""

import pytest
from pyspark.sql import functions as F

from tessella.sources import scenes, sinks

EPISODE = "episode_id int, goals_key string, place struct<x:double,tags:map<string,double>>"


def table(spark, n=7):
    rows = [(i, f'k"{i % 3}\\é', (i + 0.123456789, {"a": i / 7}), [(i * 1.0, "g")] * (i % 2 + 1)) for i in range(n)]
    return spark.createDataFrame(rows, EPISODE + ", goals array<struct<at:double,name:string>>").repartition(3, "episode_id")


def test_dataset(spark, tmp_path):
    own = table(spark).drop("goals")
    sinks.dataset(own, f"{tmp_path}/d")
    assert sorted(scenes.episodes(spark, f"{tmp_path}/d", EPISODE).collect()) == sorted(own.collect())
    with pytest.raises(Exception, match="exists"):
        sinks.dataset(own, f"{tmp_path}/d")
    sinks.dataset(own.limit(0), f"{tmp_path}/none")
    assert scenes.episodes(spark, f"{tmp_path}/none", EPISODE).count() == 0
    sinks.dataset(own, f"{tmp_path}/r", digits=2)
    got = {r.episode_id: r.place for r in scenes.episodes(spark, f"{tmp_path}/r", EPISODE).collect()}
    assert got[1].x == 1.12 and got[1].tags == {"a": 0.14}


def test_goals_apart(spark, tmp_path):
    """Every episode gets the goals of the first one with its key."""
    own = table(spark)
    sinks.goals_apart(own, f"{tmp_path}/g", "goals_key", "goals")
    got = scenes.goal_episodes(spark, f"{tmp_path}/g", EPISODE, "at double, name string", "goals_key").collect()
    first = {}
    for r in sorted(own.collect()):
        first.setdefault(r.goals_key, r.goals)
    assert len(got) == 7 and all(r.goals == first[r.goals_key] for r in got)


def test_rounded(spark):
    df = spark.range(1).select(F.lit(1.23456789).alias("a b"), F.struct(F.lit(0.123456789).alias("x"), F.array(F.struct(F.lit(2.000004).alias("y"))).alias("l")).alias("s"), F.create_map(F.lit("k"), F.array(F.lit(0.9999999))).alias("m"), F.lit(None).cast("struct<z:double>").alias("n"))
    got = sinks.rounded(df).first()
    assert got["a b"] == 1.23457 and got.s.x == 0.12346 and got.s.l[0].y == 2.0 and got.m == {"k": [1.0]} and got.n is None
