"""Configuration trees as (path, value) tables; a path's parts are parted by '/'."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overwritten(target: DataFrame, source: DataFrame) -> DataFrame:
    """Deep merge in which the source wins."""
    s = source.select("path", F.col("value").alias("_v"), F.lit(True).alias("_s"))
    return target.join(s, "path", "full_outer").select("path", F.when(F.col("_s"), F.col("_v")).otherwise(F.col("value")).alias("value"))


def filtered(target: DataFrame, source: DataFrame) -> DataFrame:
    """Entries of the target that the source doesn't have with the same value; groups left empty vanish by themselves."""
    s = source.select(F.col("path").alias("_p"), F.col("value").alias("_v"))
    return target.join(s, (F.col("path") == F.col("_p")) & F.col("value").eqNullSafe(F.col("_v")), "left_anti")


def differences(a: DataFrame, b: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Paths in which the trees differ; numbers may by `tolerance`.  No row: equal."""
    j = a.join(b.select("path", F.col("value").alias("other"), F.lit(1).alias("_b")), "path", "full_outer").withColumn("_a", F.col("value").isNotNull())
    near = F.abs(F.col("value").try_cast("double") - F.col("other").try_cast("double")) <= tolerance
    same = F.col("value").eqNullSafe(F.col("other")) | F.coalesce(near, F.lit(False))
    return j.filter(~same).select("path", "value", "other")


def breadcrumbs(tree: DataFrame, key: str) -> DataFrame:
    """The first path in order that holds the key, up to it."""
    parts = F.split("path", "/")
    at = F.array_position(parts, key)
    return tree.filter(at > 0).select(F.array_join(F.slice(parts, F.lit(1), at.cast("int")), "/").alias("path")).agg(F.min("path").alias("path"))


def rekeyed(tree: DataFrame, group: list[str], key: str) -> DataFrame:
    """new_key: 000, 001, ... in the order of the keys of each group."""
    return tree.withColumn("new_key", F.lpad((F.row_number().over(Window.partitionBy(*group).orderBy(key)) - 1).cast("string"), 3, "0"))


def type_counts(tree: DataFrame) -> DataFrame:
    """How many values of each inferred type the tree has."""
    v = F.col("value")
    kind = F.when(v.isin("true", "false"), "bool").when(v.rlike(r"^-?[0-9]+$"), "int").when(v.rlike(r"^-?[0-9]*\.[0-9]+([eE][-+]?[0-9]+)?$"), "double").otherwise("string")
    return tree.groupBy(kind.alias("type")).agg(F.count(F.lit(1)).alias("n"))


def marker_counts(markers: DataFrame) -> DataFrame:
    """markers (task, link, name, key, point) -> task, links, sets and points: how many of each a task has."""
    return markers.groupBy("task").agg(F.count_distinct("link").alias("links"), F.count_distinct("link", "name").alias("sets"), F.count(F.lit(1)).alias("points"))


def marker_points(markers: DataFrame) -> DataFrame:
    """All points of a tree of marker sets, keyed anew within each set in the order of their keys."""
    return rekeyed(markers, ["task", "link", "name"], "key")


def inferred(value: Column, key: Column) -> Column:
    """What a JSON value is taken for: null, bool, int, double, string; arrays of numbers by their length as vector2, vector3, vector4,
    quaternion (four numbers under a key that tells of a turn), matrix3, matrix4; else array, and group for an object."""
    v = F.try_parse_json(value)
    kind = F.schema_of_variant(v)
    n = F.size(F.from_json(value, "ARRAY<STRING>"))
    numbers = kind.rlike(r"^ARRAY<(BIGINT|DOUBLE|DECIMAL\(\d+,\s?\d+\))>$")
    turn = F.lower(key).rlike("quat|rotat|orient")
    array = F.when(~numbers, "array").when(n == 2, "vector2").when(n == 3, "vector3").when((n == 4) & turn, "quaternion").when(n == 4, "vector4").when(n == 9, "matrix3").when(n == 16, "matrix4").otherwise("array")
    return (
        F.when(v.isNull(), F.lit(None))
        .when(kind == "VOID", "null")
        .when(kind == "BOOLEAN", "bool")
        .when(kind == "BIGINT", "int")
        .when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), "double")
        .when(kind == "STRING", "string")
        .when(kind.startswith("OBJECT"), "group")
        .otherwise(array)
    )


def scalars(df: DataFrame, key: str, info: str, ignored: tuple[str, ...] = (), depth: int = 4, banned: tuple[str, ...] = ("top_down_map", "collisions.is_collision")) -> DataFrame:
    """key, name, value: the scalars of a JSON object, nested names parted by '.'; numbers, booleans as 0 and 1, and lists of one number.

    Strings aren't scalars; names in `ignored` or `banned` are left out with all below them.  Objects are opened `depth` deep."""
    spark, skip = df.sparkSession, [*ignored, *banned]
    rows = df.select(F.col(key).alias("_k"), F.lit("").alias("_name"), F.try_parse_json(F.col(info)).alias("_v"))
    out = None
    for _ in range(depth):
        rows = spark.sql("SELECT _k, CASE WHEN _name = '' THEN e.key ELSE _name || '.' || e.key END AS _name, e.value AS _v FROM {rows}, LATERAL variant_explode(_v) AS e WHERE e.key IS NOT NULL", rows=rows)
        rows = rows.filter(~F.col("_name").isin(skip))
        kind = F.schema_of_variant("_v")
        number = F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.try_variant_get("_v", "$", "double")).when(kind == "BOOLEAN", F.try_variant_get("_v", "$", "boolean").cast("double"))
        one = kind.rlike("^ARRAY<(BIGINT|DOUBLE|DECIMAL|FLOAT)") & F.try_variant_get("_v", "$[1]", "double").isNull()
        found = rows.withColumn("value", F.coalesce(number, F.when(one, F.try_variant_get("_v", "$[0]", "double")))).filter("value IS NOT NULL")
        found = found.select(F.col("_k").alias(key), F.col("_name").alias("name"), "value")
        out = found if out is None else out.unionByName(found)
        rows = rows.filter(kind.startswith("OBJECT"))
    return out
