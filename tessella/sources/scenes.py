"""Scans of scene, frame, episode and log files.  Every reader takes paths that Spark can open."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ranges import running

NUMBER = r"\s+"


def frames(spark: SparkSession, path: str, schema: str | StructType, most: int = 0) -> DataFrame:
    """One JSON document in each file, in the order of their paths; the first `most` files, all for 0; bad JSON fails."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "*.json").json(path)
    df = df.withColumn("path", F.col("_metadata.file_path"))
    return df.orderBy("path").limit(most) if most else df


def semantic_csv(spark: SparkSession, path: str) -> DataFrame:
    """id, color, label, region: lines of exactly four fields; a label with a comma drops its line."""
    parts = F.split("value", ",")
    bare = lambda i: F.trim(F.replace(parts[i], F.lit('"'), F.lit("")))
    return spark.read.text(path).filter(F.size(parts) == 4).select(bare(0).try_cast("int").alias("id"), bare(1).alias("color"), bare(2).alias("label"), bare(3).try_cast("int").alias("region")).filter("id IS NOT NULL")


def annotations(spark: SparkSession, path: str, header: str) -> DataFrame:
    """id, color, label, region of lines with quoted labels (commas allowed) under a header; plus the row of the unknown object.

    ValueError if no line begins with the header."""
    lines = spark.read.text(path)
    if not lines.filter(F.col("value").startswith(header)).limit(1).count():
        raise ValueError(f"{path} has no header {header!r}")
    row = F.from_csv("value", "id INT, color STRING, label STRING, region INT")
    found = lines.filter(F.col("value").rlike(r"^[0-9]+,")).select(row.alias("r")).select("r.*").withColumn("color", F.conv("color", 16, 10).cast("int"))
    unknown = spark.range(1).select(F.lit(0).alias("id"), F.lit(0).alias("color"), F.lit("Unknown").alias("label"), F.lit(-1).alias("region"))
    return unknown.unionByName(found)


def house(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a text file whose lines name their record type by the first character: levels, regions, categories, objects."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), NUMBER).alias("f"))
    i, d = (lambda n: F.get("f", F.lit(n)).try_cast("int")), (lambda n: F.get("f", F.lit(n)).try_cast("double"))
    point = lambda n: F.array(d(n), d(n + 1), d(n + 2))
    of = lambda k: lines.filter(F.get("f", F.lit(0)) == k)
    spaced = lambda n: F.replace(F.get("f", F.lit(n)), F.lit("#"), F.lit(" "))
    return {
        "levels": of("L").select(i(1).alias("level"), i(2).alias("n_regions"), F.get("f", F.lit(3)).alias("label"), point(4).alias("position")),
        "regions": of("R").select(i(1).alias("region"), i(2).alias("level"), F.get("f", F.lit(5)).alias("label"), point(6).alias("position")),
        "categories": of("C").select(i(1).alias("category"), i(2).alias("mapping"), spaced(3).alias("label"), i(4).alias("coarse"), spaced(5).alias("coarse_label")),
        "objects": of("O").select(i(1).alias("object"), i(2).alias("region"), i(3).alias("category"), point(4).alias("center")),
    }


def class_objects(spark: SparkSession, path: str) -> DataFrame:
    """JSON with objects[] (id, class_): id, label and the category's number by first appearance, from 1."""
    raw = spark.read.option("multiLine", True).json(path).select(F.posexplode("objects").alias("ord", "o")).select("ord", F.col("o.id").alias("id"), F.col("o.class_").alias("label"))
    first = raw.groupBy("label").agg(F.min("ord").alias("first"))
    number = running(first, [F.col("first")], name="category").select("label", (F.col("category") + 1).cast("int").alias("category"))
    return raw.join(number, "label").select("id", "label", "category")


def classes_with_boxes(spark: SparkSession, path: str) -> DataFrame:
    """JSON with classes[] and perhaps objects[]: objects with their class name and oriented box (null where there is none)."""
    raw = spark.read.option("multiLine", True).json(path)
    classes = raw.select(F.explode("classes").alias("c")).select(F.col("c.id").alias("class_id"), F.col("c.name").alias("label"))
    box = "struct<center:array<double>,sizes:array<double>,rotation:array<double>>"
    if "objects" not in raw.columns:
        return classes.select(F.lit(None).cast("long").alias("id"), "class_id", "label", F.lit(None).cast(box).alias("box")).limit(0)
    rows = raw.select(F.explode("objects").alias("o"))
    own = F.lit(None).cast(box)
    if "oriented_bbox" in rows.schema["o"].dataType.names:  # centre and sizes in its frame, and where that stands
        own = F.struct(F.col("o.oriented_bbox.abb.center").cast("array<double>").alias("center"), F.col("o.oriented_bbox.abb.sizes").cast("array<double>").alias("sizes"), F.col("o.oriented_bbox.orientation.rotation").cast("array<double>").alias("rotation"))
    objects = rows.select(F.col("o.id").alias("id"), F.col("o.class_id").alias("class_id"), own.alias("box"))
    return objects.join(classes, "class_id", "left").select("id", "class_id", "label", "box")


def kind_of(spark: SparkSession, path: str) -> str:
    """house, annotations, classes, objects or unknown, from the head of the file."""
    head = "\n".join(r.value for r in spark.read.text(path).limit(5).collect())
    if head.startswith("ASCII 1.1"):
        return "house"
    if "Semantic Annotations" in head.split("\n")[0]:
        return "annotations"
    text = spark.read.text(path, wholetext=True)
    for name, key in (("classes", "$.classes"), ("objects", "$.objects")):
        if text.filter(F.get_json_object("value", key).isNotNull()).limit(1).count():
            return name
    return "unknown"


def regions(spark: SparkSession, path: str) -> DataFrame:
    """region_annotations of a JSON file with the polygon in the ground plane (x, z) and its area."""
    from ..functions.geometry import polygon_area

    raw = spark.read.option("multiLine", True).json(path).select(F.explode("region_annotations").alias("r")).select("r.*")
    loop = F.transform("poly_loop", lambda p: F.array(F.get(p, F.lit(0)).cast("double"), F.get(p, F.lit(2)).cast("double")))
    edge = lambda c, i: F.get(c, F.lit(i)).cast("double")
    out = raw.withColumn("loop", loop)
    return out.select("name", "label", "loop", polygon_area(F.col("loop")).alias("area"), *[edge("min_bounds" if k == "0" else "max_bounds", i).alias(f"{c}{k}") for i, c in enumerate("xyz") for k in "01"])


def episodes(spark: SparkSession, path: str, schema: str, scenes: list[str] | None = None) -> DataFrame:
    """episodes[] of (gzipped) JSON files; with `scenes` only their files under content/ are opened."""
    paths = [f"{path}/content/{s}.json.gz" for s in scenes] if scenes else [path]
    return spark.read.option("multiLine", True).schema(f"episodes ARRAY<STRUCT<{schema}>>").json(paths).select(F.explode("episodes").alias("e")).select("e.*")


def keyframes(spark: SparkSession, path: str, keyframe: str) -> DataFrame:
    """seq and fields of a replay file's keyframes; a missing file or one that isn't JSON has none."""
    try:
        raw = spark.read.option("multiLine", True).schema(f"keyframes ARRAY<STRUCT<{keyframe}>>").json(path)
        return raw.select(F.posexplode("keyframes").alias("seq", "k")).select("seq", "k.*")
    except Exception as error:  # Spark names the condition
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], f"seq INT, {keyframe}")


def fps_logs(spark: SparkSession, path: str) -> DataFrame:
    """The first value after 'FPS: ' of each file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line"), F.regexp_extract("value", r"FPS.*?:\s*([0-9.]+)", 1).alias("v"))
    return lines.filter("v != ''").groupBy("path").agg(F.min_by(F.col("v").cast("double"), "line").alias("fps"))


def messages(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """JSON messages; those that can't be read are dropped."""
    return lines.select(F.from_json(column, f"{schema}, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("m")).select("m.*").filter("_corrupt IS NULL").drop("_corrupt")


def filter_names(spark: SparkSession, path: str, kinds: list[str]) -> DataFrame:
    """Distinct names under the wanted keys of a JSON object of lists."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "MAP<STRING, ARRAY<STRING>>").alias("m"))
    return raw.select(F.explode("m").alias("kind", "names")).filter(F.col("kind").isin(*kinds)).select(F.explode("names").alias("name")).distinct()


def newest(spark: SparkSession, path: str, n: int = 0) -> DataFrame:
    """The n-th file by time of change, 'latest' files left out, with the last number among its name's dotted parts."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime").filter(~F.col("path").contains("latest"))
    number = F.element_at(F.filter(F.split(F.element_at(F.split("path", "/"), -1), r"\."), lambda p: p.rlike("^[0-9]+$")), -1)
    return files.orderBy("modificationTime", "path").offset(n).limit(1).withColumn("number", number.cast("int"))


def replay_keyframes(spark: SparkSession, text: str, keyframe: str) -> DataFrame:
    """Fields of the one keyframe in a JSON string, wrapped as {"keyframe": ...} or not; none for what isn't JSON."""
    one = spark.range(1).select(F.lit(text).alias("value"))
    wrapped = F.from_json("value", f"keyframe STRUCT<{keyframe}>")["keyframe"]
    return one.filter(F.try_parse_json("value").isNotNull()).select(F.coalesce(wrapped, F.from_json("value", keyframe)).alias("k")).select("k.*")


def goal_episodes(spark: SparkSession, path: str, episode: str, goal: str, key: str) -> DataFrame:
    """Episodes of (gzipped) JSON whose goals are kept apart: {"episodes": [...], "goals_by_category": {key: [...]}}; each episode
    has the goals of its key (an expression over its fields).  KeyError if a key has none."""
    raw = spark.read.option("multiLine", True).schema(f"episodes ARRAY<STRUCT<{episode}>>, goals_by_category MAP<STRING, ARRAY<STRUCT<{goal}>>>").json(path)
    goals = raw.select(F.explode("goals_by_category").alias("_key", "goals")).groupBy("_key").agg(F.first("goals").alias("goals"))
    out = raw.select(F.explode("episodes").alias("e")).select("e.*").withColumn("_k", F.expr(key)).join(goals, F.col("_k") == F.col("_key"), "left")
    if lost := out.filter("goals IS NULL").select("_k").limit(1).collect():
        raise KeyError(f"no goals for {lost[0][0]}")
    return out.drop("_k", "_key")


def instructions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Episodes with their instruction (text and numbers of its words) and the vocabulary (word, id) of {"episodes", "instruction_vocab"}."""
    episode = "episode_id STRING, scene_id STRING, start_position ARRAY<DOUBLE>, goals ARRAY<STRUCT<position: ARRAY<DOUBLE>, radius: DOUBLE>>, instruction STRUCT<instruction_text: STRING, instruction_tokens: ARRAY<INT>>"
    raw = spark.read.option("multiLine", True).schema(f"episodes ARRAY<STRUCT<{episode}>>, instruction_vocab STRUCT<word_list: ARRAY<STRING>>").json(path)
    rows = raw.select(F.explode("episodes").alias("e")).select("e.episode_id", "e.scene_id", "e.start_position", "e.goals", "e.instruction.instruction_text", "e.instruction.instruction_tokens")
    return rows, raw.select(F.posexplode("instruction_vocab.word_list").alias("id", "word")).select("word", "id")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Episodes with their question: text, numbers of its words, answer and its number."""
    episode = "episode_id STRING, scene_id STRING, question STRUCT<question_text: STRING, question_tokens: ARRAY<INT>, answer_text: STRING, answer_token: INT>"
    return spark.read.option("multiLine", True).schema(f"episodes ARRAY<STRUCT<{episode}>>").json(path).select(F.explode("episodes").alias("e")).select("e.episode_id", "e.scene_id", "e.question.*")


def scene_models(spark: SparkSession, path: str) -> DataFrame:
    """The distinct templates that scene instances (JSON files) name, by kind: stage, object or articulated."""
    part = "STRUCT<template_name: STRING>"
    raw = spark.read.option("multiLine", True).schema(f"stage_instance {part}, object_instances ARRAY<{part}>, articulated_object_instances ARRAY<{part}>").json(path)
    named = lambda kind, rows: F.transform(rows, lambda x: F.struct(F.lit(kind).alias("kind"), x["template_name"].alias("model")))
    none = F.array().cast("array<struct<kind:string,model:string>>")
    every = F.concat(named("stage", F.array("stage_instance")), F.coalesce(named("object", F.col("object_instances")), none), F.coalesce(named("articulated", F.col("articulated_object_instances")), none))
    return raw.select(F.explode(every).alias("m")).select("m.*").filter("model IS NOT NULL").distinct()


def load(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """kind_of(path) and the objects that a reader of that kind finds; ValueError for an unknown kind."""
    kind = kind_of(spark, path)
    if kind == "house":
        return kind, house(spark, path)["objects"]
    if kind == "annotations":
        return kind, annotations(spark, path, spark.read.text(path).first()[0])
    if kind == "classes":
        return kind, classes_with_boxes(spark, path)
    if kind == "objects":
        return kind, class_objects(spark, path)
    raise ValueError(f"{path} is of no known kind")
