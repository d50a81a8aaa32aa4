"""Writers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from ..operators.ranges import running


def json_files(df: DataFrame, path: str, mode: str = "overwrite", gzip: bool = False) -> None:
    """What the folder held before goes ('overwrite'), or the write fails ('error')."""
    df.write.mode(mode).option("compression", "gzip" if gzip else "none").json(path)


def quoted_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("quoteAll", True).option("header", True).csv(path)


def text_report(counts: DataFrame, path: str) -> None:
    """A line for each room with its counts, in order of the rooms over the files written, and one with all categories at the end."""
    rooms = counts.groupBy("room").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "category", F.col("n").cast("string")))), ", ").alias("t"))
    lines = rooms.select(F.col("room").alias("k"), F.concat_ws(": ", "room", "t").alias("value"))
    every = counts.agg(F.concat(F.lit("Categories: "), F.array_join(F.array_sort(F.collect_set("category")), ", ")).alias("value")).select(F.lit(None).cast("string").alias("k"), "value")
    lines.unionByName(every).sort(F.col("k").asc_nulls_last()).select("value").write.mode("overwrite").text(path)


def _fixed(value: Column, kind: DataType, digits: int) -> Column:
    if isinstance(kind, (DoubleType, FloatType)):
        return F.round(value, digits)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _fixed(x, kind.elementType, digits))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: _fixed(x, kind.valueType, digits))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[_fixed(value[f.name], f.dataType, digits).alias(f.name) for f in kind]))
    return value


def rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    """All doubles rounded, however deep they lie in arrays, maps and structs."""
    return df.select(*[_fixed(F.col(f"`{f.name}`"), f.dataType, digits).alias(f.name) for f in df.schema])


def _whole(rows: DataFrame, name: str, marks: tuple[str, str], path: str, mode: str, compression: str = "gzip") -> None:
    """Lines of JSON (a column value) as files of one object each, {"name": [line, line, ...]} or with other marks: a file for each
    task, written line by line.  Tasks without lines write an object with none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = f'{{"{name}": {marks[0]}'
        for batch in batches:
            out = []
            for value in batch.column("value").to_pylist():
                out.append(lead + value)
                lead = ","
            yield pa.record_batch([pa.array(out, pa.string())], names=["value"])
        yield pa.record_batch([[("" if lead == "," else lead) + marks[1] + "}"]], names=["value"])

    rows.select("value").mapInArrow(run, "value string").write.mode(mode).option("compression", compression).text(path)


def dictionary(df: DataFrame, column: str, ordinal: str) -> tuple[DataFrame, DataFrame]:
    """The rows with the column as numbers by first use, and the table of names."""
    first = df.groupBy(column).agg(F.min(ordinal).alias("_f"))
    names = running(first, [F.col("_f")], name="code").select(column, F.col("code").cast("int").alias("code"))
    return df.join(names, column).drop(column), names


def side_by_side(df: DataFrame, key: str, group: str, value: str, groups: tuple[str, str] = ("control", "test")) -> DataFrame:
    """One row for each key with both groups' values and their difference in percent."""
    out = df.groupBy(key).pivot(group, list(groups)).agg(F.first(value))
    return out.withColumn("percent", F.try_divide((F.col(groups[1]) - F.col(groups[0])) * 100, F.col(groups[0])))


def sessions(session: DataFrame, frames: DataFrame, path: str) -> None:
    """One folder of gzipped JSON for each episode: its session's fields and its frames in order."""
    rows = frames.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("seq", "data"))).alias("frames"))
    session.join(rows, "episode_id").write.mode("overwrite").partitionBy("episode_id").option("compression", "gzip").json(path)


def description(df: DataFrame, path: str, column: str = "description") -> None:
    """The text of each row, trimmed, on lines of its own."""
    df.select(F.btrim(F.col(column)).alias("value")).write.mode("overwrite").text(path)


def dataset(episodes: DataFrame, path: str, digits: int | None = None) -> None:
    """Episodes as gzipped JSON files {"episodes": [...]}, which scenes.episodes reads back; numbers rounded if `digits` is given.  The write
    fails where something is."""
    own = rounded(episodes, digits) if digits is not None else episodes
    _whole(own.select(F.to_json(F.struct("*")).alias("value")), "episodes", ("[", "]"), path, "error")


def goals_apart(episodes: DataFrame, path: str, key: str, goals: str) -> None:
    """Files {"episodes": [...]} without goals and files {"goals_by_category": {...}} with one list for each key, that of the first
    episode among equal keys; scenes.goal_episodes reads them back.  The write fails where something is."""
    dataset(episodes.drop(goals), path)
    first = episodes.groupBy(key).agg(F.min_by(goals, "episode_id").alias("_g"))
    lines = F.concat(F.regexp_extract(F.to_json(F.array(F.col(key).cast("string"))), r"^\[(.*)\]$", 1), F.lit(": "), F.to_json("_g"))
    _whole(first.select(lines.alias("value")), "goals_by_category", ("{", "}"), path, "append")


def replay(keyframes: DataFrame, path: str, incremental: bool = False, digits: int = 7) -> None:
    """{"keyframes": [...]} with the keyframes in order of seq, or for each a line {"keyframe": {...}}."""
    own = rounded(keyframes, digits)
    fields = [n for n in own.columns if n != "seq"]
    if incremental:
        own.sort("seq").select(F.struct(*fields).alias("keyframe")).write.mode("overwrite").json(path)
        return
    # one file, written line by line in the order of the sorted ranges; no task holds all keyframes
    _whole(own.sort("seq").select(F.to_json(F.struct(*fields)).alias("value")).coalesce(1), "keyframes", ("[", "]"), path, "overwrite", "none")


def scalars(metrics: DataFrame, path: str, step: str, prefix: str = "") -> None:
    """(step, key, value) rows of all numeric columns, appended; null values are left out."""
    names = [n for n, k in metrics.dtypes if n != step and k in ("int", "bigint", "float", "double")]
    pairs = F.array(*[F.struct(F.lit(prefix + n).alias("key"), F.col(n).cast("double").alias("value")) for n in names])
    metrics.select(F.col(step).alias("step"), F.explode(pairs).alias("p")).select("step", "p.*").filter("value IS NOT NULL").write.mode("append").parquet(path)


def metric_log(metrics: DataFrame, path: str) -> None:
    """A JSON object for each row, appended."""
    metrics.write.mode("append").json(path)


# The kinds of receptacles in a filter file.
FILTERS = ("active", "manually_filtered", "access_filtered", "stability_filtered", "height_filtered")


def receptacle_filters(names: DataFrame, path: str) -> None:
    """(kind, name) as one JSON object with a sorted list for each kind of FILTERS; ValueError for another kind."""
    if names.filter(~F.col("kind").isin(*FILTERS)).limit(1).count():
        raise ValueError("there is an unknown kind of filter")
    one = names.agg(*[F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("name")))).alias(k) for k in FILTERS])
    one.write.mode("overwrite").json(path)


def info_lines(df: DataFrame, kind: str, header: str) -> DataFrame:
    """Lines (line, nth) of objects (handle, deletable, locked, info) of each kind: a header, then a line for each in order of handles."""
    word = lambda b: F.when(F.col(b), "True").otherwise("False")
    rows = df.withColumn("nth", F.row_number().over(Window.partitionBy(kind).orderBy("handle")))
    rows = rows.select(F.concat_ws(",", "handle", word("deletable"), word("locked"), "info").alias("line"), F.col("nth").cast("long").alias("nth"), kind)
    heads = df.select(kind).distinct().select(F.concat(F.col(kind), F.lit(f" Full name,Can delete?,Is locked?,{header}")).alias("line"), F.lit(0).cast("long").alias("nth"), kind)
    return heads.unionByName(rows)


def next_handles(df: DataFrame, name: str, handle: str) -> DataFrame:
    """name, handle: the next free one, name_:0000 with one more than the largest number after the last colon of its handles."""
    digits = F.regexp_extract(handle, ":([0-9]+)$", 1).try_cast("int")
    return df.groupBy(name).agg((F.coalesce(F.max(digits), F.lit(-1)) + 1).alias("_n")).select(name, F.format_string("%s_:%04d", name, "_n").alias(handle))
