"""Route frames: filters, labels, salience, clusters and relations of visible objects."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import at

# Labels that don't help a walker, and how relations read.
IGNORED = ("ceiling", "floor", "wall", "walls", "ceiling trim", "wall trim", "railing")
PHRASES = {
    "left_of": "to the left of",
    "right_of": "to the right of",
    "in_front_of": "in front of",
    "behind": "behind",
    "beneath_of": "below",
    "on_top_of": "on top of",
    "above": "above",
    "next_to": "next to",
}


def drop_labels(df: DataFrame, label: str = "label", ignored: Sequence[str] = IGNORED) -> DataFrame:
    """Labels are compared in lower case, not trimmed."""
    return df.filter(~F.lower(label).isin(*ignored))


def visible(df: DataFrame, least_pixels: int = 50, identity: str = "object_id", pixels: str = "pixel_count") -> DataFrame:
    return df.filter((F.col(identity) != 0) & (F.col(pixels) >= least_pixels))


def informative(df: DataFrame, labels: DataFrame, mode: str, on: str = "label") -> DataFrame:
    """mode 'whitelist' keeps the labels, any other drops them."""
    return df.join(labels.select(on).distinct(), on, "left_semi" if mode == "whitelist" else "left_anti")


def preference(distance: Column) -> Column:
    """How much a distance recommends an object: the nearer to 4 metres the better; an unknown distance counts 0.6."""
    off = F.abs(distance - 4)
    return F.when(distance.isNull(), 0.6).when(distance <= 0, 0.3).when(off <= 1, 1.0).when(off <= 2, 0.75).when(off <= 3, 0.5).otherwise(0.3)


def bucket(distance: Column) -> Column:
    near = F.when(distance < 1, "very close").when(distance < 3, "near").when(distance <= 5, "mid-range").when(distance <= 6, "slightly far").otherwise("far")
    return F.when(distance.isNull() | (distance <= 0), F.lit(None)).otherwise(near)


def direction(u: Column, v: Column, edge: float = 0.3) -> Column:
    """Where a point of the image (both axes from -1 to 1, v upwards) lies."""
    up = F.when(v > edge, "upper").when(v < -edge, "lower").otherwise("")
    side = F.when(u < -edge, "left").when(u > edge, "right").otherwise("")
    return F.coalesce(F.nullif(F.concat_ws("-", F.nullif(up, F.lit("")), F.nullif(side, F.lit(""))), F.lit("")), F.lit("center"))


def phrase(relation: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in PHRASES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, relation), F.replace(relation, F.lit("_"), F.lit(" ")))


def entry(label: Column, percent: Column, distance: Column, ignored: Sequence[str] = IGNORED) -> Column:
    """'label (12.00% area, 3.5m away, mid-range)' of what is known and positive, else the trimmed label; null for a label that is blank or ignored."""
    name = F.trim(label)
    details = F.concat_ws(", ", F.when(percent > 0, F.format_string("%.2f%% area", percent)), F.when(distance > 0, F.format_string("%.1fm away", distance)), bucket(distance))
    return F.when((name == "") | F.lower(name).isin(*ignored), F.lit(None)).when(details == "", name).otherwise(F.concat(name, F.lit(" ("), details, F.lit(")")))


def placed_entry(label: Column, u: Column, v: Column, ignored: Sequence[str] = IGNORED) -> Column:
    """'label (upper-left)'; null without a place, or for a label that is blank or ignored."""
    name = F.trim(label)
    return F.when((name != "") & ~F.lower(name).isin(*ignored) & u.isNotNull() & v.isNotNull(), F.concat(name, F.lit(" ("), direction(u, v), F.lit(")")))


def canonical(df: DataFrame, synonyms: DataFrame, label: str = "label") -> DataFrame:
    """Trimmed lower-case labels, replaced by synonyms (word, canonical)."""
    key = F.lower(F.trim(F.col(label)))
    out = df.join(synonyms.select(F.col("word").alias("_w"), F.col("canonical").alias("_c")), key == F.col("_w"), "left")
    return out.withColumn(label, F.coalesce("_c", key)).drop("_w", "_c")


def top_salient(df: DataFrame, frame: str, order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The k best rows of each frame; Spark cuts each sorted run at k before it shuffles."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(frame).orderBy(*order))).filter(F.col(rank) <= k)


def salience_order(percent: Column, distance: Column, ordinal: Column, relevance: Column | None = None) -> list[Column]:
    """Best first; a distance that isn't positive counts as unknown, and an unknown one comes before all others on ties."""
    known = F.when(distance > 0, distance)
    pref, near, area = preference(known), F.coalesce(-known, F.lit(0.0)), F.coalesce(percent, F.lit(0.0))
    if relevance is None:
        return [(area * pref).desc(), pref.desc(), area.desc(), near.desc(), ordinal.asc()]
    return [(area * pref * relevance).desc(), relevance.desc(), area.desc(), near.desc(), ordinal.asc()]


def scored(df: DataFrame, scores: DataFrame, label: str = "label", default: float = 0.2) -> DataFrame:
    """Adds `relevance` from scores (label, score), a default where the label is unknown."""
    s = scores.select(F.col(label).alias("_l"), F.col("score").alias("_s"))
    return df.join(s, F.col(label) == F.col("_l"), "left").withColumn("relevance", F.coalesce("_s", F.lit(default))).drop("_l", "_s")


def pixel_histogram(df: DataFrame, frame: str, identity: str) -> DataFrame:
    """n and percent of the frame's pixels for each id."""
    counts = df.groupBy(frame, identity).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(frame)))


def relations(objects: DataFrame, frame: str, ordinal: str, centroid: str, most: float = 1.5, upright: bool = False, least_height: float = 0.25, bias: float = 1.2) -> DataFrame:
    """Pairs of a frame at most `most` apart.  A relation is vertical where the heights differ by more than `least_height` and by
    more than the sum of the other differences over `bias`; else it is that of x if x differs more than z, else that of z.

    Rows are cut into cells of edge `most`; only neighbouring cells meet, so a crowded frame isn't squared.  Cells go to partitions of a
    number of their own: what they become is not told by their bytes, so small partitions must not be merged.
    `upright` names b above a as `b on_top_of a`'s inverse; without it the name is that of the data's source, the other way round."""
    cell = lambda i: F.floor(at(F.col(centroid), i) / most)
    a = objects.select(F.col(frame).alias("_f"), F.col(ordinal).alias("i"), F.col(centroid).alias("p"), *[cell(i).alias(f"_c{i}") for i in range(3)])
    b = objects.select(F.col(frame).alias("_g"), F.col(ordinal).alias("j"), F.col(centroid).alias("q"), *[cell(i).alias(f"_d{i}") for i in range(3)])
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    for i in range(3):
        b = b.withColumn(f"_o{i}", F.explode(around)).withColumn(f"_d{i}", F.col(f"_d{i}") + F.col(f"_o{i}")).drop(f"_o{i}")
    tasks = int(objects.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = a.repartition(tasks, "_f", "_c0", "_c1", "_c2"), b.repartition(tasks, "_g", "_d0", "_d1", "_d2")  # whichever of them is broadcast
    pairs = a.join(b, (F.col("_f") == F.col("_g")) & (F.col("_c0") == F.col("_d0")) & (F.col("_c1") == F.col("_d1")) & (F.col("_c2") == F.col("_d2")) & (F.col("i") < F.col("j")))
    dx, dy, dz = (at(F.col("q"), i) - at(F.col("p"), i) for i in range(3))
    gap = F.sqrt(dx * dx + dy * dy + dz * dz)
    ax, ay, az = F.abs(dx), F.abs(dy), F.abs(dz)
    over, under = ("beneath_of", "on_top_of") if upright else ("on_top_of", "beneath_of")
    vertical = (ay > least_height) & (ay > (ax + az) / bias)
    name = F.when(vertical, F.when(dy > 0, over).otherwise(under)).when(ax > az, F.when(dx > 0, "left_of").otherwise("right_of")).otherwise(F.when(dz < 0, "in_front_of").otherwise("behind"))
    return pairs.filter(gap <= most).select(F.col("_f").alias(frame), "i", "j", name.alias("relation"), gap.alias("distance_m"))


def usable_relations(df: DataFrame, frame: str, ordinal: str, limit: int, ignored: Sequence[str] = IGNORED) -> DataFrame:
    """The first `limit` relations of a frame whose three fields aren't blank and whose ends aren't ignored."""
    full = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    out = df.filter(full("subject") & full("relation") & full("object") & ~F.lower("subject").isin(*ignored) & ~F.lower("object").isin(*ignored))
    return top_salient(out, frame, [F.col(ordinal).asc()], limit, "_n").drop("_n")


CLUSTERS = "frame long, label string, cluster int, n long, pixels long, percent double, x double, y double, z double, distance double, low array<double>, high array<double>, ids array<long>"


def cluster(df: DataFrame, radius: float) -> DataFrame:
    """Greedy clusters within (frame, label): objects by falling pixel count join the first cluster whose running pixel-weighted
    centroid lies within `radius` on the ground (x, z).  (frame, label, object_id, pixel_count, percent, x, y, z, distance, low, high)
    -> a row for each cluster with summed pixels and percent, least distance, the box around all boxes, and its ids in order.

    The order decides what joins what, so a group is one fold; it is what a camera sees of one label."""
    names = [c.split()[0] for c in CLUSTERS.split(", ")]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pixel_count", "object_id"], ascending=[False, True])
        place, box = pdf[["x", "y", "z"]].to_numpy(float), [np.array(pdf[c].to_list(), float) for c in ("low", "high")]
        found: list[dict] = []
        centres = np.empty((len(pdf), 3))
        for i, r in enumerate(pdf.itertuples()):
            near = np.flatnonzero(np.hypot(*(centres[: len(found), ::2] - place[i, ::2]).T) <= radius)
            if not len(near):
                centres[len(found)] = place[i]
                found.append({"frame": r.frame, "label": r.label, "cluster": len(found), "n": 1, "pixels": r.pixel_count, "percent": r.percent, "distance": r.distance, "low": box[0][i], "high": box[1][i], "ids": [r.object_id]})
                continue
            home = found[near[0]]
            total = home["pixels"] + r.pixel_count
            centres[near[0]] = (centres[near[0]] * home["pixels"] + place[i] * r.pixel_count) / total
            home["low"], home["high"] = np.minimum(home["low"], box[0][i]), np.maximum(home["high"], box[1][i])
            home |= {"pixels": total, "n": home["n"] + 1, "percent": home["percent"] + r.percent, "distance": min(home["distance"], r.distance)}
            home["ids"].append(r.object_id)
        for f, c in zip(found, centres, strict=False):
            f["x"], f["y"], f["z"] = c
        return pd.DataFrame(found, columns=names)

    return df.groupBy("frame", "label").applyInPandas(fold, CLUSTERS)


def top_clusters(df: DataFrame, k: int | None = None) -> DataFrame:
    """The k largest clusters of each label of a frame (all in order of creation for None), with uid label_01, label_02, ... in that
    order and `rank`, their place in the frame by pixels."""
    order = [F.col("cluster")]
    if k is not None:
        # only a label with more than k clusters is put in order of size
        per = Window.partitionBy("frame", "label")
        df = df.withColumn("_many", F.count(F.lit(1)).over(per) > k)
        order = [F.when(F.col("_many"), -F.col("pixels")).otherwise(F.col("cluster")), F.col("cluster")]
    df = df.withColumn("_at", F.row_number().over(Window.partitionBy("frame", "label").orderBy(*order)))
    df = df if k is None else df.filter(F.col("_at") <= k).drop("_many")
    df = df.withColumn("uid", F.format_string("%s_%02d", "label", "_at"))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("frame").orderBy(F.col("pixels").desc(), "uid"))).drop("_at")


def prompt_lines(objects: DataFrame, frame: str, ordinal: str, line: str) -> DataFrame:
    """One line for each frame: its entries in order."""
    return objects.groupBy(frame).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(line).alias("l")))), lambda x: x["l"]), ", ").alias("objects")).withColumn("line", F.concat(F.col(frame).cast("string"), F.lit(": Key objects: "), F.col("objects")))


