"""The room catalogue: counts of categories, look-ups and the rule that routes a request."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import reply_goal


def counts(objects: DataFrame, rooms: DataFrame, room: str, category: str, ignored: list[str]) -> DataFrame:
    """room, category, n; a room whose categories are all ignored stays with a null category and 0."""
    n = objects.filter(~F.col(category).isin(*ignored)).groupBy(room, category).agg(F.count(F.lit(1)).alias("n"))
    return rooms.select(room).distinct().join(n, room, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def with_name(df: DataFrame, names: DataFrame, key: str, name: str, default: str) -> DataFrame:
    """Adds `name` by key, a default where it is unknown."""
    d = names.select(F.col(key).alias("_k"), F.col(name).alias("_n"))
    return df.join(d, F.col(key) == F.col("_k"), "left").withColumn(name, F.coalesce("_n", F.lit(default))).drop("_k", "_n")


def first_match(requests: DataFrame, objects: DataFrame, request: str, on: list[str], order: list[str]) -> DataFrame:
    """Of the objects that fit a request the first in scan order."""
    joined = requests.join(objects, on)
    w = Window.partitionBy(request).orderBy(*order)
    return joined.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def exists(requests: DataFrame, objects: DataFrame, on: list[str]) -> DataFrame:
    found = objects.select(*on).distinct().withColumn("_hit", F.lit(True))
    return requests.join(found, on, "left").withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")


def route(requests: DataFrame, catalogue: DataFrame, rooms: DataFrame) -> DataFrame:
    """rule for each request (room, object; either may be null) by the catalogue's counts (room, category, n) and the rooms' kinds
    (room, kind: bedroom_1 is a bedroom).

    1 one such object in the room named, 2 a room that there is, 3 the object is in several rooms, 4 a kind of room of which
    there are several, 5 the object is in one room only (target_room), 6 the object comes several times in the room named, 7 no
    match, 8 neither asked for.  A kind of which there is one room names that room.  candidates lists the rooms to choose from
    for 3 and 4, target_room is where to go for 1, 2, 5 and 6."""
    kinds = rooms.select("room", "kind").distinct().groupBy(F.col("kind").alias("_kind")).agg(F.sort_array(F.collect_set("room")).alias("_of"))
    own = rooms.select(F.col("room").alias("_room")).distinct()
    held = catalogue.filter("n > 0")
    places = held.groupBy(F.col("category").alias("_cat")).agg(F.sort_array(F.collect_set("room")).alias("_in"))
    out = requests.join(own, F.col("room") == F.col("_room"), "left").join(kinds, F.col("room") == F.col("_kind"), "left").join(places, F.col("object") == F.col("_cat"), "left")
    # a room named by its kind is known if there is one of that kind
    out = out.withColumn("_at", F.coalesce("_room", F.when(F.size("_of") == 1, F.get("_of", F.lit(0)))))
    both = held.groupBy(F.col("room").alias("_br"), F.col("category").alias("_bc")).agg(F.sum("n").alias("_n"))
    out = out.join(both, (F.col("_at") == F.col("_br")) & (F.col("object") == F.col("_bc")), "left")
    several = F.size("_of") > 1
    rule = (
        F.when(F.col("room").isNull() & F.col("object").isNull(), 8)
        .when(F.col("room").isNotNull() & F.col("_at").isNull(), F.when(several, 4).otherwise(7))
        .when(F.col("object").isNull(), 2)
        .when(F.col("room").isNotNull(), F.when(F.col("_n") == 1, 1).when(F.col("_n") > 1, 6).otherwise(7))
        .when(F.col("_in").isNull(), 7)
        .when(F.size("_in") > 1, 3)
        .otherwise(5)
    )
    out = out.withColumn("rule", rule)
    out = out.withColumn("target_room", F.when(F.col("rule").isin(1, 2, 6), F.col("_at")).when(F.col("rule") == 5, F.get("_in", F.lit(0))))
    out = out.withColumn("candidates", F.when(F.col("rule") == 3, F.col("_in")).when(F.col("rule") == 4, F.col("_of")))
    return out.drop("_room", "_kind", "_of", "_cat", "_in", "_at", "_br", "_bc", "_n")


def dialog(replies: DataFrame, objects: DataFrame, low: float = 2.0, floor: float = 0.163378) -> DataFrame:
    """What becomes of each reply (request, reply) of the router, given the objects (room, category, ordinal, x, y, z).

    outcome: 'say' (message goes to the user: rules 3, 4, 7, 8), 'go' (target x, y, z), 'absent' (the goal isn't in the
    catalogue), 'invalid' (no such reply).  The target is the first object in scan order of the room, or of that category in it;
    names meet in lower case; a target below `low` is put at height `floor`."""
    out = replies.withColumn("_g", reply_goal(F.col("reply"))).withColumns({"rule": F.col("_g.rule"), "_r": F.lower("_g.room"), "_o": F.lower("_g.object"), "message": F.col("_g.message"), "_e": F.col("_g.error")}).drop("_g")
    spot = lambda: F.min_by(F.struct("x", "y", "z"), "ordinal").alias("_p")
    named = objects.select(F.lower("room").alias("_r"), F.lower("category").alias("_o"), "ordinal", "x", "y", "z")
    first = named.groupBy("_r", "_o").agg(spot()).unionByName(named.groupBy("_r").agg(spot()).withColumn("_o", F.lit(None).cast("string")))
    first = first.select(F.col("_r").alias("_fr"), F.col("_o").alias("_fo"), "_p")
    out = out.join(first, (F.col("_r") == F.col("_fr")) & F.col("_o").eqNullSafe(F.col("_fo")), "left")
    outcome = F.when(F.col("_e").isNotNull(), "invalid").when(F.col("rule").isin(3, 4, 7, 8), "say").when(F.col("_p").isNull(), "absent").otherwise("go")
    out = out.withColumn("outcome", outcome)
    height = F.when(F.col("_p.y") < low, F.lit(floor)).otherwise(F.col("_p.y"))
    return out.select(*replies.columns, "rule", "outcome", F.col("_p.x").alias("x"), F.when(F.col("_p").isNotNull(), height).alias("y"), F.col("_p.z").alias("z"), "message")
