"""Profiles, frames and the catalogue, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strings
from ..operators import catalogue, frames, profile
from .registry import Tables, query

c, lit = F.col, F.lit

EVENTS = "WITH e AS (SELECT event_id AS id, event_type AS name, user_id AS thread, epoch_us(ts) AS s, epoch_us(ts) + round(value * 3600000000)::BIGINT AS e FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY s, e DESC, id) AS position FROM e)"
SUMMARY = EVENTS + """, k AS (SELECT a.thread, a.position AS parent, a.s AS a0, b.s AS b0, b.position AS child, least(b.e, a.e) AS x FROM o a JOIN o b ON a.thread = b.thread AND b.position > a.position AND b.s BETWEEN a.s AND a.e),
m AS (SELECT *, coalesce(max(x) OVER (PARTITION BY thread, parent ORDER BY b0, child ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a0) AS before FROM k),
u AS (SELECT thread, parent, sum(greatest(0, x - greatest(b0, before)))::BIGINT AS busy FROM m GROUP BY ALL),
r AS (SELECT o.*, coalesce(busy, 0) AS busy FROM o LEFT JOIN u ON o.thread = u.thread AND o.position = u.parent)"""


def profile_events(t: Tables) -> DataFrame:
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return t("events").select(c("event_id").alias("id"), c("event_type").alias("name"), c("user_id").alias("thread"), start.alias("start"), (start + F.round(c("value") * 3600000000).cast("long")).alias("end"))


@query(SUMMARY + " SELECT name, count(*) AS n, sum(e - s)::BIGINT AS inclusive, sum(e - s - busy)::BIGINT AS exclusive FROM r GROUP BY name")
def agg9_profile_summary(t: Tables) -> DataFrame:
    return profile.summary(profile_events(t))


@query(EVENTS + " SELECT id, thread, position FROM o")
def win18_event_order(t: Tables) -> DataFrame:
    return profile.event_order(profile_events(t)).select("id", "thread", c("position").cast("long").alias("position"))


@query(EVENTS + " SELECT a.thread, a.position AS parent, b.position AS child FROM o a JOIN o b ON a.thread = b.thread AND b.position > a.position AND b.s BETWEEN a.s AND a.e")
def join12_nested_events(t: Tables) -> DataFrame:
    return profile.nested(profile_events(t))


ALIGNED = SUMMARY + ", p AS (SELECT name, thread % 3 AS g, sum(e - s)::BIGINT AS v FROM r WHERE thread % 3 < 2 AND NOT (thread % 3 = 1 AND name = 'error') GROUP BY ALL), j AS (SELECT coalesce(x.name, y.name) AS name, x.v AS v0, y.v AS v1 FROM (SELECT * FROM p WHERE g = 0) x FULL JOIN (SELECT * FROM p WHERE g = 1) y ON x.name = y.name)"


def two_profiles(t: Tables) -> DataFrame:
    e = profile_events(t)
    return profile.aligned([profile.summary(e.filter("thread % 3 = 0")), profile.summary(e.filter("thread % 3 = 1 AND name <> 'error'"))])


@query(ALIGNED + " SELECT name, v0, v1, coalesce(v0, v1) AS sort_key FROM j")
def join13_aligned_profiles(t: Tables) -> DataFrame:
    return two_profiles(t)


@query(ALIGNED + " SELECT name, v0, CASE WHEN v0 IS NOT NULL THEN v1 - v0 ELSE v1 END AS v1 FROM j")
def agg10_relative_profile(t: Tables) -> DataFrame:
    return profile.relative(two_profiles(t), 2)


OBJECTS = "WITH o AS (SELECT p_partkey AS id, p_partkey % 50 AS frame, lower(p_type) AS label, p_size::DOUBLE AS percent, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE (p_partkey * 7 % 97) / 10.0::DOUBLE END AS d FROM part)"
PREF = "CASE WHEN {0} IS NULL THEN 0.6 WHEN {0} <= 0 THEN 0.3 WHEN {0} >= 3 AND {0} <= 5 THEN 1.0 WHEN {0} >= 2 AND {0} <= 6 THEN 0.75 WHEN {0} >= 1 AND {0} <= 7 THEN 0.5 ELSE 0.3 END::DOUBLE"
SEEN = PREF.format("nullif(d, 0)")


def objects(t: Tables) -> DataFrame:
    d = F.when(c("p_partkey") % 13 != 0, (c("p_partkey") * 7 % 97) / lit(10.0))
    return t("part").select(c("p_partkey").alias("id"), (c("p_partkey") % 50).alias("frame"), F.lower("p_type").alias("label"), c("p_size").cast("double").alias("percent"), d.alias("d"))


@query(OBJECTS + " SELECT id, label FROM o WHERE label NOT IN ('economy', 'promo')")
def flt1_label_blacklist(t: Tables) -> DataFrame:
    return frames.drop_labels(objects(t), ignored=("economy", "promo")).select("id", "label")


@query("SELECT p_partkey, p_size FROM part WHERE p_partkey <> 0 AND p_size * 4 >= 50")
def flt3_visible_objects(t: Tables) -> DataFrame:
    return frames.visible(t("part").withColumn("n", c("p_size") * 4), identity="p_partkey", pixels="n").select("p_partkey", "p_size")


@query(OBJECTS + " SELECT id, label FROM o WHERE label IN (SELECT label FROM o WHERE id < 3)")
def flt4_informative_whitelist(t: Tables) -> DataFrame:
    return frames.informative(objects(t), objects(t).filter("id < 3"), "whitelist").select("id", "label")


@query(OBJECTS + " SELECT id, label FROM o WHERE label NOT IN (SELECT label FROM o WHERE id < 3)")
def flt4_informative_blacklist(t: Tables) -> DataFrame:
    return frames.informative(objects(t), objects(t).filter("id < 3"), "blacklist").select("id", "label")


@query("SELECT p_partkey, p_size FROM part WHERE p_size / 100.0 >= 0.02")
def flt5_pixel_area(t: Tables) -> DataFrame:
    return t("part").filter(c("p_size") / 100.0 >= 0.02).select("p_partkey", "p_size")


@query(OBJECTS + f" SELECT id, {PREF.format('d')} AS preference, CASE WHEN d IS NULL OR d <= 0 THEN NULL WHEN d < 1 THEN 'very close' WHEN d < 3 THEN 'near' WHEN d <= 5 THEN 'mid-range' WHEN d <= 6 THEN 'slightly far' ELSE 'far' END AS bucket FROM o")
def prj4_distance_preference(t: Tables) -> DataFrame:
    return objects(t).select("id", frames.preference(c("d")).cast("double").alias("preference"), frames.bucket(c("d")).alias("bucket"))


@query("WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS u, embedding[2]::DOUBLE AS v FROM embeddings), d AS (SELECT vec_id, CASE WHEN v > 0.3 THEN 'upper' WHEN v < -0.3 THEN 'lower' END AS a, CASE WHEN u < -0.3 THEN 'left' WHEN u > 0.3 THEN 'right' END AS b FROM v) SELECT vec_id, coalesce(nullif(concat_ws('-', a, b), ''), 'center') AS direction FROM d")
def prj5_image_direction(t: Tables) -> DataFrame:
    return t("embeddings").select("vec_id", frames.direction(F.get("embedding", lit(0)).cast("double"), F.get("embedding", lit(1)).cast("double")).alias("direction"))


@query("""SELECT event_id, (['left_of', 'right_of', 'in_front_of', 'behind', 'beneath_of', 'on_top_of', 'above', 'next_to', 'far_from', 'touches'])[event_id % 10 + 1] AS relation,
(['to the left of', 'to the right of', 'in front of', 'behind', 'below', 'on top of', 'above', 'next to', 'far from', 'touches'])[event_id % 10 + 1] AS phrase FROM events""")
def prj3_relation_phrase(t: Tables) -> DataFrame:
    names = F.array(*[lit(x) for x in (*frames.PHRASES, "far_from", "touches")])
    return t("events").select("event_id", F.get(names, (c("event_id") % 10).cast("int")).alias("relation")).withColumn("phrase", frames.phrase(c("relation")))


@query("SELECT p_partkey, CASE lower(trim(p_type)) WHEN 'economy' THEN 'budget' WHEN 'promo' THEN 'budget' ELSE lower(trim(p_type)) END AS p_type FROM part")
def prj2_canonical_label(t: Tables) -> DataFrame:
    words = t("part").select(F.lower("p_type").alias("word")).distinct().filter(c("word").isin("economy", "promo")).withColumn("canonical", lit("budget"))
    return frames.canonical(t("part"), words, "p_type").select("p_partkey", "p_type")


@query(OBJECTS + f", s AS (SELECT *, {SEEN} AS p FROM o), k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY percent * p DESC, p DESC, percent DESC, -coalesce(d, 0) DESC, id) AS rank FROM s) SELECT frame, id, rank::INT AS rank FROM k WHERE rank <= 6")
def srt1_salience_top6(t: Tables) -> DataFrame:
    return frames.top_salient(objects(t), "frame", frames.salience_order(c("percent"), c("d"), c("id")), 6).select("frame", "id", "rank")


REL = OBJECTS + f", w AS (SELECT label, count(*) / 1000.0::DOUBLE AS score FROM o WHERE id % 2 = 0 AND label < 'm' GROUP BY label), s AS (SELECT o.*, {SEEN} AS p, coalesce(score, 0.2::DOUBLE) AS relevance FROM o LEFT JOIN w USING (label))"


def relevant(t: Tables) -> DataFrame:
    o = objects(t)
    return frames.scored(o, o.filter("id % 2 = 0 AND label < 'm'").groupBy("label").agg((F.count(lit(1)) / lit(1000.0)).alias("score")))


@query(REL + " SELECT id, relevance FROM s")
def join5_relevance(t: Tables) -> DataFrame:
    return relevant(t).select("id", "relevance")


@query(REL + ", k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY percent * p * relevance DESC, relevance DESC, percent DESC, -coalesce(d, 0) DESC, id) AS rank FROM s) SELECT frame, id, rank::INT AS rank FROM k WHERE rank <= 3")
def srt1_relevant_top3(t: Tables) -> DataFrame:
    return frames.top_salient(relevant(t), "frame", frames.salience_order(c("percent"), c("d"), c("id"), c("relevance")), 3).select("frame", "id", "rank")


@query("SELECT user_id, event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6)::DOUBLE AS percent FROM events GROUP BY user_id, event_type")
def agg3_pixel_histogram(t: Tables) -> DataFrame:
    return frames.pixel_histogram(t("events"), "user_id", "event_type").select("user_id", "event_type", "n", F.round("percent", 6).alias("percent"))


POINTS = "WITH v AS (SELECT vec_id AS id, label AS frame, round(embedding[1]::DOUBLE * 4, 3) AS x, round(embedding[2]::DOUBLE * 4, 3) AS y, round(embedding[3]::DOUBLE * 4, 3) AS z FROM embeddings)"


def points(t: Tables) -> DataFrame:
    def p(i: int) -> Column:
        """Rounded as SQL does it, which keeps the sign of what becomes 0; an angle's sign hangs on it."""
        v = F.get("embedding", lit(i)).cast("double") * 4
        return F.when(F.round(v, 3) == 0, v * 0.0).otherwise(F.round(v, 3))

    return t("embeddings").select(c("vec_id").alias("id"), c("label").alias("frame"), p(0).alias("x"), p(1).alias("y"), p(2).alias("z"))


RELATIONS = POINTS + """, p AS (SELECT a.frame, a.id AS i, b.id AS j, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM v a JOIN v b ON a.frame = b.frame AND a.id < b.id),
r AS (SELECT frame, i, j, sqrt(dx * dx + dy * dy + dz * dz) AS d, CASE WHEN abs(dy) > 0.25 AND abs(dy) > (abs(dx) + abs(dz)) / 1.2::DOUBLE THEN CASE WHEN dy > 0 THEN 'on_top_of' ELSE 'beneath_of' END
WHEN abs(dx) > abs(dz) THEN CASE WHEN dx > 0 THEN 'left_of' ELSE 'right_of' END WHEN dz < 0 THEN 'in_front_of' ELSE 'behind' END AS relation FROM p)"""


@query(RELATIONS + " SELECT frame, i, j, relation, round(d, 6) AS distance_m FROM r WHERE d <= 1.5")
def join6_object_relations(t: Tables) -> DataFrame:
    p = points(t).withColumn("p", F.array("x", "y", "z"))
    return frames.relations(p, "frame", "id", "p").withColumn("distance_m", F.round("distance_m", 6))


@query("WITH r AS (SELECT event_id, user_id, CASE WHEN event_id % 5 = 0 THEN ' ' ELSE event_type END AS subject, CASE WHEN value > 20 THEN 'near' END AS relation, CASE WHEN event_id % 4 = 0 THEN 'Wall' ELSE 'desk' END AS object FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM r WHERE trim(subject) <> '' AND relation IS NOT NULL AND object <> 'Wall') SELECT user_id, event_id FROM k WHERE n <= 3")
def flt2_usable_relations(t: Tables) -> DataFrame:
    r = t("events").select("event_id", "user_id", F.when(c("event_id") % 5 == 0, " ").otherwise(c("event_type")).alias("subject"), F.when(c("value") > 20, "near").alias("relation"), F.when(c("event_id") % 4 == 0, "Wall").otherwise("desk").alias("object"))
    return frames.usable_relations(r, "user_id", "event_id", 3).select("user_id", "event_id")


def clusters(t: Tables) -> DataFrame:
    p = points(t).select("frame", F.concat(lit("l"), (c("id") % 3).cast("string")).alias("label"), c("id").alias("object_id"), (c("id") * 37 % 500 + 50).alias("pixel_count"), (c("id") % 10 / lit(100.0)).alias("percent"), "x", "y", "z", F.abs("x").alias("distance"))
    box = lambda d: F.array(c("x") + d, c("y") + d, c("z") + d)
    return frames.cluster(p.withColumns({"low": box(-0.5), "high": box(0.5)}), 1.0)


@query()
def agg4_greedy_clusters(t: Tables) -> DataFrame:
    return clusters(t)


@query()
def agg5_top_clusters(t: Tables) -> DataFrame:
    return frames.top_clusters(clusters(t), 5)


@query(OBJECTS + """, s AS (SELECT id, frame, label || ' (' || percent::INT::VARCHAR || '%)' AS e, row_number() OVER (PARTITION BY frame ORDER BY percent DESC, id) AS n FROM o)
SELECT frame, string_agg(e, ', ' ORDER BY n) AS objects, frame::VARCHAR || ': Key objects: ' || string_agg(e, ', ' ORDER BY n) AS line FROM s WHERE n <= 4 GROUP BY frame""")
def prj11_prompt_lines(t: Tables) -> DataFrame:
    top = frames.top_salient(objects(t), "frame", [c("percent").desc(), c("id")], 4, "n")
    return frames.prompt_lines(top.withColumn("e", F.concat("label", lit(" ("), c("percent").cast("int").cast("string"), lit("%)"))), "frame", "n", "e")


@query("SELECT n_name AS room, c_mktsegment AS category, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment NOT IN ('HOUSEHOLD') GROUP BY ALL")
def agg1_room_counts(t: Tables) -> DataFrame:
    rooms = t("nation").select(c("n_nationkey").alias("k"), c("n_name").alias("room"))
    o = t("customer").join(rooms, c("c_nationkey") == c("k")).select("room", c("c_mktsegment").alias("category"))
    return catalogue.counts(o, rooms, "room", "category", ["HOUSEHOLD"])


@query("SELECT DISTINCT c_mktsegment AS category FROM customer")
def agg2_distinct_categories(t: Tables) -> DataFrame:
    return t("customer").select(c("c_mktsegment").alias("category")).distinct()


@query("SELECT c_custkey, coalesce(n_name, 'unknown_room') AS n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 20")
def join1_room_name(t: Tables) -> DataFrame:
    names = t("nation").filter("n_nationkey < 20").select(c("n_nationkey").alias("c_nationkey"), "n_name")
    return catalogue.with_name(t("customer"), names, "c_nationkey", "n_name", "unknown_room").select("c_custkey", "n_name")


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def join3_level_region_object(t: Tables) -> DataFrame:
    return t("customer").join(t("nation"), c("c_nationkey") == c("n_nationkey"), "left").join(t("region"), c("n_regionkey") == c("r_regionkey"), "left").select("c_custkey", "n_name", "r_name")


@query("WITH q AS (SELECT DISTINCT c_nationkey AS room, c_mktsegment AS category FROM customer) SELECT q.room, q.category, min(c_custkey) AS c_custkey FROM q JOIN customer ON c_nationkey = q.room AND c_mktsegment = q.category GROUP BY ALL")
def join21_first_object(t: Tables) -> DataFrame:
    o = t("customer").select(c("c_nationkey").alias("room"), c("c_mktsegment").alias("category"), "c_custkey")
    q = o.select("room", "category").distinct().withColumn("request", F.concat_ws("/", c("room").cast("string"), "category"))
    return catalogue.first_match(q, o, "request", ["room", "category"], ["c_custkey"]).select("room", "category", "c_custkey")


@query("SELECT s_suppkey, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_mktsegment = 'BUILDING' AND c_acctbal > 5000) AS found FROM supplier")
def join22_room_holds(t: Tables) -> DataFrame:
    o = t("customer").filter("c_mktsegment = 'BUILDING' AND c_acctbal > 5000").select(c("c_nationkey").alias("s_nationkey"))
    return catalogue.exists(t("supplier"), o, ["s_nationkey"]).select("s_suppkey", "found")


SEGMENTS = ("BUILDING", "MACHINERY", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD")
CATALOGUE = """WITH c AS (SELECT lower(n_name) || '_' || c_nationkey % 2 AS room, c_mktsegment || c_custkey % 40 AS category, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
m AS (SELECT DISTINCT lower(n_name) || '_' || n_nationkey % 2 AS room, CASE WHEN n_nationkey % 3 = 0 THEN 'many' ELSE lower(n_name) END AS kind FROM nation),
q AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN CASE o_orderkey % 7 WHEN 0 THEN 'many' WHEN 1 THEN 'nowhere' WHEN 2 THEN lower(n_name) ELSE lower(n_name) || '_' || n_nationkey % 2 END END AS room,
  CASE WHEN o_orderkey % 2 > 0 THEN (['BUILDING', 'MACHINERY', 'AUTOMOBILE', 'FURNITURE', 'HOUSEHOLD'])[o_orderkey % 5 + 1] || o_orderkey % 41 END AS object FROM orders JOIN nation ON o_custkey % 25 = n_nationkey),
k AS (SELECT kind, count(*) AS rooms, min(room) AS only_room, list_sort(list(room)) AS of FROM m GROUP BY kind), p AS (SELECT category, count(*) AS rooms, min(room) AS only_room, list_sort(list(room)) AS ins FROM c GROUP BY category),
j AS (SELECT q.*, coalesce(m.room, CASE WHEN k.rooms = 1 THEN k.only_room END) AS spot, k.rooms AS kinds, of, p.rooms AS places, p.only_room, ins FROM q LEFT JOIN (SELECT DISTINCT room FROM m) m ON q.room = m.room LEFT JOIN k ON q.room = k.kind LEFT JOIN p ON q.object = p.category),
r AS (SELECT j.*, CASE WHEN j.room IS NULL AND object IS NULL THEN 8 WHEN j.room IS NOT NULL AND spot IS NULL THEN CASE WHEN kinds > 1 THEN 4 ELSE 7 END WHEN object IS NULL THEN 2
  WHEN j.room IS NOT NULL THEN CASE WHEN c.n = 1 THEN 1 WHEN c.n > 1 THEN 6 ELSE 7 END WHEN places IS NULL THEN 7 WHEN places > 1 THEN 3 ELSE 5 END AS rule FROM j LEFT JOIN c ON c.room = spot AND c.category = object)
SELECT id, rule, CASE WHEN rule IN (1, 2, 6) THEN spot WHEN rule = 5 THEN only_room END AS target_room, array_to_string(CASE rule WHEN 3 THEN ins WHEN 4 THEN of END, ',') AS candidates FROM r"""


def house(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Counts of things in rooms, and the rooms with their kinds."""
    room = F.concat(F.lower("n_name"), lit("_"), (c("n_nationkey") % 2).cast("string"))
    n = t("nation").select("n_nationkey", room.alias("room"), F.when(c("n_nationkey") % 3 == 0, "many").otherwise(F.lower("n_name")).alias("kind"))
    things = t("customer").join(n, c("c_nationkey") == c("n_nationkey")).select("room", F.concat("c_mktsegment", (c("c_custkey") % 40).cast("string")).alias("category"))
    return things.groupBy("room", "category").agg(F.count(lit(1)).alias("n")), n.select("room", "kind")


@query(CATALOGUE)
def stm12_route_rule(t: Tables) -> DataFrame:
    things, rooms = house(t)
    k, names = c("o_orderkey"), F.array(*[lit(x) for x in SEGMENTS])
    exact = F.concat(F.lower("n_name"), lit("_"), (c("n_nationkey") % 2).cast("string"))
    room = F.when(k % 7 == 0, "many").when(k % 7 == 1, "nowhere").when(k % 7 == 2, F.lower("n_name")).otherwise(exact)
    q = t("orders").join(t("nation"), c("o_custkey") % 25 == c("n_nationkey")).select(k.alias("id"), F.when(k % 3 > 0, room).alias("room"), F.when(k % 2 > 0, F.concat(F.get(names, (k % 5).cast("int")), (k % 41).cast("string"))).alias("object"))
    return catalogue.route(q, things, rooms).select("id", "rule", "target_room", F.array_join("candidates", ",").alias("candidates"))


@query("""SELECT conv_id, turn, nullif(regexp_extract(lower('Go to "' || text || '" now'), '"(.*?)"', 1), '') AS target FROM conversations""")
def prj9_quoted_target(t: Tables) -> DataFrame:
    said = F.concat(lit('Go to "'), "text", lit('" now'))
    return t("conversations").select("conv_id", "turn", strings.quoted_target(said).alias("target"))


REPLIES = """WITH r AS (SELECT conv_id, turn, role, (conv_id + turn) % 11 AS k FROM conversations),
x AS (SELECT conv_id, turn, k, CASE k WHEN 0 THEN role WHEN 9 THEN '9. Hall_1' WHEN 10 THEN '1. Hall_1 ' || role ELSE ' ' || k || ' . Hall_1, ' || role || ' ' END AS reply,
  CASE WHEN k BETWEEN 1 AND 8 THEN k::INT END AS rule, 'Hall_1, ' || role AS body, role FROM r),
g AS (SELECT conv_id, turn, reply, rule, CASE rule WHEN 1 THEN 'object_in_room' WHEN 2 THEN 'room_only' WHEN 3 THEN 'ambiguous_object_rooms' WHEN 4 THEN 'ambiguous_room' WHEN 5 THEN 'object_in_single_room' WHEN 6 THEN 'object_repeated_in_room' WHEN 7 THEN 'not_found' WHEN 8 THEN 'friendly_conversation' END AS kind,
  CASE WHEN rule = 1 THEN 'Hall_1' WHEN rule IN (2, 5, 6) THEN body END AS room, CASE WHEN rule = 1 THEN role END AS object, CASE WHEN rule IN (3, 4, 7, 8) THEN body END AS message, CASE k WHEN 0 THEN 'format' WHEN 9 THEN 'rule' WHEN 10 THEN 'room, object' END AS error FROM x)"""


def replies(t: Tables) -> DataFrame:
    k = (c("conv_id") + c("turn")) % 11
    told = F.concat(lit(" "), k.cast("string"), lit(" . Hall_1, "), c("role"), lit(" "))
    text = F.when(k == 0, c("role")).when(k == 9, "9. Hall_1").when(k == 10, F.concat(lit("1. Hall_1 "), c("role"))).otherwise(told)
    return t("conversations").select("conv_id", "turn", text.alias("reply"))


@query(REPLIES + " SELECT conv_id, turn, rule, kind, room, object, message, error FROM g")
def prj10_reply_goal(t: Tables) -> DataFrame:
    return replies(t).select("conv_id", "turn", strings.reply_goal(c("reply")).alias("g")).select("conv_id", "turn", "g.*")


DIALOG = """WITH h AS (SELECT p_brand AS room, p_type AS category, p_partkey AS ord, p_size / 10.0::DOUBLE AS x, p_size % 5 * 1.0::DOUBLE AS y, p_partkey % 7 * 1.0::DOUBLE AS z FROM part),
q AS (SELECT o_orderkey AS request, o_orderkey % 9 AS k, lower(b.p_brand) AS room, b.p_type AS object, o_orderkey % 4 = 0 AS wrong FROM orders JOIN part b ON b.p_partkey = o_custkey),
w AS (SELECT request, k, CASE k WHEN 0 THEN 'hello' ELSE k || '. ' || room || CASE WHEN wrong THEN 'x' ELSE '' END || CASE WHEN k = 1 THEN ', ' || upper(object) ELSE '' END END AS reply, CASE WHEN k > 0 THEN k::INT END AS rule, room, object, wrong FROM q),
f AS (SELECT lower(room) AS room, NULL AS object, arg_min(x, ord) AS x, arg_min(y, ord) AS y, arg_min(z, ord) AS z FROM h GROUP BY lower(room) UNION ALL SELECT lower(room), lower(category), arg_min(x, ord), arg_min(y, ord), arg_min(z, ord) FROM h GROUP BY ALL)
SELECT request, reply, rule, CASE WHEN k = 0 THEN 'invalid' WHEN k IN (3, 4, 7, 8) THEN 'say' WHEN f.x IS NULL THEN 'absent' ELSE 'go' END AS outcome, f.x, CASE WHEN f.y < 2 THEN 0.163378::DOUBLE ELSE f.y END AS y, f.z,
  CASE WHEN k IN (3, 4, 7, 8) THEN w.room || CASE WHEN wrong THEN 'x' ELSE '' END END AS message
FROM w LEFT JOIN f ON k IN (1, 2, 5, 6) AND NOT wrong AND f.room = w.room AND f.object IS NOT DISTINCT FROM CASE WHEN k = 1 THEN lower(w.object) END"""


@query(DIALOG)
def stm11_dialog(t: Tables) -> DataFrame:
    p = t("part")
    things = p.select(c("p_brand").alias("room"), c("p_type").alias("category"), c("p_partkey").alias("ordinal"), (c("p_size") / lit(10.0)).alias("x"), (c("p_size") % 5).cast("double").alias("y"), (c("p_partkey") % 7).cast("double").alias("z"))
    k = c("o_orderkey") % 9
    told = F.concat(k.cast("string"), lit(". "), F.lower("p_brand"), F.when(c("o_orderkey") % 4 == 0, "x").otherwise(""), F.when(k == 1, F.concat(lit(", "), F.upper("p_type"))).otherwise(""))
    said = t("orders").join(p, c("o_custkey") == c("p_partkey")).select(c("o_orderkey").alias("request"), F.when(k == 0, "hello").otherwise(told).alias("reply"))
    return catalogue.dialog(said, things)


@query(OBJECTS + """ SELECT id, label || CASE WHEN percent > 0 OR d > 0 THEN ' (' || concat_ws(', ', CASE WHEN percent > 0 THEN printf('%.2f%% area', percent) END, CASE WHEN d > 0 THEN printf('%.1fm away', d) END,
CASE WHEN d <= 0 THEN NULL WHEN d < 1 THEN 'very close' WHEN d < 3 THEN 'near' WHEN d <= 5 THEN 'mid-range' WHEN d <= 6 THEN 'slightly far' WHEN d > 6 THEN 'far' END) || ')' ELSE '' END AS entry FROM o""")
def prj1_object_entry(t: Tables) -> DataFrame:
    return objects(t).select("id", frames.entry(c("label"), c("percent"), c("d")).alias("entry"))


@query("WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS u, embedding[2]::DOUBLE AS v FROM embeddings), d AS (SELECT vec_id, CASE WHEN v > 0.3 THEN 'upper' WHEN v < -0.3 THEN 'lower' END AS a, CASE WHEN u < -0.3 THEN 'left' WHEN u > 0.3 THEN 'right' END AS b FROM v) SELECT vec_id, 'thing (' || coalesce(nullif(concat_ws('-', a, b), ''), 'center') || ')' AS entry FROM d")
def prj1_placed_entry(t: Tables) -> DataFrame:
    u, v = (F.get("embedding", lit(i)).cast("double") for i in (0, 1))
    return t("embeddings").select("vec_id", frames.placed_entry(lit("thing"), u, v).alias("entry"))
