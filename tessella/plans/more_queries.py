"""Further operators bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import strings
from ..operators import episodes, graph, metrics, spatial, trees
from ..operators.ranges import running
from ..operators.registry import Measures
from ..sources import sinks
from .episode_queries import STEPS, by, steps
from .frame_queries import POINTS, points
from .registry import Tables, query

c, lit = F.col, F.lit


COUNTERS = "WITH w AS (SELECT user_id % 7 AS worker, event_type, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY ALL)"


@query(COUNTERS + " SELECT event_type, sum(n)::BIGINT AS total, min(lo) AS least, max(hi) AS most FROM w GROUP BY event_type")
def agg18_all_reduce(t: Tables) -> DataFrame:
    w = t("events").groupBy((c("user_id") % 7).alias("worker"), "event_type").agg(F.count(lit(1)).alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    return metrics.reduced(w, ["event_type"], total=("sum", "n"), least=("min", "lo"), most=("max", "hi"))


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS robot, count(*) FILTER (event_type = 'click') AS object, count(*) FILTER (event_type IN ('error', 'click')) AS total, coalesce(string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (event_type = 'error'), '') AS names FROM events GROUP BY user_id")
def agg27_collision_counters(t: Tables) -> DataFrame:
    hit = lambda k: (c("event_type") == k).cast("long")
    rows = t("events").select("user_id", hit("error").alias("robot"), hit("click").alias("object"), F.when(c("event_type") == "error", F.array("event_id")).otherwise(F.array().cast("array<bigint>")).alias("names"))
    out = metrics.added(rows, ["user_id"], ["robot", "object"], ["names"])
    return out.select("user_id", "robot", "object", (c("robot") + c("object")).alias("total"), F.array_join(F.transform(F.sort_array("names"), lambda x: x.cast("string")), ",").alias("names"))


@query("SELECT key, count(*) AS n, round(avg(v), 6) AS mean FROM (SELECT 'a.value' AS key, value AS v FROM events UNION ALL SELECT 'a.b.user', user_id::DOUBLE FROM events UNION ALL SELECT 'id', (event_id % 100)::DOUBLE FROM events WHERE event_id % 3 > 0) GROUP BY key")
def agg29_transposed_mean(t: Tables) -> DataFrame:
    info = F.to_json(F.struct(F.struct(c("value").alias("value"), F.struct(c("user_id").alias("user")).alias("b")).alias("a"), F.when(c("event_id") % 3 > 0, c("event_id") % 100).alias("id")))
    return metrics.tree_means(t("events").select("event_id", info.alias("info")), "event_id", "info").withColumn("mean", F.round("mean", 6))


@query("SELECT o_custkey, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY o_custkey")
def agg17_gathered(t: Tables) -> DataFrame:
    ids = F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string"))
    return t("orders").groupBy("o_custkey").agg(F.count(lit(1)).alias("n"), F.array_join(ids, ",").alias("orders"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END AS v FROM events")
def map1_get_with_default(t: Tables) -> DataFrame:
    m = F.map_filter(F.create_map(lit("v"), c("value")), lambda _, __: c("event_id") % 3 != 0)
    return t("events").select("event_id", F.coalesce(F.try_element_at(m, lit("v")), lit(0.0)).alias("v"))


JSON = """WITH j AS (SELECT p_partkey, p_partkey % 12 AS k FROM part)"""


@query(JSON + " SELECT p_partkey, (['vector2', 'vector3', 'quaternion', 'vector4', 'matrix3', 'group', 'int', 'double', 'bool', 'string', 'array', NULL])[k + 1] AS kind FROM j")
def jsn2_inferred_kind(t: Tables) -> DataFrame:
    k = (c("p_partkey") % 12).cast("int")
    text = F.get(F.array(*[lit(x) for x in ("[1, 2]", "[1.5, 2, 3]", "[0, 0, 0, 1]", "[0, 0, 0, 1]", "[1,0,0,0,1,0,0,0,1]", '{"a": 1}', "12", "1.5", "true", '"x"', '["x", 1]', "oops")]), k)
    return t("part").select("p_partkey", trees.inferred(text, F.when(k == 2, "orientation").otherwise("place")).alias("kind"))


@query("SELECT event_id, round(value / 7, 5) AS v, '{\"n\":' || user_id || '}' AS json FROM events")
def jsn1_rounded_json(t: Tables) -> DataFrame:
    rows = sinks.rounded(t("events").select("event_id", (c("value") / 7).alias("v"), c("user_id").alias("n")))
    return rows.select("event_id", "v", F.to_json(F.struct("n")).alias("json"))


@query(STEPS + ", k AS (SELECT ep, t, v, sum(round(v * 100)::BIGINT) OVER (PARTITION BY ep ORDER BY t) AS total FROM s) SELECT ep, arg_max(t, (v, -t)) AS at, arg_max(total, t)::BIGINT AS total, bool_or(v > 45) AS any_high, bool_and(v > 0.5) AS all_high, count(DISTINCT round(v)) AS kinds FROM k GROUP BY ep")
def arr1_array_reductions(t: Tables) -> DataFrame:
    r = steps(t).groupBy("ep").agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("r"))
    v = c("r.v")
    cents = F.transform(v, lambda x: F.round(x * 100).cast("long"))
    at = (metrics.argmax(v) + 1).cast("long")
    return r.select("ep", at.alias("at"), F.element_at(metrics.cumulative(cents), -1).alias("total"), F.exists(v, lambda x: x > 45).alias("any_high"), F.forall(v, lambda x: x > 0.5).alias("all_high"), F.size(metrics.unique_counts(F.transform(v, lambda x: F.round(x)))).cast("long").alias("kinds"))


@query("SELECT user_id, count(*) FILTER (value > 1) / count(*)::DOUBLE <= 0.95 AS outdoor, count(*) AS n FROM events GROUP BY user_id")
def agg33_outdoor_vote(t: Tables) -> DataFrame:
    return metrics.outdoor(t("events").withColumn("hit", c("value") > 1), "user_id", "hit")


@query(POINTS + ", m AS (SELECT frame, count(*) AS n, avg(x) AS c_x, avg(z) AS c_z FROM v GROUP BY frame), r AS (SELECT frame, n, max(sqrt((x - c_x) ^ 2 + (z - c_z) ^ 2)) AS radius, sum(abs(x) + 1) AS area FROM v JOIN m USING (frame) GROUP BY ALL) SELECT frame, n, round(radius, 5) AS radius, round(area, 5) AS area, row_number() OVER (ORDER BY round(area, 5) DESC, frame) = 1 AS largest FROM r")
def agg24_islands_by_area(t: Tables) -> DataFrame:
    own = points(t).withColumn("area", F.abs("x") + 1)
    out = spatial.largest_island(spatial.islands(own, "frame", area="area").withColumn("area", F.round("area", 5)), "frame")
    return out.select("frame", "n", F.round("radius", 5).alias("radius"), "area", "largest")


@query("SELECT round(avg(value), 6) AS mean, round(greatest(var_pop(value), 0.01), 5) AS var, count(*)::DOUBLE AS n FROM events")
def agg16_running_moments(t: Tables) -> DataFrame:
    parts = t("events").groupBy("event_type").agg(F.count(lit(1)).cast("double").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
    m = parts.agg(metrics.merge_moments(F.array_sort(F.collect_list(F.struct("n", "mean", "var")))).alias("m"))  # a row for each batch
    return m.select(F.round("m.mean", 6).alias("mean"), F.round(F.greatest("m.var", lit(0.01)), 5).alias("var"), "m.n")


@query("WITH m AS (SELECT avg(value) AS mean, greatest(var_pop(value), 0.01) AS var FROM events) SELECT event_id, round((value - mean) / sqrt(var), 5) AS normal FROM events, m")
def agg16_normalised(t: Tables) -> DataFrame:
    m = t("events").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
    return t("events").crossJoin(F.broadcast(m)).select("event_id", F.round(metrics.normalised(c("value"), c("mean"), c("var")), 5).alias("normal"))  # one row


@query("WITH h AS (SELECT DISTINCT l_orderkey AS obj, l_linenumber AS k, l_suppkey % 7 AS hit, l_returnflag = 'A' AS side FROM lineitem) SELECT a.obj, a.hit, count(DISTINCT a.k) AS votes FROM h a JOIN h b ON a.obj = b.obj AND a.hit = b.hit AND a.side AND NOT b.side GROUP BY ALL")
def join24_ray_votes(t: Tables) -> DataFrame:
    h = t("lineitem").select(c("l_orderkey").alias("obj"), c("l_linenumber").alias("k"), (c("l_suppkey") % 7).alias("hit"), (c("l_returnflag") == "A").alias("side")).distinct()
    other = h.filter("NOT side").select("obj", "hit").distinct()
    return h.filter("side").join(other, ["obj", "hit"], "left_semi").groupBy("obj", "hit").agg(F.count_distinct("k").alias("votes"))


@query("SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts)))::BIGINT AS microseconds FROM events GROUP BY user_id")
def dte1_session_length(t: Tables) -> DataFrame:
    return t("events").groupBy("user_id").agg(F.max("ts").alias("b"), F.min("ts").alias("a")).select("user_id", F.expr("timestampdiff(MICROSECOND, a, b)").alias("microseconds"))


@query(POINTS + " SELECT id, x >= -0.000001 AND z >= -0.000001 AND x + z <= 1.000001 AS inside FROM v")
def geo12_in_triangle(t: Tables) -> DataFrame:
    corner = lambda x, z: F.array(lit(float(x)), lit(0.0), lit(float(z)))
    return points(t).select("id", g.in_triangle(F.array(c("x"), lit(0.0), c("z")), corner(0, 0), corner(1, 0), corner(0, 1)).alias("inside"))


DENSE = """WITH p AS (SELECT p_partkey, p_size::DOUBLE AS a, p_size + p_partkey % 4 * 1.0::DOUBLE AS b FROM part),
x AS (SELECT p_partkey, a, b, list_transform(range(1, floor(a / 3)::INT + 1), lambda k: k * 3.0::DOUBLE) AS far FROM p),
y AS (SELECT p_partkey, a, b, list_concat([0.0::DOUBLE], CASE WHEN a <= 3 THEN CASE WHEN a > 0.7 THEN [a] ELSE far END ELSE far END) AS kept FROM x),
z AS (SELECT p_partkey, a, b, CASE WHEN b = a THEN kept WHEN b - a <= 3 AND abs(kept[-1] - b) > 0.7 THEN list_append(kept, b) ELSE list_concat(kept, list_transform(range(1, floor((b - a) / 3)::INT + 1), lambda k: a + k * 3.0::DOUBLE)) END AS kept FROM y)
SELECT p_partkey, array_to_string(list_transform(CASE WHEN abs(kept[-1] - b) > 0.3 THEN list_append(kept, b) ELSE kept END, lambda v: round(v)::BIGINT), ',') AS xs FROM z"""


@query(DENSE)
def geo15_densified_path(t: Tables) -> DataFrame:
    at = lambda v: F.array(v.cast("double"), lit(0.0), lit(0.0))
    path = F.array(at(lit(0)), at(c("p_size")), at(c("p_size") + c("p_partkey") % 4))
    xs = F.transform(g.densify(path, 3.0), lambda p: F.round(F.get(p, lit(0))).cast("long").cast("string"))
    return t("part").select("p_partkey", F.array_join(xs, ",").alias("xs"))


@query("WITH r AS (SELECT event_type, sum(CASE WHEN user_id % 2 = 0 THEN round(value * 1000)::BIGINT END)::DOUBLE AS control, sum(CASE WHEN user_id % 2 = 1 THEN round(value * 1000)::BIGINT END)::DOUBLE AS test FROM events GROUP BY event_type) SELECT event_type, round((test - control) * 100 / control, 6) AS percent, round(control / test, 6) AS speed_up, round(control * 1000, 3) AS milliseconds FROM r")
def mth2_percent_speed_up(t: Tables) -> DataFrame:
    side = lambda k: F.sum(F.when(c("user_id") % 2 == k, F.round(c("value") * 1000).cast("long"))).cast("double")
    r = t("events").groupBy("event_type").agg(side(0).alias("control"), side(1).alias("test"))
    return r.select("event_type", F.round(strings.percent_difference(c("control"), c("test")), 6).alias("percent"), F.round(strings.speed_up(c("control"), c("test")), 6).alias("speed_up"), F.round(strings.milliseconds(c("control")), 3).alias("milliseconds"))


INFO = """SELECT event_id, unnest(['reward', 'nested.done', 'nested.deep.x', 'one']) AS name, unnest([event_id % 7, (event_id % 2 = 0)::INT, event_id % 11, event_id % 5])::DOUBLE AS value FROM events"""


@query(INFO)
def flt15_scalars(t: Tables) -> DataFrame:
    n = lambda m: (c("event_id") % m).cast("string")
    done = F.when(c("event_id") % 2 == 0, "true").otherwise("false")
    text = F.concat(lit('{"reward":'), n(7), lit(',"label":"5","top_down_map":3,"many":[1,2],"nested":{"done":'), done, lit(',"secret":1,"deep":{"x":'), n(11), lit(',"s":"t"}},"one":['), n(5), lit("]}"))
    return trees.scalars(t("events").select("event_id", text.alias("info")), "event_id", "info", ("nested.secret",))


FITS = """WITH r AS (SELECT p_partkey, p_name AS name, CASE WHEN p_partkey % 5 > 0 THEN p_type END AS parent, CASE WHEN p_partkey % 3 = 0 THEN 0.5 ELSE 1 END AS level FROM part)"""


@query(FITS + " SELECT p_partkey FROM r WHERE level >= 0.9 AND CASE WHEN contains(name, 'small') THEN false WHEN parent IS NULL THEN contains(name, 'ring') WHEN contains(parent, 'O') AND contains(name, 'ring') THEN true WHEN contains(parent, 'PROMO') THEN false WHEN contains(parent, 'A') AND contains(name, 'b') THEN true ELSE false END")
def flt13_receptacle_sets(t: Tables) -> DataFrame:
    sets = [{"excluded_receptacles": ["small"], "included_objects": ["O"], "included_receptacles": ["ring"]}, {"excluded_objects": ["PROMO"], "included_objects": ["A"], "included_receptacles": ["b"]}]
    k = c("p_partkey")
    r = t("part").select(k, c("p_name").alias("name"), F.when(k % 5 > 0, c("p_type")).alias("parent"), F.when(k % 3 == 0, F.array(lit(0.0), lit(-0.5), lit(0.0))).otherwise(F.array(lit(0.0), lit(-1.0), lit(0.0))).alias("down"))
    return r.filter(episodes.receptacle_fits(sets)).select("p_partkey")


@query("SELECT p_type || ' Full name,Can delete?,Is locked?,size' AS line, 0::BIGINT AS nth, p_type FROM part WHERE contains(lower(p_name), 'ring') GROUP BY p_type UNION ALL SELECT p_name || '#' || p_partkey || ',True,False,' || p_size, row_number() OVER (PARTITION BY p_type ORDER BY p_name || '#' || p_partkey), p_type FROM part WHERE contains(lower(p_name), 'ring')")
def prj7_info_rows(t: Tables) -> DataFrame:
    p = t("part").select("p_type", F.concat_ws("#", "p_name", c("p_partkey").cast("string")).alias("handle"), F.lit(True).alias("deletable"), F.lit(False).alias("locked"), c("p_size").cast("string").alias("info"))
    return sinks.info_lines(p.filter(episodes.search(c("handle"), "ring")), "p_type", "size")


@query("SELECT p_brand, p_brand || '_:' || lpad((max(CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 100 ELSE -1 END) + 1)::VARCHAR, 4, '0') AS handle FROM part GROUP BY p_brand")
def prj8_unique_handle(t: Tables) -> DataFrame:
    own = t("part").select("p_brand", F.concat("p_brand", F.when(c("p_partkey") % 3 > 0, "_:").otherwise("_"), F.lpad((c("p_partkey") % 100).cast("string"), 4, "0")).alias("handle"))
    return sinks.next_handles(own, "p_brand", "handle")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_name, p_partkey) - 1 AS place FROM part")
def srt2_by_size_and_name(t: Tables) -> DataFrame:
    return running(t("part"), [-c("p_size"), c("p_name"), c("p_partkey")], name="place").select("p_partkey", c("place").cast("long").alias("place"))


@query("SELECT user_id, min(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS try FROM events) WHERE try < 5 AND value > 10 GROUP BY user_id")
def smp5_first_valid(t: Tables) -> DataFrame:
    e = t("events").withColumn("try", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)
    return episodes.first_valid(e, "user_id", "try", c("value") > 10, 5).select("user_id", "event_id")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def smp5_most_clearance(t: Tables) -> DataFrame:
    return episodes.best_of(t("events"), "user_id", "value", "event_id").select("user_id", "event_id")


@query("WITH k AS (SELECT user_id AS scene, event_id, abs(user_id % 3 * 0.25) <= 0.5 AND value BETWEEN 1 AND 30 AND value / (event_id % 50 + 1) >= 1.1 AND event_id % 4 >= 1.5 AS good FROM events) SELECT scene, event_id, row_number() OVER (PARTITION BY scene ORDER BY event_id) - 1 AS episode_id FROM k WHERE good QUALIFY row_number() OVER (PARTITION BY scene ORDER BY event_id) <= 2")
def smp7_generated_episodes(t: Tables) -> DataFrame:
    e = t("events").select(c("user_id").alias("scene"), "event_id", (c("user_id") % 3 * 0.25).alias("dy"), c("value").alias("geodesic"), (c("event_id") % 50 + 1).cast("double").alias("euclid"), (c("event_id") % 4).cast("double").alias("island_radius"))
    return episodes.generated(e, "scene", "event_id", 2, 1, 30).select("scene", "event_id", c("episode_id").cast("long").alias("episode_id"))


@query("WITH r AS (SELECT c_nationkey, ((row_number() OVER (ORDER BY md5('w:' || c_nationkey), c_nationkey) - 1) % 4)::INT AS worker FROM (SELECT DISTINCT c_nationkey FROM customer)) SELECT c_custkey, worker FROM customer JOIN r USING (c_nationkey)")
def prt3_scene_workers(t: Tables) -> DataFrame:
    return episodes.scene_workers(t("customer"), "c_nationkey", 4, "w").select("c_custkey", "worker")


@query("SELECT item_id, array_to_string(list_transform(string_split(lower(text), ' '), lambda w: CASE WHEN w IN ('the', 'a', 'in') THEN w ELSE 'UNK' END), ' ') || '?' AS decoded FROM benchmark")
def str2_round_trip(t: Tables) -> DataFrame:
    known = F.create_map(*[x for i, w in enumerate(("the", "a", "in")) for x in (lit(w), lit(i + 2))])
    ids = strings.indices_of(F.split(F.lower("text"), " "), known, 1)
    return t("benchmark").select("item_id", strings.sentence(ids, F.array(lit("<pad>"), lit("UNK"), lit("the"), lit("a"), lit("in"))).alias("decoded"))


@query(r"SELECT page_id, regexp_extract(url, '([^/]*?)(?:[.:].*)?$', 1) AS name, regexp_extract(regexp_extract(url, '[^/]*$'), '^(.*?)(\.[^.]*)?$', 1) AS base, regexp_extract(regexp_extract(url, '[^/]*$'), '^(.*?)(\.[^.]*)?$', 2) AS ext FROM pages")
def str4_short_names(t: Tables) -> DataFrame:
    return t("pages").select("page_id", strings.short_name(c("url")).alias("name"), strings.base_and_ext(c("url")).alias("b")).select("page_id", "name", "b.base", "b.ext")


def errands(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each supplier stands in a nation and is to fetch a key from another one to a third, along three ways out of each."""
    at = lambda k: F.concat(lit("at "), F.pmod(k, lit(25)).cast("string"))
    key = lambda k: F.concat(lit("key "), F.pmod(k, lit(25)).cast("string"))
    s, n, none = c("s_suppkey"), c("n_nationkey"), F.array().cast("array<string>")
    start = t("supplier").select(s.alias("problem"), F.array(at(c("s_nationkey")), key(c("s_nationkey") * 3 + 1)).alias("facts"))
    goals = t("supplier").select(s.alias("problem"), F.explode(F.array(lit("have"), at(s * 7))).alias("fact"))
    ways = t("nation").withColumn("to", F.explode(F.array(n + 1, n + 5, n + 11)))
    go = ways.select(F.concat(lit("go "), F.pmod(c("to"), lit(25)).cast("string")).alias("name"), F.array(at(n)).alias("needs"), F.array(at(c("to"))).alias("adds"), F.array(at(n)).alias("removes"))
    pick = t("nation").select(lit("pick").alias("name"), F.array(key(n), at(n)).alias("needs"), F.array(lit("have")).alias("adds"), F.array(key(n)).alias("removes"))
    rest = t("region").limit(1).select(lit("rest").alias("name"), none.alias("needs"), none.alias("adds"), none.alias("removes"))
    return start, go.unionByName(pick).unionByName(rest), goals


@query("""WITH RECURSIVE w(x, n) AS (SELECT 0, 0 UNION SELECT (x + s) % 25, n + 1 FROM w, (SELECT unnest([1, 5, 11]) AS s) WHERE n < 7), d AS (SELECT x, min(n) AS n FROM w GROUP BY x),
s AS (SELECT s_suppkey AS problem, s_nationkey % 25 AS a, (s_nationkey * 3 + 1) % 25 AS k, s_suppkey * 7 % 25 AS g FROM supplier)
SELECT problem, (p.n + 1 + q.n)::BIGINT AS length, 'at ' || g || ', have' AS state FROM s JOIN d p ON p.x = (k - a + 25) % 25 JOIN d q ON q.x = (g - k + 25) % 25""")
def gra9_plan(t: Tables) -> DataFrame:
    start, actions, goals = errands(t)
    return graph.plans(start, actions, goals, 12).select("problem", c("length").cast("long").alias("length"), F.array_join("state", ", ").alias("state"))


@query(STEPS + " SELECT id, t AS steps, t * 2 AS doubled, t * 2 + 1 AS odd FROM s")
def udf2_measures(t: Tables) -> DataFrame:
    own = Measures()
    own.register("odd", ["doubled"])(lambda: c("doubled") + 1)
    own.register("doubled", ["steps"])(lambda: c("steps") * 2)
    own.register("steps")(lambda: F.count(lit(1)).over(metrics.so_far(by())))
    return own.apply(steps(t), ["odd"]).select("id", "steps", "doubled", "odd")
