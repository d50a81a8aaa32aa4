"""Datasets of episodes and step metrics, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import strings
from ..operators import episodes, metrics, scans
from .registry import Tables, query

c, lit = F.col, F.lit


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def flt6_filter_episodes(t: Tables) -> DataFrame:
    return t("orders").filter((c("o_totalprice") > 100000) & (c("o_orderstatus") == "F")).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def flt7_content_scenes(t: Tables) -> DataFrame:
    return episodes.content_scenes(t("customer"), ["BUILDING", "MACHINERY"], "c_mktsegment").select("c_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (3, 50, 700)")
def flt8_by_id(t: Tables) -> DataFrame:
    return t("orders").filter(c("o_orderkey").isin(3, 50, 700)).select("o_orderkey", "o_custkey")


@query("SELECT p_partkey FROM part WHERE (contains(p_name, 'ring') OR contains(p_name, 'b')) AND NOT contains(p_name, 'small')")
def flt9_substring_cull(t: Tables) -> DataFrame:
    return t("part").filter(episodes.cull(c("p_name"), ["ring", "b"], ["small"])).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE NOT contains(lower(p_name), 'ring')")
def flt10_handle_search(t: Tables) -> DataFrame:
    return t("part").filter(episodes.search(c("p_name"), "RING", contains=False)).select("p_partkey")


@query("SELECT c_name FROM customer WHERE contains(lower(c_name), '#00000001') ORDER BY c_name <> '#00000001', c_name LIMIT 1")
def flt11_best_match(t: Tables) -> DataFrame:
    return episodes.best_match(t("customer"), "c_name", "#00000001").select("c_name")


@query("SELECT p_partkey FROM part WHERE NOT (contains(p_name, 'ring') OR contains(p_name, 'small') OR contains(p_name, '7'))")
def flt12_excluded_names(t: Tables) -> DataFrame:
    return t("part").filter(~episodes.excluded(c("p_name"), ["ring", "small", "7"])).select("p_partkey")


@query("SELECT event_id FROM events WHERE abs(user_id % 3 * 0.25) <= 0.5 AND value BETWEEN 1 AND 30 AND value / (event_id % 50 + 1) >= 1.1 AND user_id % 4 >= 1.5")
def flt14_compatible_episode(t: Tables) -> DataFrame:
    e = t("events").select("event_id", (c("user_id") % 3 * 0.25).alias("dy"), c("value").alias("geodesic"), (c("event_id") % 50 + 1).cast("double").alias("euclid"), (c("user_id") % 4).cast("double").alias("island_radius"))
    return e.filter(episodes.compatible(1, 30)).select("event_id")


@query("SELECT event_id, v FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / (event_id % 5) END AS v FROM events WHERE event_id % 5 > 0) WHERE v IS NOT NULL")
def flt16_finite_only(t: Tables) -> DataFrame:
    v = F.when(c("event_id") % 7 == 0, float("nan")).when(c("event_id") % 5 == 0, float("inf")).otherwise(c("value") / F.nullif(c("event_id") % 5, lit(0)))
    return t("events").select("event_id", v.alias("v")).filter(~F.isnan("v") & (F.abs("v") < float("inf")))


@query("SELECT user_id, list_sort(list_filter(range(8), lambda i: (user_id::BIGINT >> i) & 1 = 1))::INT[]::VARCHAR AS bits, 4294967295 - (1::BIGINT << (user_id % 16))::BIGINT AS others FROM (SELECT DISTINCT user_id FROM events)")
def flt20_user_mask(t: Tables) -> DataFrame:
    u = t("events").select("user_id").distinct()
    text = F.concat(lit("["), F.array_join(F.transform(strings.bits(c("user_id"), 8), lambda i: i.cast("string")), ", "), lit("]"))
    return u.select("user_id", text.alias("bits"), strings.all_except(c("user_id") % 16).alias("others"))


@query("SELECT event_id FROM events WHERE event_type NOT IN ('error', 'view')")
def flt21_measures_here(t: Tables) -> DataFrame:
    return t("events").filter(~c("event_type").isin("error", "view")).select("event_id")


@query("SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS goals FROM orders GROUP BY o_custkey")
def agg12_goals_once(t: Tables) -> DataFrame:
    return episodes.goals_once(t("orders").withColumn("goals", c("o_orderstatus")), "o_custkey", "goals", "o_orderkey")


@query("SELECT o_orderkey, g.goals FROM orders JOIN (SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS goals FROM orders GROUP BY o_custkey) g USING (o_custkey)")
def join2_shared_goals(t: Tables) -> DataFrame:
    g = episodes.goals_once(t("orders").withColumn("goals", c("o_totalprice")), "o_custkey", "goals", "o_orderkey")
    return t("orders").join(g, "o_custkey").select("o_orderkey", "goals")


GROUPED = "WITH f AS (SELECT *, min(o_orderkey) OVER (PARTITION BY o_orderpriority) AS first FROM orders), g AS (SELECT o_orderkey, row_number() OVER (ORDER BY first, o_orderkey) - 1 AS position, dense_rank() OVER (ORDER BY first) AS scene_rank FROM f)"


@query(GROUPED + " SELECT o_orderkey, position FROM g")
def srt3_grouped_order(t: Tables) -> DataFrame:
    return episodes.grouped_order(t("orders"), "o_orderpriority", "o_orderkey").select("o_orderkey", "position")


@query(GROUPED + " SELECT o_orderkey, (scene_rank - 2 + (SELECT max(scene_rank) FROM g)) % (SELECT max(scene_rank) FROM g) + 1 AS rotated_rank FROM g")
def srt4_rotated_groups(t: Tables) -> DataFrame:
    out = episodes.rotated(episodes.grouped_order(t("orders"), "o_orderpriority", "o_orderkey"))
    return out.select("o_orderkey", c("rotated_rank").cast("long").alias("rotated_rank"))


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('s:' || c_custkey), c_custkey) AS at FROM customer")
def srt6_shuffled_groups(t: Tables) -> DataFrame:
    w = Window.partitionBy("c_mktsegment").orderBy(episodes.hash_order(c("c_custkey"), "s"), "c_custkey")
    return t("customer").select("c_custkey", F.row_number().over(w).cast("long").alias("at"))


@query("SELECT c_custkey FROM customer ORDER BY md5('a:' || c_custkey), c_custkey LIMIT 100")
def smp1_sample(t: Tables) -> DataFrame:
    return episodes.sample(t("customer").select("c_custkey"), "c_custkey", 100, "a")


@query("WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('b:' || c_custkey), c_custkey) - 1 AS n, count(*) OVER () // 11 AS k FROM customer) SELECT c_custkey, (n // k)::INT AS split, n % k AS position FROM r WHERE n < 11 * k")
def smp2_splits(t: Tables) -> DataFrame:
    return episodes.splits(t("customer").select("c_custkey"), "c_custkey", 11, "b")


@query("WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (ORDER BY md5('b:' || c_custkey), c_custkey) AS n, count(*) OVER () AS total FROM customer), f AS (SELECT *, min(n) OVER (PARTITION BY c_nationkey) AS first FROM r), g AS (SELECT c_custkey, row_number() OVER (ORDER BY first, n) - 1 AS n, total // 7 AS k, total % 7 AS big FROM f) SELECT c_custkey, (CASE WHEN n < big * (k + 1) THEN n // (k + 1) ELSE big + (n - big * (k + 1)) // k END)::INT AS split FROM g")
def smp2_uneven_by_scene(t: Tables) -> DataFrame:
    return episodes.splits(t("customer").select("c_custkey", "c_nationkey"), "c_custkey", 7, "b", uneven=True, scene="c_nationkey").select("c_custkey", "split")


@query("WITH i AS (SELECT p_type, sum(p_size) AS w FROM part GROUP BY p_type), k AS (SELECT p_type, sum(w) OVER (ORDER BY p_type)::DOUBLE / sum(w) OVER ()::DOUBLE AS hi FROM i), r AS (SELECT p_type, coalesce(lag(hi) OVER (ORDER BY p_type), 0) AS lo, hi FROM k) SELECT event_id, p_type FROM (SELECT event_id, event_id % 997 / 997.0::DOUBLE AS u FROM events) JOIN r ON u >= lo AND u < hi")
def smp3_weighted_pick(t: Tables) -> DataFrame:
    items = t("part").groupBy("p_type").agg(F.sum("p_size").cast("double").alias("w"))
    draws = t("events").select("event_id", (c("event_id") % 997 / lit(997.0)).alias("u"))
    return episodes.weighted_pick(items, draws, "w", "p_type").select("event_id", "p_type")


@query("SELECT o_orderkey, (o_orderkey // 7)::INT AS scene FROM orders")
def smp4_balanced_scene(t: Tables) -> DataFrame:
    return t("orders").select("o_orderkey", episodes.balanced_scene(c("o_orderkey"), 7).alias("scene"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n <= o_custkey % 5")
def smp6_capacity(t: Tables) -> DataFrame:
    cap = t("customer").select(c("c_custkey").alias("o_custkey"), (c("c_custkey") % 5).alias("capacity"))
    return episodes.allocate(t("orders"), cap, "o_custkey", "o_orderkey").select("o_orderkey")


@query("SELECT c_custkey, array_to_string(list_transform(range(4), lambda i: c_custkey // 4 + CASE WHEN i < c_custkey % 4 THEN 1 ELSE 0 END), ',') AS sizes FROM customer")
def prt1_partition_sizes(t: Tables) -> DataFrame:
    return t("customer").select("c_custkey", F.array_join(F.transform(strings.partition_sizes(c("c_custkey"), 4), lambda x: x.cast("string")), ",").alias("sizes"))


@query("SELECT event_id, ntile(4) OVER (PARTITION BY event_type ORDER BY md5('m:' || event_id), event_id)::INT AS minibatch FROM events")
def prt2_minibatches(t: Tables) -> DataFrame:
    return episodes.chunks(t("events"), "event_id", 4, "m", ["event_type"]).select("event_id", "minibatch")


@query("WITH r AS (SELECT n_nationkey, ((row_number() OVER (ORDER BY md5('e:' || n_nationkey), n_nationkey) - 1) % 4)::INT AS environment FROM nation) SELECT *, environment + 100 AS environment_seed FROM r")
def prt4_round_robin(t: Tables) -> DataFrame:
    return episodes.round_robin(t("nation").select("n_nationkey"), "n_nationkey", 4, "e", 100)


@query("SELECT o_orderpriority, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS items, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS position FROM orders GROUP BY o_orderpriority")
def agg30_scene_groups(t: Tables) -> DataFrame:
    out = episodes.collated(t("orders"), "o_orderpriority", "o_orderkey", "o_orderkey")
    return out.select("o_orderpriority", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"), c("position").cast("long").alias("position"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def set1_union_all(t: Tables) -> DataFrame:
    return t("customer").select(c("c_custkey").alias("id"), c("c_name").alias("name")).unionByName(t("supplier").select(c("s_suppkey").alias("id"), c("s_name").alias("name")))


@query("SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set2_intersect(t: Tables) -> DataFrame:
    return t("customer").select("c_nationkey").intersect(t("supplier").select(c("s_nationkey").alias("c_nationkey")))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def set3_difference(t: Tables) -> DataFrame:
    return t("customer").select("c_custkey").exceptAll(t("orders").select("o_custkey").distinct()).distinct()


TOKENS = r"""WITH w AS (SELECT item_id, unnest(list_filter(list_transform(regexp_extract_all(replace(replace(lower(text), chr(39), ' ' || chr(39)), 's', ' s'), '[\p{L}\p{N}_-]+|[^\p{L}\p{N}_-]+'), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13))), lambda x: x <> '')) AS token FROM benchmark)"""


@query(TOKENS + " SELECT token, count(*) AS n, min(item_id) AS doc FROM w GROUP BY token HAVING count(*) >= 3")
def agg11_vocabulary(t: Tables) -> DataFrame:
    return t("benchmark").select("item_id", F.explode(strings.tokenize(c("text"))).alias("token")).groupBy("token").agg(F.count(lit(1)).alias("n"), F.min("item_id").alias("doc")).filter("n >= 3")


STEPS = "WITH s AS (SELECT user_id AS ep, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, event_type AS a, value AS v, value * 0.5 AS x, (event_id % 17)::DOUBLE AS y, (event_id % 23)::DOUBLE AS z FROM events)"
W = "OVER (PARTITION BY ep ORDER BY t"


def steps(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").select(c("user_id").alias("ep"), c("event_id").alias("id"), F.row_number().over(w).cast("long").alias("t"), c("event_type").alias("a"), c("value").alias("v"), (c("value") * 0.5).alias("x"), (c("event_id") % 17).cast("double").alias("y"), (c("event_id") % 23).cast("double").alias("z"))



def by() -> WindowSpec:
    return metrics.over(["ep"], ["t"])


LENGTH = STEPS + f", l AS (SELECT *, coalesce(sqrt((x - lag(x) {W})) ^ 2 + (y - lag(y) {W})) ^ 2 + (z - lag(z) {W})) ^ 2), 0) AS d FROM s), p AS (SELECT *, sum(d) {W} ROWS UNBOUNDED PRECEDING) AS path, first_value(v) {W}) AS start FROM l)"


def walked(t: Tables) -> DataFrame:
    s = steps(t).withColumn("d", metrics.step_length(c("x"), c("y"), c("z"), by()))
    return s.withColumn("path", F.sum("d").over(metrics.so_far(by()))).withColumn("start", F.first("v").over(by()))


@query(STEPS + f" SELECT id, round(avg(v) {W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 9) AS mean5, round(avg(v) {W} ROWS UNBOUNDED PRECEDING), 9) AS mean_all FROM s")
def win1_windowed_mean(t: Tables) -> DataFrame:
    return steps(t).select("id", F.round(metrics.windowed_mean(c("v"), by(), 5), 9).alias("mean5"), F.round(metrics.windowed_mean(c("v"), by(), 0), 9).alias("mean_all"))


@query(STEPS + f" SELECT id, CASE WHEN t % 3 = 0 THEN round(avg(v) {W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) END AS mean5 FROM s")
def win2_emitted_mean(t: Tables) -> DataFrame:
    return steps(t).select("id", metrics.emitted(F.round(metrics.windowed_mean(c("v"), by(), 5), 6), by(), 3).alias("mean5"))


@query(STEPS + f", k AS (SELECT *, sum(v) {W}) AS total FROM s), f AS (SELECT id, t, total, first_value(total) {W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS a, first_value(t) {W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS b FROM k) SELECT id, round(CASE WHEN t = 1 THEN total / 1 ELSE (total - a) / greatest(t - b, 1) END, 5) AS ratio FROM f")
def win3_delta_ratio(t: Tables) -> DataFrame:
    s = steps(t).withColumn("total", F.sum("v").over(metrics.so_far(by())))
    return s.select("id", F.round(metrics.delta_ratio(c("total"), c("t"), by(), 5), 5).alias("ratio"))


@query(LENGTH + " SELECT id, round(path, 5) AS path FROM p")
def win4_path_length(t: Tables) -> DataFrame:
    return walked(t).select("id", F.round("path", 5).alias("path"))


@query(LENGTH + " SELECT id, round(CASE WHEN a = 'click' THEN 1 ELSE 0 END * CASE WHEN greatest(start, path) > 0 THEN start / greatest(start, path) END, 6) AS spl, round(greatest(0, 1 - CASE WHEN start <> 0 THEN v / start END) * CASE WHEN greatest(start, path) > 0 THEN start / greatest(start, path) END, 6) AS soft_spl FROM p")
def win5_spl(t: Tables) -> DataFrame:
    s = walked(t)
    hit = F.when(c("a") == "click", 1.0).otherwise(0.0)
    return s.select("id", F.round(metrics.spl(hit, c("start"), c("path")), 6).alias("spl"), F.round(metrics.soft_spl(c("v"), c("start"), c("path")), 6).alias("soft_spl"))


@query(STEPS + f" SELECT id, a = 'click' AND v < 5 AS success, round(lag(v) {W}) - v, 6) AS reward FROM s")
def win6_success_reward(t: Tables) -> DataFrame:
    return steps(t).select("id", ((c("a") == "click") & (c("v") < 5)).alias("success"), F.round(F.lag("v").over(by()) - c("v"), 6).alias("reward"))


@query(STEPS + f", m AS (SELECT *, abs(v - coalesce(lag(v) {W}), -1000)) > 5 AS moved FROM s) SELECT id, last_value(CASE WHEN moved THEN v END IGNORE NULLS) {W} ROWS UNBOUNDED PRECEDING) AS kept FROM m")
def win7_recomputed_if_moved(t: Tables) -> DataFrame:
    moved = F.abs(c("v") - F.coalesce(F.lag("v").over(by()), lit(-1000))) > 5
    return steps(t).withColumn("moved", moved).select("id", F.last(F.when(c("moved"), c("v")), ignorenulls=True).over(metrics.so_far(by())).alias("kept"))


@query(STEPS + f" SELECT id, sum((a = 'error')::INT) {W})::BIGINT AS collisions, t AS steps FROM s")
def win8_collisions(t: Tables) -> DataFrame:
    return steps(t).select("id", F.sum((c("a") == "error").cast("int")).over(metrics.so_far(by())).alias("collisions"), c("t").alias("steps"))


@query(STEPS + f" SELECT id, bool_or(v > 40) {W}) AS ever, v > 40 AND sum((v > 40)::INT) {W}) = 1 AS first_time FROM s")
def win9_latch(t: Tables) -> DataFrame:
    return steps(t).select("id", metrics.ever(c("v") > 40, by()).alias("ever"), metrics.first_time(c("v") > 40, by()).alias("first_time"))


@query(STEPS + " SELECT id, CASE WHEN v > 40 AND row_number() OVER (PARTITION BY ep, a, v > 40 ORDER BY t) = 1 THEN 2.5 ELSE 0 END::DOUBLE AS reward FROM s")
def win10_first_time_reward(t: Tables) -> DataFrame:
    return steps(t).select("id", metrics.first_time_reward(c("v") > 40, metrics.over(["ep", "a"], ["t"]), 2.5).alias("reward"))


@query(STEPS + " SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY ep, round_even(x * 2, 0) / 2, round_even(z * 2, 0) / 2 ORDER BY t) AS n FROM s) WHERE n = 1")
def win11_first_visit(t: Tables) -> DataFrame:
    w = Window.partitionBy("ep", F.bround(c("x") * 2, 0) / 2, F.bround(c("z") * 2, 0) / 2).orderBy("t")
    return steps(t).withColumn("n", F.row_number().over(w)).filter("n = 1").select("id")


#: The force accumulator step by step; `level` is the force it compares with.
FORCE = STEPS.replace("WITH s", "WITH RECURSIVE s") + """, f(ep, t, level, add, accum) AS (SELECT ep, t, v, 0.0::DOUBLE, 0.0::DOUBLE FROM s WHERE t = 1
UNION ALL SELECT f.ep, s.t, CASE WHEN s.v - level > 2 OR s.v - level < 0 THEN s.v ELSE level END, CASE WHEN s.v - level > 2 OR s.v - level < 0 THEN s.v - level ELSE 0 END, accum + CASE WHEN s.v - level > 2 THEN s.v - level ELSE 0 END
FROM f JOIN s ON s.ep = f.ep AND s.t = f.t + 1)"""


def forces(t: Tables) -> DataFrame:
    """ep, t, add, accum: what each step's force adds."""
    return scans.scanned(steps(t), "ep", c("t"), [c("v")], scans.hysteresis(2.0), "t")


@query(FORCE + " SELECT ep, t, add, accum FROM f")
def win12_force_hysteresis(t: Tables) -> DataFrame:
    return forces(t)


@query(FORCE + " SELECT ep, t, -greatest(0, least(0.01::DOUBLE * add, 0.2::DOUBLE)) - CASE WHEN accum > 60 THEN 10 ELSE 0 END AS reward FROM f")
def win14_force_penalty(t: Tables) -> DataFrame:
    ended = F.when(c("accum") > 60, 10.0).otherwise(0.0)
    return forces(t).select("ep", "t", (metrics.force_penalty(c("add"), 0.01, 0.2) - ended).alias("reward"))


@query(STEPS + " SELECT id, round((v - avg(v) OVER (PARTITION BY ep)) / (sqrt(var_pop(v) OVER (PARTITION BY ep)) + 0.00001), 5) AS advantage FROM s")
def win16_advantage(t: Tables) -> DataFrame:
    w = Window.partitionBy("ep")
    return steps(t).select("id", F.round((c("v") - F.avg("v").over(w)) / (F.sqrt(F.var_pop("v").over(w)) + 0.00001), 5).alias("advantage"))


@query(STEPS + f", k AS (SELECT *, (a IN ('click', 'view') AND lag(a) {W}) IN ('click', 'view') AND a <> lag(a) {W}))::INT AS swap FROM s), f AS (SELECT id, min(swap) {W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m, count(swap) {W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM k) SELECT id, m = 1 AND n = 3 AS thrashing FROM f")
def win17_thrashing(t: Tables) -> DataFrame:
    swap, test = metrics.alternates(c("a"), by(), 4, ("click", "view"))
    return steps(t).withColumn("swap", swap).select("id", test(c("swap")).alias("thrashing"))


@query(STEPS + " SELECT id, t >= 20 AS over FROM s")
def win19_episode_over(t: Tables) -> DataFrame:
    return steps(t).select("id", (c("t") >= 20).alias("over"))


@query(STEPS + f" SELECT id, round(avg(v - x) {W}), 9) AS mean_gap FROM s")
def win20_running_gap(t: Tables) -> DataFrame:
    return steps(t).select("id", F.round(F.avg(c("v") - c("x")).over(metrics.so_far(by())), 9).alias("mean_gap"))


@query(STEPS + f" SELECT id, round(sum(v) {W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / sum(x + 1) {W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS window_fps, round(sum(v) {W}) / sum(x + 1) {W}), 6) AS total_fps FROM s")
def win21_fps(t: Tables) -> DataFrame:
    w5, w = by().rowsBetween(-4, 0), metrics.so_far(by())
    r = lambda f: F.round(F.sum("v").over(f) / F.sum(c("x") + 1).over(f), 6)
    return steps(t).select("id", r(w5).alias("window_fps"), r(w).alias("total_fps"))


#: Steps counted from the end of each episode, so that a recursion can go backwards.
BACK = STEPS.replace("WITH s", "WITH RECURSIVE s") + ", b AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY t DESC) AS k, CASE WHEN id % 5 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS m FROM s)"


def mask() -> Column:
    return F.when(c("id") % 5 == 0, 0.0).otherwise(1.0).alias("m")


@query(BACK + ", r(ep, k, t, ret) AS (SELECT ep, k, t, v + 0.9::DOUBLE * 0 * m FROM b WHERE k = 1 UNION ALL SELECT r.ep, b.k, b.t, b.v + 0.9::DOUBLE * ret * b.m FROM r JOIN b ON b.ep = r.ep AND b.k = r.k + 1) SELECT ep, t, ret FROM r")
def win15_discounted_return(t: Tables) -> DataFrame:
    out = scans.scanned(steps(t), "ep", -c("t"), [c("v"), mask()], scans.discounted(0.9), "back")
    return out.select("ep", (-c("back")).alias("t"), "ret")


@query(BACK + """, r(ep, k, t, value, g) AS (SELECT ep, k, t, x, v + 0.99::DOUBLE * 0.0 * m - x + 0.99::DOUBLE * 0.95::DOUBLE * m * 0.0 FROM b WHERE k = 1
UNION ALL SELECT r.ep, b.k, b.t, b.x, b.v + 0.99::DOUBLE * r.value * b.m - b.x + 0.99::DOUBLE * 0.95::DOUBLE * b.m * r.g FROM r JOIN b ON b.ep = r.ep AND b.k = r.k + 1) SELECT ep, t, round(g + value, 9) AS ret FROM r""")
def win15_gae(t: Tables) -> DataFrame:
    out = scans.scanned(steps(t), "ep", -c("t"), [c("v"), c("x"), mask()], scans.advantages(0.99, 0.95), "back")
    return out.select("ep", (-c("back")).alias("t"), F.round("ret", 9).alias("ret"))


@query("SELECT event_type, sum(value) / (SELECT count(*) FROM events)::DOUBLE AS mean FROM events GROUP BY event_type".replace("sum(value)", "sum(round(value * 1000)::BIGINT)"))
def agg6_mean_of_all(t: Tables) -> DataFrame:
    whole = t("events").withColumn("value", F.round(c("value") * 1000).cast("long"))  # whole numbers: sums don't depend on their order
    return metrics.mean_of_all(whole, "event_type", "value")


@query("SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def agg7_mean_of_having(t: Tables) -> DataFrame:
    return metrics.mean_of_having(t("events"), "event_type", "value").withColumn("mean", F.round("mean", 6))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n <= 3")
def agg8_eval_gate(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return t("events").withColumn("n", F.row_number().over(w)).filter("n <= 3").select("event_id")


@query("SELECT event_type, round(avg(value), 6) AS mean, round(2.228 * stddev_pop(value) / sqrt(count(value)), 6) AS ci FROM events GROUP BY event_type")
def agg13_mean_ci(t: Tables) -> DataFrame:
    return metrics.mean_ci(t("events"), "event_type", "value").select("event_type", F.round("mean", 6).alias("mean"), F.round("ci", 6).alias("ci"))


@query("SELECT event_type, avg(value) >= 20 AS passed FROM events GROUP BY event_type")
def agg14_threshold_gate(t: Tables) -> DataFrame:
    return t("events").groupBy("event_type").agg((F.avg("value") >= 20).alias("passed"))


@query("WITH w AS (SELECT user_id, avg(value) AS m, avg(value * value) AS q FROM events GROUP BY user_id), g AS (SELECT avg(m) AS g, avg(q) AS q FROM w) SELECT round(g, 6) AS mean, round(q - 2 * g * g + g * g, 5) AS var FROM g")
def agg15_distributed_moments(t: Tables) -> DataFrame:
    return metrics.distributed_moments(t("events"), "user_id", "value").select(F.round("mean", 6).alias("mean"), F.round("var", 5).alias("var"))


@query(STEPS + ", k AS (SELECT ep, t, v, count(*) OVER (PARTITION BY ep) AS n FROM s) SELECT ep, round(sum(CASE WHEN t = 1 THEN 1 ELSE 0.05 END::DOUBLE * power(0.95, n - t) * v), 5) AS ema FROM k GROUP BY ep")
def agg19_ema(t: Tables) -> DataFrame:
    g = steps(t).groupBy("ep").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda x: x["v"]).alias("r"))
    return g.select("ep", F.round(metrics.ema(c("r")), 5).alias("ema"))


@query("WITH v AS (SELECT vec_id, embedding AS e, embedding[vec_id % 8 + 1] AS own FROM embeddings), r AS (SELECT vec_id, 1 + len(list_filter(e[1:8], lambda x: x > own)) AS rank FROM v) SELECT vec_id, rank::BIGINT AS rank, rank = 1 AS correct FROM r")
def agg20_label_rank(t: Tables) -> DataFrame:
    return t("embeddings").select("vec_id", metrics.rank_of(F.slice("embedding", 1, 8), c("vec_id") % 8).alias("rank")).withColumn("correct", c("rank") == 1)


@query("WITH v AS (SELECT label, embedding AS e, embedding[vec_id % 8 + 1] AS own FROM embeddings), r AS (SELECT label, 1 + len(list_filter(e[1:8], lambda x: x > own)) AS rank FROM v) SELECT label, avg(rank) AS mean_rank, avg((rank = 1)::INT) AS accuracy FROM r GROUP BY label")
def agg20_accuracy(t: Tables) -> DataFrame:
    rank = metrics.rank_of(F.slice("embedding", 1, 8), c("vec_id") % 8)
    return t("embeddings").groupBy("label").agg(F.avg(rank).alias("mean_rank"), F.avg((rank == 1).cast("int")).alias("accuracy"))


@query(STEPS + " SELECT ep, arg_max(v, t) AS final, round(arg_min(v, t) - arg_max(v, t), 6) AS gained, min(v) AS least, count(*) AS n, bool_or(a = 'click') AS stopped FROM s GROUP BY ep")
def agg21_trajectory_stats(t: Tables) -> DataFrame:
    g = steps(t).groupBy("ep").agg(F.max_by("v", "t").alias("final"), F.min_by("v", "t").alias("first"), F.min("v").alias("least"), F.count(lit(1)).alias("n"), F.bool_or(c("a") == "click").alias("stopped"))
    return g.select("ep", "final", F.round(c("first") - c("final"), 6).alias("gained"), "least", "n", "stopped")


@query(STEPS + ", k AS (SELECT ep, a, count(*) AS n, max(t) AS reached FROM s WHERE a <> 'error' GROUP BY ALL) SELECT ep, a AS mode FROM k QUALIFY row_number() OVER (PARTITION BY ep ORDER BY n DESC, reached) = 1")
def agg22_mode_first_reached(t: Tables) -> DataFrame:
    k = steps(t).filter("a <> 'error'").groupBy("ep", "a").agg(F.count(lit(1)).alias("n"), F.max("t").alias("reached"))
    return k.groupBy("ep").agg(F.max_by("a", F.struct("n", -c("reached"))).alias("mode"))


@query("SELECT event_type, min(value) AS least, round(avg(value), 6) AS mean, max(value) AS most FROM events GROUP BY event_type")
def agg28_min_mean_max(t: Tables) -> DataFrame:
    return t("events").groupBy("event_type").agg(F.min("value").alias("least"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"))


@query("WITH b AS (SELECT event_type, ceil(value / 5) * 5 AS cut, count(*) AS n FROM events GROUP BY ALL), k AS (SELECT event_type, cut, sum(n) OVER (PARTITION BY event_type ORDER BY cut) AS done, sum(n) OVER (PARTITION BY event_type) AS total FROM b), f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY done::DOUBLE / cut DESC, cut) AS r FROM k WHERE done >= 0.25 * total AND cut > 0) SELECT event_type, cut::DOUBLE AS cut, done::BIGINT AS done FROM f WHERE r = 1")
def agg31_best_cut(t: Tables) -> DataFrame:
    return metrics.best_cut(t("events"), "value", 5.0, 0.25, ["event_type"]).select("event_type", c("cut").cast("double").alias("cut"), "done")


@query("SELECT event_type, count(*) AS n, (props->>'k')::BIGINT % 10 AS k FROM events GROUP BY ALL")
def flat1_props(t: Tables) -> DataFrame:
    flat = t("events").select("event_type", F.explode(F.from_json("props", "MAP<STRING, STRING>")).alias("key", "value")).filter("key = 'k'")
    return flat.groupBy("event_type", (c("value").cast("long") % 10).alias("k")).agg(F.count(lit(1)).alias("n"))


SOCIAL = STEPS + f", k AS (SELECT *, v < 20 AS found, v < 8 AND a IN ('click', 'view') AS follows, v < 8 AND NOT a IN ('click', 'view') AS backs FROM s), f AS (SELECT *, bool_or(found) {W}) AS ever FROM k)"


@query(SOCIAL + " SELECT ep, bool_or(found) AS found, coalesce(min(t) FILTER (found), 1500) AS first_step, round(count(*) FILTER (follows AND ever) / greatest(count(*) FILTER (ever), 1)::DOUBLE, 6) AS follow, round(count(*) FILTER (backs) / count(*)::DOUBLE, 6) AS backup, round(count(*) FILTER (follows) / count(*)::DOUBLE, 6) AS close, round(avg(CASE WHEN ever THEN v END), 6) AS distance, round(CASE WHEN bool_or(found) THEN 5 / greatest(5, min(t) FILTER (found))::DOUBLE ELSE 0 END, 6) AS spl FROM f GROUP BY ep")
def agg32_social_ratios(t: Tables) -> DataFrame:
    s = steps(t).withColumns({"found": c("v") < 20, "follows": (c("v") < 8) & c("a").isin("click", "view"), "backs": (c("v") < 8) & ~c("a").isin("click", "view"), "best": lit(5)})
    out = metrics.social(s, "ep", "t", "v")
    return out.select("ep", "found", "first_step", *[F.round(n, 6).alias(n) for n in ("follow", "backup", "close", "distance", "spl")])
