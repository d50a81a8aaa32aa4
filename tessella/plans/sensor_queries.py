"""Sensors, shapes, snapped places and rewards, bound to the driver's tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import patches, rewards, scans, spatial
from ..operators.lineage import cut
from ..operators.registry import Registry
from .episode_queries import STEPS, W, by, steps
from .frame_queries import POINTS, points
from .registry import Tables, query
from .world_queries import CELLS, PLACES, places, rooms

c, lit = F.col, F.lit


def here() -> Column:
    return F.array("x", "y", "z")


def about_y(angle: Column) -> Column:
    return g.quat(lit(0.0), F.sin(angle / 2), lit(0.0), F.cos(angle / 2))


def rounded(v: Column, names: str) -> list[Column]:
    return [F.round(g.at(v, i), 6).alias(n) for i, n in enumerate(names.split())]


QUARTER = math.pi / 2


@query(POINTS + " SELECT id, round(z + 1, 6) AS wx, round(y, 6) AS wy, round(2 - x, 6) AS wz FROM v")
def geo2_world_frame(t: Tables) -> DataFrame:
    world = g.to_world(here(), F.array(lit(1.0), lit(0.0), lit(2.0)), about_y(lit(QUARTER)))
    return points(t).select("id", *rounded(world, "wx wy wz"))


@query(POINTS + " SELECT id, round(sqrt(x * x + z * z), 6) AS rho, round(-atan2(x, -z), 6) AS phi, round(sqrt(x * x + y * y + z * z), 6) AS far, round(acos(y / sqrt(x * x + y * y + z * z)), 6) AS theta FROM v")
def geo5_point_goal(t: Tables) -> DataFrame:
    rho, phi = g.point_goal(here())
    return points(t).select("id", F.round(rho, 6).alias("rho"), F.round(phi, 6).alias("phi"), F.round(g.at(g.point_goal_3d(here()), 0), 6).alias("far"), F.round(g.at(g.point_goal_3d(here()), 2), 6).alias("theta"))


@query(POINTS + ", a AS (SELECT *, id % 5 * pi() / 4 - pi() / 2 AS a FROM v) SELECT id, round(atan2(-sin(a), cos(a)), 6) + 0 AS compass, round(1 - x, 6) AS ahead, round(2 - z, 6) AS aside FROM a")
def geo6_compass_gps(t: Tables) -> DataFrame:
    start = about_y(lit(QUARTER))
    compass = g.episodic_compass(about_y(c("id") % 5 * (math.pi / 4)), start)
    return points(t).select("id", (F.round(compass, 6) + 0).alias("compass"), *rounded(g.episodic_gps(here(), F.array(lit(1.0), lit(0.0), lit(2.0)), start), "ahead aside"))


@query(POINTS + " SELECT id, round(x - 1, 6) AS x0, round(y - 2, 6) AS y0, round(z - 1, 6) AS z0, round(x + 1, 6) AS x1, round(y + 2, 6) AS y1, round(z + 1, 6) AS z1 FROM v")
def geo7_turned_box(t: Tables) -> DataFrame:
    h = 0.5**0.5
    low, high = g.box_bounds(here(), F.array(lit(2.0), lit(1.0), lit(1.0)), g.quat(lit(0.0), lit(0.0), lit(h), lit(h)))
    return points(t).select("id", *rounded(low, "x0 y0 z0"), *rounded(high, "x1 y1 z1"))


@query("WITH k AS (SELECT n_nationkey AS region, c_custkey AS id, c_custkey * 37 % 1000 / 10.0::DOUBLE - (n_nationkey * 17 % 100 + 0.05) AS dx, c_custkey * 91 % 1000 / 10.0::DOUBLE - n_nationkey * 29 % 100 AS dz FROM nation, customer) SELECT region, id FROM k WHERE dx BETWEEN 0 AND 20 AND abs(dz) < dx")
def geo9_in_polygon(t: Tables) -> DataFrame:
    u, v = c("n_nationkey") * 17 % 100 + lit(0.05), (c("n_nationkey") * 29 % 100).cast("double")
    loop = F.array(F.array(u, v), F.array(u + 20, v - 20), F.array(u + 20, v + 20))
    wedges = t("nation").select(c("n_nationkey").alias("region"), loop.alias("loop"), u.alias("x0"), (u + 20).alias("x1"), (v - 20).alias("z0"), (v + 20).alias("z1"), lit(-1.0).alias("y0"), lit(9.0).alias("y1"))
    return spatial.in_regions(places(t), wedges, 10.0).select("region", "id")


@query()
def geo11_hulls(t: Tables) -> DataFrame:
    return spatial.hulls(points(t).select("frame", c("x").alias("u"), c("z").alias("v")), "frame")


EDGE = "sqrt(greatest(0, least(1, {t})) ^ 2 * 0 + (x - ({ax} + greatest(0, least(1, {t})) * {bx})) ^ 2 + y ^ 2 + (z - ({az} + greatest(0, least(1, {t})) * {bz})) ^ 2)"
EDGES3 = ", ".join([EDGE.format(t="x", ax=0, bx=1, az=0, bz=0), EDGE.format(t="z", ax=0, bx=0, az=0, bz=1), EDGE.format(t="((1 - x) + z) / 2", ax=1, bx=-1, az=0, bz=1)])


@query(POINTS + f" SELECT id, round(CASE WHEN x >= 0 AND z >= 0 AND x + z <= 1 THEN abs(y) ELSE least({EDGES3}) END, 5) AS distance FROM v")
def geo13_triangle_distance(t: Tables) -> DataFrame:
    corner = lambda x, z: F.array(lit(float(x)), lit(0.0), lit(float(z)))
    return points(t).select("id", F.round(g.triangle_distance(here(), corner(0, 0), corner(1, 0), corner(0, 1)), 5).alias("distance"))


def boxes(t: Tables) -> DataFrame:
    """Places as upright boxes."""
    k = c("id") % 4
    return places(t).withColumns({"hx": 0.2 + k * 0.3, "hy": lit(0.5), "hz": 0.8 - k * 0.2})


BOXES = PLACES + """, b AS (SELECT *, 0.2 + id % 4 * 0.3::DOUBLE AS hx, 0.5::DOUBLE AS hy, 0.8 - id % 4 * 0.2::DOUBLE AS hz FROM p),
k AS (SELECT a.id AS i, b.id AS j, a.y AS ya, b.y AS yb, a.x - b.x AS dx, a.z - b.z AS dz, sqrt((a.x - b.x) ^ 2 + (a.z - b.z) ^ 2) AS d, a.hx AS ahx, a.hz AS ahz, b.hx AS bhx, b.hz AS bhz FROM b a JOIN b ON a.id < b.id AND abs(a.x - b.x) <= 4 AND abs(a.z - b.z) <= 4),
s AS (SELECT *, greatest(0, d - sqrt((dx / d * ahx) ^ 2 + (dz / d * ahz) ^ 2) - sqrt((dx / d * bhx) ^ 2 + (dz / d * bhz) ^ 2)) AS gap FROM k WHERE d <= 4 AND d > 0)"""


def box_pairs(t: Tables, measure: Callable[..., Column], kept: str) -> DataFrame:
    """m, the `measure` of two boxes, once for each two different ones that are near, then for all rows that have them where m is `kept`."""
    still = g.quat(lit(0.0), lit(0.0), lit(0.0), lit(1.0))
    own, rows = spatial.placed(boxes(t), ("x", "y", "z", "hx", "hy", "hz"))
    pairs = spatial.within(own, own, 4.0, ("x", "z"))
    side = lambda s: (F.array(f"{s}_x", f"{s}_y", f"{s}_z"), F.array(f"{s}_hx", f"{s}_hy", f"{s}_hz"), still)
    pairs = cut(pairs.select("a_at", "b_at", measure(*side("a"), *side("b")).alias("m")))
    return spatial.expanded(pairs.filter(kept), rows, rows, "id").filter("a_id < b_id")


@query(BOXES + " SELECT i, j, round(gap, 6) AS gap FROM s")
def geo14_box_gap(t: Tables) -> DataFrame:
    return box_pairs(t, lambda *boxes: F.round(g.box_gap(*boxes, 1), 6), "m IS NOT NULL").select(c("a_id").alias("i"), c("b_id").alias("j"), c("m").alias("gap"))


@query(BOXES + " SELECT i, j FROM s WHERE gap <= 2.0 AND abs(ya - yb) <= 1.1")
def join23_next_to(t: Tables) -> DataFrame:
    return box_pairs(t, lambda *boxes: g.next_to(*boxes, 2.0), "m").select(c("a_id").alias("i"), c("b_id").alias("j"))


@query("SELECT p_partkey, j AS i, round(p_size * (j // 4 + (j % 4) / 3.0::DOUBLE), 6) AS x FROM part, unnest(range(8)) AS u(j)")
def geo16_smooth_path(t: Tables) -> DataFrame:
    s = c("p_size").cast("double")
    path = F.array(*[F.array(s * k, lit(0.0), lit(0.0)) for k in (0, 1, 2)])
    return t("part").select("p_partkey", F.posexplode(g.smooth(path, 4)).alias("i", "p")).select("p_partkey", c("i").cast("long").alias("i"), F.round(F.get("p", lit(0)), 6).alias("x"))


COVER = """WITH r AS (SELECT c_custkey AS ray, c_custkey // 30 AS tx, c_custkey % 30 AS ty, abs(c_custkey // 30 - 9) AS dx, abs(c_custkey % 30 - 11) AS dy, CASE WHEN c_custkey // 30 < 9 THEN -1 ELSE 1 END AS sx, CASE WHEN c_custkey % 30 < 11 THEN -1 ELSE 1 END AS sy FROM customer),
i AS (SELECT *, unnest(range(dx + 1)) AS i FROM r),
j AS (SELECT *, unnest(range(greatest(0, CASE WHEN dx = 0 THEN 0 ELSE ceil(((2 * i - 1) * dy - dx) / (2.0::DOUBLE * dx)) END)::BIGINT, least(dy, CASE WHEN dx = 0 THEN dy ELSE floor(((2 * i + 1) * dy + dx) / (2.0::DOUBLE * dx)) END)::BIGINT + 1)) AS j FROM i),
l AS (SELECT ray, row_number() OVER (PARTITION BY ray ORDER BY i, j) - 1 AS step, 9 + sx * i AS x, 11 + sy * j AS y FROM j)"""


def rays(t: Tables) -> DataFrame:
    k = c("c_custkey")
    return t("customer").select(k.alias("ray"), lit(9).alias("x0"), lit(11).alias("y0"), F.floor(k / 30).alias("x1"), (k % 30).alias("y1"))


def spread(df: DataFrame) -> DataFrame:
    """Dealt to as many tasks as there are shuffle partitions: a file of narrow rows is one task, whatever each row becomes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ray")


@query(COVER + " SELECT ray, step, x, y FROM l")
def geo19_supercover(t: Tables) -> DataFrame:
    return spatial.crossed(spread(rays(t)), packed=True).select("ray", "step", c("x").cast("long").alias("x"), c("y").cast("long").alias("y"))


@query(COVER + ", m AS (SELECT c_custkey // 30 AS x, c_custkey % 30 AS y, c_custkey * 13 % 7 > 1 AS open FROM customer), k AS (SELECT l.*, coalesce(open, false) AS open FROM l LEFT JOIN m USING (x, y)), s AS (SELECT ray, min(step) AS stop FROM k WHERE NOT open GROUP BY ray) SELECT DISTINCT x, y FROM k LEFT JOIN s USING (ray) WHERE stop IS NULL OR step < stop")
def geo19_seen_cells(t: Tables) -> DataFrame:
    k = c("c_custkey")
    cells = t("customer").select(F.floor(k / 30).alias("x"), (k % 30).cast("long").alias("y"), (k * 13 % 7 > 1).alias("open"))
    return spatial.seen(spread(rays(t)), cells).select(c("x").cast("long").alias("x"), c("y").cast("long").alias("y"))


LINKED = """, links AS (SELECT a.i AS a, b.i AS b FROM g a JOIN g b ON abs(a.r - b.r) + abs(a.c - b.c) = 1 AND a.v = b.v),
reach(i, j) AS (SELECT i, i FROM g UNION SELECT reach.i, links.b FROM reach JOIN links ON links.a = reach.j), tops AS (SELECT i, min(j) AS first FROM reach GROUP BY i)"""
RASTER = PLACES.split("h AS")[0].rstrip().rstrip(",") + """, o AS (SELECT floor(min(u - 12) / 2)::BIGINT AS c0, floor(max(u + 12) / 2)::BIGINT AS c1, floor(min(v - 10) / 2)::BIGINT AS r0, floor(max(v + 10) / 2)::BIGINT AS r1 FROM r),
k AS (SELECT unnest(range(r0, r1 + 1)) AS row, c0, c1 FROM o), n AS (SELECT row, unnest(range(c0, c1 + 1)) AS col FROM k), m AS (SELECT row, col, (col + 0.5) * 2::DOUBLE AS x, (row + 0.5) * 2::DOUBLE AS z FROM n),
h AS (SELECT row, col, region FROM m JOIN e ON x BETWEEN u - 12 AND u + 12 AND z BETWEEN v - 10 AND v + 10 GROUP BY row, col, region HAVING sum(((av > z) <> (bv > z) AND x < (bu - au) * (z - av) / nullif(bv - av, 0) + au)::INT) % 2 = 1), w AS (SELECT row, col, min(region) AS region FROM h GROUP BY row, col)"""


@query(RASTER + " SELECT row, col, region FROM w")
def geo20_raster(t: Tables) -> DataFrame:
    return spatial.raster(rooms(t), 2.0, 1.0).select("row", "col", "region")


@query(("WITH RECURSIVE " + RASTER.removeprefix("WITH ") + ", g AS (SELECT row * 100000 + col AS i, row AS r, col AS c, 1 AS v FROM w)" + LINKED) + " SELECT r AS row, c AS col, first AS island FROM g JOIN tops USING (i)")
def geo20_islands(t: Tables) -> DataFrame:
    cells = spatial.raster(rooms(t), 2.0, 1.0).withColumn("colour", lit(1))
    return patches.coloured(cells, 16).select("row", "col", (c("patch_row") * 100000 + c("patch_col")).alias("island"))


@query(PLACES + " SELECT id, y - 0.5 >= 0 AND y - 0.5 < 1.5 AS here FROM p")
def geo21_floor_band(t: Tables) -> DataFrame:
    return places(t).select("id", g.on_floor(c("y"), lit(0.5), 1.5).alias("here"))


@query(POINTS + " SELECT id, round(CASE WHEN z < 0 THEN 1 ELSE -1 END * acos(greatest(-1, least(1, x / sqrt(x * x + z * z)))), 5) AS turn, round(acos(greatest(-1, least(1, -(z - 2) / sqrt((x - 1) ^ 2 + y ^ 2 + (z - 2) ^ 2)))), 5) AS off FROM v")
def geo22_angles(t: Tables) -> DataFrame:
    still, ahead = g.quat(lit(0.0), lit(0.0), lit(0.0), lit(1.0)), F.array(lit(0.0), lit(0.0), lit(-1.0))
    off = g.camera_angle(here(), F.array(lit(1.0), lit(0.0), lit(2.0)), still, ahead)
    return points(t).select("id", F.round(g.angle_to(here()), 5).alias("turn"), F.round(off, 5).alias("off"))


OWN = Registry()


@OWN.register("sensor")
def object_to_goal(goal: tuple[float, float, float]) -> Column:
    """Distance of the state's object from its goal."""
    return g.distance(here(), F.array(*[lit(v) for v in goal]))


@OWN.register("sensor")
def relative_goal(goal: tuple[float, float, float]) -> Column:
    """The goal in the frame of an agent at the state's place, turned a quarter about the vertical."""
    return F.transform(g.to_local(F.array(*[lit(v) for v in goal]), here(), about_y(lit(QUARTER))), lambda v: F.round(v, 6))


@OWN.register("sensor")
def polar_goal(goal: tuple[float, float, float]) -> Column:
    rho, phi = g.point_goal(g.to_local(F.array(*[lit(v) for v in goal]), here(), g.quat(lit(0.0), lit(0.0), lit(0.0), lit(1.0))))
    return F.array(rho, phi)


@query(POINTS + " SELECT id, round(sqrt((x - 1) ^ 2 + y ^ 2 + (z - 2) ^ 2), 6) AS object_to_goal, round(z - 2, 6) + 0 AS gx, round(-y, 6) + 0 AS gy, round(1 - x, 6) + 0 AS gz, round(sqrt((1 - x) ^ 2 + (2 - z) ^ 2), 6) AS rho, round(-atan2(1 - x, z - 2), 6) AS phi FROM v")
def geo25_goal_sensors(t: Tables) -> DataFrame:
    out = OWN.observed(points(t), ["object_to_goal", "relative_goal", "polar_goal"], goal=(1.0, 0.0, 2.0))
    place = [(F.round(g.at(c("relative_goal"), i), 6) + 0).alias(n) for i, n in enumerate(("gx", "gy", "gz"))]
    return out.select("id", F.round("object_to_goal", 6).alias("object_to_goal"), *place, *rounded(c("polar_goal"), "rho phi"))


@query(POINTS + " SELECT id, x * x / 4 + y * y / 1 < 1 AS near, sqrt(x * x + y * y) <= 3 AND coalesce(acos(greatest(-1, least(1, x / nullif(sqrt(x * x + y * y), 0)))) <= 1, false) AS there, round((1 * (x - 1) + 0 * (z - 2)) / nullif(sqrt((x - 1) ^ 2 + (z - 2) ^ 2), 0), 6) AS facing FROM v")
def geo26_agents(t: Tables) -> DataFrame:
    still, robot = g.quat(lit(0.0), lit(0.0), lit(0.0), lit(1.0)), F.array(lit(1.0), lit(0.0), lit(2.0))
    return points(t).select("id", g.within_ellipse(here(), 2.0, 1.0).alias("near"), g.robot_at(here(), 3.0, 1.0).alias("there"), F.round(g.facing(robot, here(), still), 6).alias("facing"))


@query("SELECT c_custkey AS vertex, CASE WHEN c_custkey % 30 < 25 THEN c_custkey % 30 + 1 ELSE 0 END AS object, CASE WHEN c_custkey % 30 < 25 THEN n_regionkey ELSE -1 END::BIGINT AS region FROM customer LEFT JOIN nation ON n_nationkey = c_custkey % 30")
def join4_by_colour(t: Tables) -> DataFrame:
    vertices = t("customer").select(c("c_custkey").alias("vertex"), (c("c_custkey") % 30 * 1000).alias("colour"))
    objects = t("nation").select((c("n_nationkey") + 1).alias("object"), c("n_regionkey").cast("long").alias("region"), (c("n_nationkey") * 1000).alias("colour"))
    return spatial.by_colour(vertices, objects).select("vertex", c("object").cast("long").alias("object"), "region")


SNAPS = PLACES + """, w AS (SELECT s_suppkey AS vertex, s_suppkey * 53 % 1000 / 10.0::DOUBLE AS x, (s_suppkey % 3)::DOUBLE AS y, s_suppkey * 29 % 1000 / 10.0::DOUBLE AS z FROM supplier),
d AS (SELECT p.*, vertex, w.x AS sx, w.y AS sy, w.z AS sz, sqrt((p.x - w.x) ^ 2 + (p.y - w.y) ^ 2 + (p.z - w.z) ^ 2) AS distance FROM p JOIN w ON abs(p.x - w.x) <= 8 AND abs(p.z - w.z) <= 8),
s AS (SELECT * FROM d WHERE distance <= 8 QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, vertex) = 1)"""


def mesh(t: Tables) -> DataFrame:
    k = c("s_suppkey")
    return t("supplier").select(k.alias("vertex"), (k * 53 % 1000 / lit(10.0)).alias("x"), (k % 3).cast("double").alias("y"), (k * 29 % 1000 / lit(10.0)).alias("z"))


@query(SNAPS + " SELECT id, vertex, sx AS snap_x, sy AS snap_y, sz AS snap_z, round(distance, 6) AS distance FROM s")
def join9_snapped(t: Tables) -> DataFrame:
    return spatial.snapped(places(t), mesh(t), 8.0).withColumn("distance", F.round("distance", 6))


@query(SNAPS + " SELECT id FROM s WHERE abs(y - sy) <= 1 AND sqrt((x - sx) ^ 2 + (z - sz) ^ 2) <= 4")
def flt17_navigable(t: Tables) -> DataFrame:
    return spatial.navigable(places(t), spatial.snapped(places(t), mesh(t), 8.0), 1.0, 4.0).select("id")


@query(PLACES + """, o AS (SELECT *, id % 9 AS support, id % 5 * 0.05::DOUBLE AS gap FROM p), w AS (SELECT s_name AS name, s_suppkey % 6 AS support, s_suppkey * 53 % 1000 / 10.0::DOUBLE AS x, (s_suppkey % 3)::DOUBLE AS y, s_suppkey * 29 % 1000 / 10.0::DOUBLE AS z FROM supplier),
d AS (SELECT id, name, sqrt((o.x - w.x) ^ 2 + (o.y - w.y) ^ 2 + (o.z - w.z) ^ 2) AS d FROM o JOIN w USING (support)), m AS (SELECT id, name, d, min(d) OVER (PARTITION BY id) AS least FROM d WHERE d < 15),
n AS (SELECT id, string_agg(DISTINCT name, ',' ORDER BY name) AS names, count(DISTINCT name) AS n FROM m WHERE d <= least + 1 GROUP BY id), g AS (SELECT id, arg_min(region, (region % 3 + 1) * 1000 + region) AS region FROM h GROUP BY id)
SELECT o.id, CASE WHEN names IS NOT NULL THEN names WHEN support >= 6 AND gap < 0.15 THEN 'floor,' || coalesce(region::VARCHAR, 'unknown_region') ELSE region::VARCHAR END AS place, CASE WHEN n IS NOT NULL THEN 1.0::DOUBLE / n ELSE 1 END AS confidence FROM o LEFT JOIN n ON o.id = n.id LEFT JOIN g ON o.id = g.id""")
def join11_placement_cascade(t: Tables) -> DataFrame:
    objects = places(t).withColumns({"support": c("id") % 9, "floor_gap": c("id") % 5 * lit(0.05)})
    receptacles = mesh(t).join(t("supplier").select(c("s_suppkey").alias("vertex"), c("s_name").alias("name")), "vertex").withColumn("support", c("vertex") % 6)
    regions = rooms(t).withColumn("area", (c("region") % 3 + 1).cast("double"))
    return spatial.placement(objects, receptacles, regions, 10.0, 15.0, 1.0)


CONTACTS = "WITH k AS (SELECT user_id % 100 AS a, event_id % 3 AS la, event_id % 100 AS b, event_id % 4 AS lb, value / 25 - 1 AS up FROM events), o AS (SELECT DISTINCT user_id % 100 AS object, CASE WHEN user_id % 2 = 0 THEN user_id % 3 END AS link FROM events)"


@query(CONTACTS + ", s AS (SELECT a AS o, la AS l, b AS other, -up AS up FROM k UNION ALL SELECT b, lb, a, up FROM k) SELECT DISTINCT object, other FROM o JOIN s ON o.object = s.o AND (link IS NULL OR link = l) AND up > 0.75")
def join17_contact_pairs(t: Tables) -> DataFrame:
    e, u = t("events"), c("user_id")
    pairs = e.select((u % 100).alias("a"), (c("event_id") % 3).alias("link_a"), (c("event_id") % 100).alias("b"), (c("event_id") % 4).alias("link_b"), (c("value") / 25 - 1).alias("up"))
    objects = e.select((u % 100).alias("object"), F.when(u % 2 == 0, u % 3).alias("link")).distinct()
    return spatial.contacts(objects, pairs)


@query("SELECT c_custkey AS id, c_name AS handle, c_custkey AS parent FROM customer UNION ALL SELECT 1000000 + s_suppkey * 10, s_name, 1000000 + s_suppkey * 10 FROM supplier UNION ALL SELECT 1000000 + s_suppkey * 10 + 1 + i, s_name || ' -- ' || i, 1000000 + s_suppkey * 10 FROM supplier, unnest(range(3)) AS u(i) WHERE i < s_suppkey % 4")
def join26_id_catalogue(t: Tables) -> DataFrame:
    rigid = t("customer").select(c("c_custkey").cast("long").alias("id"), c("c_name").alias("handle"))
    own = (1000000 + c("s_suppkey") * 10).cast("long")
    links = F.filter(F.array(*[own + 1 + i for i in range(3)]), lambda x: x - own <= c("s_suppkey") % 4)
    return spatial.id_catalogue(rigid, t("supplier").select(own.alias("id"), c("s_name").alias("handle"), links.alias("links")))


@query("SELECT conv_id, turn, coalesce(u.slot, 0) AS slot, u.slot IS NULL AS unknown FROM conversations LEFT JOIN (SELECT user_id, user_id % 8 + 1 AS slot FROM events GROUP BY user_id) u ON conv_id * 3 = user_id")
def join20_connection_user(t: Tables) -> DataFrame:
    slots = t("events").select("user_id", (c("user_id") % 8 + 1).alias("slot")).distinct()
    return t("conversations").join(slots, c("conv_id") * 3 == c("user_id"), "left").select("conv_id", "turn", F.coalesce("slot", lit(0)).alias("slot"), c("slot").isNull().alias("unknown"))


@query("""WITH x AS (SELECT event_id // 50 AS frame, event_id % 7 AS instance, event_id * 13 % 40 AS x, event_id * 7 % 30 AS y FROM events), i AS (SELECT n_nationkey AS instance, n_name FROM nation WHERE n_nationkey < 7 AND n_nationkey % 3 < 2),
b AS (SELECT frame, instance, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM x SEMI JOIN i USING (instance) GROUP BY ALL), n AS (SELECT b.frame, b.instance, count(*) AS n FROM x JOIN b ON x.frame = b.frame AND x.instance = b.instance AND x < x1 AND y < y1 GROUP BY ALL)
SELECT frame, instance, n, x0, y0, x1, y1 FROM b JOIN n USING (frame, instance) WHERE x1 - x0 >= 2 AND y1 - y0 >= 1.5 AND n >= 0.01 * ((x1 - x0) * (y1 - y0))""")
def flt18_boxes_kept(t: Tables) -> DataFrame:
    k = c("event_id")
    pixels = t("events").select(F.floor(k / 50).alias("frame"), (k % 7).alias("instance"), (k * 13 % 40).alias("x"), (k * 7 % 30).alias("y"))
    names = t("nation").filter("n_nationkey < 7").select(c("n_nationkey").alias("instance"), F.when(c("n_nationkey") % 3 < 2, "chair").otherwise("wall").alias("name"))
    return spatial.boxes_kept(pixels, names, ["chair"], 40, 30, 0.01)


@query(STEPS + f", k AS (SELECT *, lag(v) {W}) AS p, lag(y) {W}) AS q FROM s), a AS (SELECT *, last_value(CASE WHEN v < 20 THEN y END IGNORE NULLS) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM k) SELECT id, round(2.0::DOUBLE * coalesce(p - v, 0) + CASE WHEN v < 20 THEN 0.5 * coalesce(last - y, 0) ELSE 0 END, 6) AS walk, round(coalesce(p - v, 0), 6) AS reach FROM a")
def win13_walk_reward(t: Tables) -> DataFrame:
    w = by()
    walk = rewards.navigation(c("v"), w, 2.0, c("y"), 0.5, 20.0)
    return steps(t).select("id", F.round(walk, 6).alias("walk"), F.round(rewards.reach(c("v"), w), 6).alias("reach"))


#: The pick machine with its state handed from step to step; grips: 1 the target, 2 another thing, 0 nothing.
PICK = STEPS.replace("WITH s", "WITH RECURSIVE s") + """, h AS (SELECT *, CASE WHEN a = 'click' THEN 1 WHEN a = 'view' AND id % 3 = 0 THEN 2 ELSE 0 END AS grip FROM s),
r(ep, t, id, had, cur, reward) AS (SELECT ep, 0::BIGINT, NULL::BIGINT, false, -1.0::DOUBLE, 0.0::DOUBLE FROM h GROUP BY ep
UNION ALL SELECT h.ep, h.t, h.id, grip > 0, CASE WHEN grip = 2 AND NOT had THEN -1 WHEN grip = 0 AND had THEN -1 ELSE d END,
  CASE WHEN grip = 2 AND NOT had THEN -5 ELSE CASE WHEN grip = 1 AND NOT had THEN 10 ELSE 0 END + 2.0::DOUBLE * round(CASE WHEN (grip = 1 AND NOT had) OR cur < 0 THEN 0 ELSE cur - d END, 3) - CASE WHEN grip = 0 AND had THEN 3 ELSE 0 END END
FROM (SELECT h.*, CASE WHEN grip > 0 THEN y ELSE v END AS d FROM h) h JOIN r ON r.ep = h.ep AND h.t = r.t + 1)"""


@query(PICK + " SELECT id, round(reward, 5) AS reward FROM r WHERE id IS NOT NULL")
def win13_pick_reward(t: Tables) -> DataFrame:
    held = F.when(c("a") == "click", 1).when((c("a") == "view") & (c("id") % 3 == 0), 2)
    s = steps(t).withColumns({"held": held, "target": lit(1)})
    return s.select("id", F.round(rewards.picking(c("v"), c("y"), c("held"), c("target"), by(), 10.0, 5.0, 3.0, 2.0), 5).alias("reward"))


#: The place machine with its state handed from step to step.
PLACE = STEPS.replace("WITH s", "WITH RECURSIVE s") + """, h AS (SELECT *, a = 'click' AS has, id % 3 = 0 AS here, CASE WHEN NOT (id % 3 = 0) OR a = 'click' THEN v ELSE y END AS d FROM s),
r(ep, t, id, dropped, cur, reward) AS (SELECT ep, 0::BIGINT, NULL::BIGINT, false, -1.0::DOUBLE, 0.0::DOUBLE FROM h GROUP BY ep
UNION ALL SELECT h.ep, h.t, h.id, dropped OR NOT has, d, CASE WHEN NOT dropped AND NOT has THEN CASE WHEN here THEN 10 ELSE -3 END ELSE 0 END
  + CASE WHEN d >= CASE WHEN NOT here OR has THEN 2 ELSE 0 END THEN 2.0::DOUBLE * round(CASE WHEN cur < 0 OR (NOT dropped AND NOT has AND here) THEN 0 ELSE cur - d END, 3) ELSE 0 END
FROM h JOIN r ON r.ep = h.ep AND h.t = r.t + 1)"""


@query(PLACE + " SELECT id, round(reward, 5) AS reward FROM r WHERE id IS NOT NULL")
def win13_place_reward(t: Tables) -> DataFrame:
    has, here = c("a") == "click", c("id") % 3 == 0
    s = steps(t).withColumns({"has": has, "here": here})
    return s.select("id", F.round(rewards.placing(c("v"), c("y"), c("has"), c("here"), by(), 10.0, 3.0, 2.0, 2.0), 5).alias("reward"))


#: The joint's machine with its state handed from step to step.
JOINT = STEPS.replace("WITH s", "WITH RECURSIVE s") + """, h AS (SELECT *, y / 16 AS st, (a = 'click')::INT AS g, (id % 3 = 0)::INT AS ok, (y >= 13)::INT AS th FROM s),
r(ep, t, id, st, g, pm, pr, th, reward) AS (SELECT ep, t, id, st, g, v, x, th, CASE WHEN th = 1 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END FROM h WHERE t = 1
UNION ALL SELECT h.ep, h.t, h.id, h.st, greatest(r.g, h.g), h.v, h.x, greatest(r.th, h.th), CASE WHEN h.th = 0 THEN 2.0::DOUBLE * (abs(r.st - 1) - abs(h.st - 1)) ELSE 0 END
  + CASE WHEN h.g = 1 AND r.g = 0 THEN CASE WHEN ok = 1 THEN 10 ELSE -5 END ELSE 0 END
  + CASE WHEN h.th = 1 THEN CASE WHEN r.th = 0 THEN 3 ELSE 0 END + 0.5::DOUBLE * (pr - h.x) WHEN h.g = 0 THEN 0.25::DOUBLE * (pm - h.v) ELSE 0 END
FROM h JOIN r ON r.ep = h.ep AND h.t = r.t + 1)"""


@query(JOINT + " SELECT ep, t, round(reward, 5) + 0.0::DOUBLE AS reward FROM r")
def win13_joint_reward(t: Tables) -> DataFrame:
    flag = lambda x: x.cast("int")
    fold = rewards.articulated(1.0, 2.0, 10.0, 5.0, 3.0, 0.5, 0.25)
    values = [c("y") / 16, flag(c("a") == "click"), flag(c("id") % 3 == 0), c("v"), c("x"), flag(c("y") >= 13)]
    out = scans.scanned(steps(t), "ep", c("t"), values, fold, "t")
    return out.select("ep", "t", (F.round("reward", 5) + 0.0).alias("reward"))


#: Two objects in turn, with the stage handed from step to step.
MOVING = STEPS.replace("WITH s", "WITH RECURSIVE s") + """, h AS (SELECT *, CASE a WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE -1 END AS held FROM s),
r(ep, t, id, stage, pg, po, ph, given, reward) AS (SELECT ep, 0::BIGINT, NULL::BIGINT, 0, NULL::DOUBLE, NULL::DOUBLE, false, 0, 0.0::DOUBLE FROM h GROUP BY ep
UNION ALL SELECT ep, t, id, nxt, CASE nxt WHEN 0 THEN y ELSE z END, CASE nxt WHEN 0 THEN v ELSE x END, hold, CASE WHEN picked THEN given | (1 << stage) ELSE given END, 2.0::DOUBLE * CASE WHEN hold THEN coalesce(pg, g) - g ELSE coalesce(po, o) - o END + CASE WHEN picked THEN 4 ELSE 0 END + CASE WHEN g < 2 AND NOT hold THEN 6 ELSE 0 END
FROM (SELECT *, hold AND NOT ph AND (given >> stage) & 1 = 0 AS picked, CASE WHEN g < 2 AND NOT hold THEN 1 - stage ELSE stage END AS nxt
  FROM (SELECT h.*, stage, pg, po, ph, given, CASE stage WHEN 0 THEN y ELSE z END AS g, CASE stage WHEN 0 THEN v ELSE x END AS o, held = stage AS hold FROM h JOIN r ON r.ep = h.ep AND h.t = r.t + 1)))"""


@query(MOVING + " SELECT ep, t, round(reward, 5) + 0.0::DOUBLE AS reward FROM r WHERE id IS NOT NULL")
def win13_moving_reward(t: Tables) -> DataFrame:
    held = F.when(c("a") == "click", 0).when(c("a") == "view", 1).otherwise(-1)
    out = scans.scanned(steps(t), "ep", c("t"), [held, c("y"), c("z"), c("v"), c("x")], rewards.moving(2, 2.0, 4.0, 6.0, 2.0), "t")
    return out.select("ep", "t", (F.round("reward", 5) + 0.0).alias("reward"))


@OWN.register("transformer")
def halved(df: DataFrame) -> DataFrame:
    return df.withColumns({a: c(a) / 2 for a in "xyz"})


@OWN.register("transformer")
def with_length(df: DataFrame) -> DataFrame:
    return df.withColumn("length", F.sqrt(c("x") * c("x") + c("y") * c("y") + c("z") * c("z")))


@OWN.register("predicate")
def on_ground(height: float) -> Column:
    return c("y") <= height


@OWN.register("generator")
def episodes_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Two episodes for each place."""
    for pdf in frames:
        for i in (0, 1):
            yield pd.DataFrame({"episode": pdf["id"] * 2 + i, "goal": pdf["x"] + i})


@query(POINTS + " SELECT id, x, y, z, round(sqrt(x * x + y * y + z * z) / 2, 6) AS length FROM v")
def udf3_sensor_udf4_transformer(t: Tables) -> DataFrame:
    out = OWN.transformed(points(t).withColumns({f"_{a}": c(a) for a in "xyz"}), ["halved", "with_length"])
    return out.select("id", *[c(f"_{a}").alias(a) for a in "xyz"], F.round("length", 6).alias("length"))


@query(POINTS + " SELECT id FROM v WHERE y <= 0.25")
def udf5_predicate(t: Tables) -> DataFrame:
    return OWN.valid(points(t), "on_ground", height=0.25).select("id")


@query(POINTS + " SELECT id * 2 + i AS episode, x + i AS goal FROM v, unnest([0, 1]) AS u(i)")
def udf8_generator(t: Tables) -> DataFrame:
    return OWN.generated(points(t).select("id", "x"), "episodes_of", "episode long, goal double")


@query("WITH RECURSIVE g AS (SELECT c_custkey AS i, c_custkey // 30 AS r, c_custkey % 30 AS c, c_custkey * 13 % 7 < 3 AS v FROM customer)" + LINKED + " SELECT first // 30 AS patch_row, first % 30 AS patch_col, any_value(v) AS colour, count(*) AS n, min(r) AS row0, max(r) AS row1, min(c) AS col0, max(c) AS col1 FROM g JOIN tops USING (i) GROUP BY first")
def gra2_coloured_patches(t: Tables) -> DataFrame:
    k = c("c_custkey")
    cells = t("customer").select(F.floor(k / 30).alias("row"), (k % 30).alias("col"), (k * 13 % 7 < 3).alias("colour"))
    return patches.measured(patches.coloured(cells, 16))


@query("""WITH RECURSIVE v AS (SELECT p_partkey AS i, p_partkey % 3 AS colour, (p_partkey * 7 % 100)::DOUBLE AS x, p_size::DOUBLE AS y, (p_partkey * 3 % 90)::DOUBLE AS z FROM part), e AS (SELECT i AS a, i + 3 * (i % 5) AS b FROM v WHERE i % 9 > 1 UNION ALL SELECT i, i * 2 FROM v UNION ALL SELECT i, i + 1 FROM v),
l AS (SELECT a, b FROM e JOIN v x ON x.i = a JOIN v y ON y.i = b WHERE x.colour = y.colour AND a <> b), s AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
q(i, j) AS (SELECT i, i FROM v UNION SELECT q.i, s.b FROM q JOIN s ON s.a = q.j), m AS (SELECT i, min(j) AS component FROM q GROUP BY i)
SELECT component, any_value(colour) AS colour, count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM v JOIN m USING (i) GROUP BY component""")
def gra2_mesh_components(t: Tables) -> DataFrame:
    k = c("p_partkey")
    vertices = t("part").select(k.alias("vertex"), (k % 3).alias("colour"), (k * 7 % 100).cast("double").alias("x"), c("p_size").cast("double").alias("y"), (k * 3 % 90).cast("double").alias("z"))
    edges = t("part").select(k.alias("src"), F.explode(F.array(F.when(k % 9 > 1, k + 3 * (k % 5)), k * 2, k + 1)).alias("dst")).filter("dst IS NOT NULL")
    return patches.on_mesh(vertices, edges)


@query("SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS nth FROM events")
def srt5_hits_by_distance(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("value", "event_id")
    return t("events").select("user_id", "event_id", "value", F.row_number().over(w).cast("long").alias("nth"))
