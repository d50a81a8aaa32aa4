"""Meshes, random places, episodes and noise, bound to the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import DIGITS, TRIES
from ..operators import images as gather
from ..operators import mesh, noise, paths, sampling, spatial
from .frame_queries import POINTS, points
from .registry import Tables, query
from .world_queries import PLACES, places

c, lit = F.col, F.lit


def U(name: str, at: int = 0) -> str:
    return f"(('0x' || substr(md5({name}), {1 + DIGITS * at}, {DIGITS}))::BIGINT / {float(1 << 4 * DIGITS)}::DOUBLE)"


def N(name: str) -> str:
    return f"(sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {U(name)})) * cos({2 * math.pi!r}::DOUBLE * {U(name, 1)}))"


SCENES = 5
TRIANGLES = f""", t AS (SELECT p_partkey AS triangle, p_partkey % {SCENES} AS scene, p_partkey * 53 % 1000 / 10.0::DOUBLE AS ax, (p_partkey % 3)::DOUBLE AS ay, p_partkey * 29 % 1000 / 10.0::DOUBLE AS az, 0.5::DOUBLE + p_partkey % 7 AS ux, p_partkey % 5 * 0.25::DOUBLE AS uy, p_partkey % 4 * 0.5::DOUBLE AS uz, p_partkey % 3 * 0.5::DOUBLE AS wx, p_partkey % 2 * 0.75::DOUBLE AS wy, 1.0::DOUBLE + p_partkey % 6 AS wz FROM part)"""
#: Nearest place of a triangle by its definition: the foot inside, else the best of three edges; all points with all triangles.
NEAREST = """, s0 AS (SELECT p.*, t.*, p.x - ax AS qx, p.y - ay AS qy, p.z - az AS qz, uy * wz - uz * wy AS nx, uz * wx - ux * wz AS ny, ux * wy - uy * wx AS nz, ux * ux + uy * uy + uz * uz AS uu, wx * wx + wy * wy + wz * wz AS ww, ux * wx + uy * wy + uz * wz AS uw FROM p, t),
s1 AS (SELECT *, qx * ux + qy * uy + qz * uz AS qu, qx * wx + qy * wy + qz * wz AS qw FROM s0),
s2 AS (SELECT *, (ww * qu - uw * qw) / (uu * ww - uw * uw) AS v, (uu * qw - uw * qu) / (uu * ww - uw * uw) AS s, greatest(0, least(1, qu / uu)) AS e1, greatest(0, least(1, qw / ww)) AS e2, greatest(0, least(1, ((qw - uw) - (qu - uu)) / (uu + ww - 2 * uw))) AS e3 FROM s1),
s3 AS (SELECT *, unnest([[v, s, CASE WHEN v >= 0 AND s >= 0 AND v + s <= 1 THEN 0 ELSE 1 END], [e1, 0, 0], [0, e2, 0], [1 - e3, e3, 0]]) AS k FROM s2),
s4 AS (SELECT id, triangle, ax + k[1] * ux + k[2] * wx AS sx, ay + k[1] * uy + k[2] * wy AS sy, az + k[1] * uz + k[2] * wz AS sz, x, y, z FROM s3 WHERE k[3] = 0),
s5 AS (SELECT *, sqrt((x - sx) ^ 2 + (y - sy) ^ 2 + (z - sz) ^ 2) AS distance FROM s4),
near AS (SELECT * FROM s5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(distance, 9), triangle) = 1)"""


def triangles(t: Tables) -> DataFrame:
    k = c("p_partkey")
    a = {"x": k * 53 % 1000 / lit(10.0), "y": (k % 3).cast("double"), "z": k * 29 % 1000 / lit(10.0)}
    u = {"x": lit(0.5) + k % 7, "y": k % 5 * lit(0.25), "z": k % 4 * lit(0.5)}
    w = {"x": k % 3 * lit(0.5), "y": k % 2 * lit(0.75), "z": lit(1.0) + k % 6}
    corners = [(a[d]).alias(f"a{d}") for d in "xyz"] + [(a[d] + u[d]).alias(f"b{d}") for d in "xyz"] + [(a[d] + w[d]).alias(f"c{d}") for d in "xyz"]
    return t("part").select(k.alias("triangle"), (k % SCENES).cast("long").alias("scene"), *corners)


@query(PLACES + TRIANGLES + NEAREST + " SELECT id, round(sx, 5) AS snap_x, round(sy, 5) AS snap_y, round(sz, 5) AS snap_z, round(distance, 5) AS distance FROM near")
def join9_snapped_to_mesh(t: Tables) -> DataFrame:
    out = mesh.nearest_triangle(places(t), triangles(t))
    return out.select("id", *[F.round(f"snap_{d}", 5).alias(f"snap_{d}") for d in "xyz"], F.round("distance", 5).alias("distance"))


@query(PLACES + TRIANGLES + NEAREST + " SELECT id, triangle FROM near WHERE abs(y - sy) <= 0.5 AND round(sqrt((x - sx) ^ 2 + (z - sz) ^ 2), 9) <= 0.01")
def flt17_navigable_on_mesh(t: Tables) -> DataFrame:
    snaps = mesh.nearest_triangle(places(t), triangles(t))
    on = spatial.navigable(places(t), snaps.drop("x", "y", "z"), 0.5, 1e-2).select(c("id").alias("_id"))
    return snaps.join(on, c("id") == c("_id"), "left_semi").select("id", "triangle")


@query(POINTS + ", p AS (SELECT id, x, y, z FROM v)" + TRIANGLES + NEAREST + " SELECT id, round(distance, 5) AS distance FROM near")
def geo13_mesh_distance(t: Tables) -> DataFrame:
    own = points(t).select("id", "x", "y", "z")
    return mesh.nearest_triangle(own, triangles(t)).select("id", F.round("distance", 5).alias("distance"))


AREAS = """, g AS (SELECT *, round(sqrt((uy * wz - uz * wy) * (uy * wz - uz * wy) + (uz * wx - ux * wz) * (uz * wx - ux * wz) + (ux * wy - uy * wx) * (ux * wy - uy * wx)) / 2 * 1000000)::BIGINT AS area FROM t),
m AS (SELECT *, (sum(area) OVER (PARTITION BY scene ORDER BY triangle))::BIGINT AS hi, (sum(area) OVER (PARTITION BY scene))::BIGINT AS total FROM g WHERE area > 0)"""


def drawn(rows: str, seed: str, keys: str) -> str:
    """Rows with scene and keys -> a place of the scene's mesh for each."""
    name = lambda stream: f"concat_ws(':', '{seed}', '{stream}', scene, {keys})"
    return f"""SELECT d.* EXCLUDE (u, r, q), m.* EXCLUDE (scene), ax + r * (1 - q) * ux + r * q * wx AS px, ay + r * (1 - q) * uy + r * q * wy AS py, az + r * (1 - q) * uz + r * q * wz AS pz
  FROM (SELECT *, {U(name("triangle"))} AS u, sqrt({U(name("place"))}) AS r, {U(name("place"), 1)} AS q FROM {rows}) d JOIN m ON m.scene = d.scene AND floor(u * total)::BIGINT >= hi - area AND floor(u * total)::BIGINT < hi"""


@query(PLACES + TRIANGLES + AREAS + f""", k AS (SELECT id, id % {SCENES} AS scene, x, z, unnest(range(10)) AS attempt FROM p), d AS ({drawn("k", "near", "id, attempt")}),
o AS (SELECT * FROM d WHERE (px - x) ^ 2 + (pz - z) ^ 2 < 400 QUALIFY row_number() OVER (PARTITION BY id ORDER BY attempt) = 1)
SELECT p.id, o.attempt::INT AS attempt, o.triangle, round(px, 5) AS x, round(py, 5) AS y, round(pz, 5) AS z FROM p LEFT JOIN o ON p.id = o.id""")
def smp5_places_in_circles(t: Tables) -> DataFrame:
    own = places(t).withColumn("scene", c("id") % SCENES)
    out = sampling.near_places(own, triangles(t), 20.0)
    return out.select("id", "attempt", "triangle", *[F.round(d, 5).alias(d) for d in "xyz"])


#: One point after the other: kept if none kept so far is too close.
@query(PLACES + """, l AS (SELECT list([{'id': id, 'x': x, 'y': y, 'z': z}] ORDER BY id) AS l FROM p),
k AS (SELECT unnest(list_reduce(l, lambda a, b: CASE WHEN len(list_filter(a, lambda q: (q.x - b[1].x) * (q.x - b[1].x) + (q.y - b[1].y) * (q.y - b[1].y) + (q.z - b[1].z) * (q.z - b[1].z) < 16)) = 0 THEN list_concat(a, b) ELSE a END)) AS s FROM l)
SELECT s.id AS id, s.x AS x, s.z AS z FROM k""")
def smp5_spaced_places(t: Tables) -> DataFrame:
    return sampling.spaced(places(t), 4.0).select("id", "x", "z")


TURNS = 4


@query(PLACES + TRIANGLES + AREAS.replace("SELECT *, round(", "SELECT *, 0.2::DOUBLE + triangle % 9 AS island_radius, round(") + f""", n AS (SELECT scene, greatest(1, count(*) // 20) AS n FROM t GROUP BY scene),
j AS (SELECT scene, unnest(range({TURNS} * n)) AS target FROM n), a AS ({drawn("j", "pointnav-goal", "target")}), b AS (SELECT scene, target, px AS gx, py AS gy, pz AS gz FROM a WHERE island_radius >= 1.5),
k AS (SELECT *, unnest(range(10)) AS attempt FROM b), d AS ({drawn("k", "pointnav-start", "target, attempt")}),
e1 AS (SELECT *, abs(px - gx) + abs(pz - gz) AS way, sqrt((px - gx) ^ 2 + (py - gy) ^ 2 + (pz - gz) ^ 2) AS air, {U("concat_ws(':', 'pointnav-ratio', scene, target, attempt)")} AS luck FROM d),
f AS (SELECT * FROM e1 WHERE abs(py - gy) <= 0.5 AND way BETWEEN 1 AND 30 AND island_radius >= 1.5 AND (way / air >= 1.1 OR luck <= 20 * (way / air - 0.98) ^ 2) QUALIFY row_number() OVER (PARTITION BY scene, target ORDER BY attempt) = 1),
h1 AS (SELECT f.*, row_number() OVER (PARTITION BY f.scene ORDER BY target) - 1 AS episode_id, n FROM f JOIN n ON f.scene = n.scene)
SELECT scene, episode_id, target::BIGINT AS target, attempt::INT AS attempt, round(px, 5) AS start_x, round(pz, 5) AS start_z, round(gx, 5) AS goal_x, round(gz, 5) AS goal_z, round(way, 5) AS geodesic, round(sin({U("concat_ws(':', 'pointnav-turn', scene, target)")} * {2 * math.pi!r}::DOUBLE / 2), 6) AS rotation_y FROM h1 WHERE episode_id < n""")
def smp7_drawn_episodes(t: Tables) -> DataFrame:
    own = triangles(t).withColumn("island_radius", lit(0.2) + c("triangle") % 9)
    scenes = own.groupBy("scene").agg(F.greatest(lit(1), F.floor(F.count(lit(1)) / 20)).cast("long").alias("n"))
    way = lambda _: F.abs(c("start_x") - c("goal_x")) + F.abs(c("start_z") - c("goal_z"))
    out = sampling.point_goals(scenes, own, way, rounds=TURNS)
    return out.select("scene", "episode_id", "target", "attempt", *[F.round(x, 5).alias(x) for x in ("start_x", "start_z", "goal_x", "goal_z", "geodesic")], F.round("rotation_y", 6).alias("rotation_y"))


SHAPE = (4, 4, 4)
PIXELS = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: least(255, greatest(0, floor((x::DOUBLE + 0.5) * 255)))::INT) AS image FROM embeddings),
x AS (SELECT vec_id, i, v FROM (SELECT vec_id, unnest(image) AS v, unnest(range(len(image))) AS i FROM e))"""


def _bytes(model: str, share: str, rows: str = "x") -> str:
    return f"SELECT vec_id, string_agg(floor(greatest(0::DOUBLE, least(1::DOUBLE, {share})) * 255)::INT::VARCHAR, ' ' ORDER BY i) AS {model} FROM {rows} GROUP BY vec_id"


def _grains(kind: str, n: int) -> str:
    axis = lambda d: f"floor({U(f"concat_ws(':', 'salt', '{kind}', vec_id, j, {d})")} * {SHAPE[d] - 1})::INT"
    return f"SELECT DISTINCT vec_id, ({axis(0)} * {SHAPE[1]} + {axis(1)}) * {SHAPE[2]} + {axis(2)} AS i FROM e, (SELECT unnest(range({n})) AS j)"


def images(t: Tables) -> DataFrame:
    pixel = lambda x: F.least(lit(255), F.greatest(lit(0), F.floor((x.cast("double") + 0.5) * 255))).cast("int")
    return t("embeddings").select("vec_id", F.transform("embedding", pixel).alias("image"))


GRAINS = math.ceil(0.05 * math.prod(SHAPE) * 0.5)


@query(f"""{PIXELS}, n AS (SELECT vec_id, 2 ^ ceil(log2(count(DISTINCT v))) AS n FROM x GROUP BY vec_id), r AS (SELECT *, v / 255.0::DOUBLE * n AS rate, {U("concat_ws(':', 'poisson', vec_id, i)")} AS u FROM x JOIN n USING (vec_id)),
q AS (SELECT vec_id, i, n, u, unnest(range(ceil(rate + 10 * sqrt(rate) + 20)::INT + 1)) AS k, rate FROM r), w AS (SELECT vec_id, i, n, u, sum(CASE WHEN rate = 0 THEN (k = 0)::INT ELSE exp(k * ln(rate) - rate - lgamma(k + 1)) END) OVER (PARTITION BY vec_id, i ORDER BY k) AS c FROM q),
o AS (SELECT vec_id, i, n, count(*) FILTER (c <= u) AS k FROM w GROUP BY ALL), s AS ({_grains("salt", GRAINS)}), p AS ({_grains("pepper", GRAINS)}),
g1 AS ({_bytes("gaussian", f"v / 255.0::DOUBLE + {N("concat_ws(':', 'gaussian', vec_id, i)")} * 0.2")}), g2 AS ({_bytes("speckle", f"v + v * {N("concat_ws(':', 'speckle', vec_id, i)")} * 0.2")}), g3 AS ({_bytes("poisson", "k / n::DOUBLE", "o")}),
g4 AS (SELECT x.vec_id, string_agg((CASE WHEN p.i IS NOT NULL THEN 0 WHEN s.i IS NOT NULL THEN 1 ELSE v END)::VARCHAR, ' ' ORDER BY x.i) AS salt_and_pepper FROM x LEFT JOIN s ON x.vec_id = s.vec_id AND x.i = s.i LEFT JOIN p ON x.vec_id = p.vec_id AND x.i = p.i GROUP BY x.vec_id)
SELECT vec_id, gaussian, speckle, poisson, salt_and_pepper FROM g1 JOIN g2 USING (vec_id) JOIN g3 USING (vec_id) JOIN g4 USING (vec_id)""")
def mth5_sensor_noise(t: Tables) -> DataFrame:
    out = images(t)
    for model in ("gaussian", "speckle", "poisson", "salt_and_pepper"):
        out = noise.noisy(out, model, "image", "vec_id", SHAPE, model)
    return out.select("vec_id", *[F.array_join(m, " ").alias(m) for m in ("gaussian", "speckle", "poisson", "salt_and_pepper")])


def _deviate(kind: str, part: int, floor: str | None = None) -> str:
    mean, variance = noise.MOTION["LoCoBot", "ILQR"][kind][part]
    d = math.sqrt(variance)
    low = f"greatest(-3.0::DOUBLE, (-0.95::DOUBLE * abs({floor}) - {mean}::DOUBLE) / {d!r}::DOUBLE)" if floor else "-3.0::DOUBLE"
    z = f"list_transform(range({TRIES}), lambda j: {N(f"concat_ws(':', 'motion', '{kind}', {part}, id, j)")})"
    return f"({mean}::DOUBLE + {d!r}::DOUBLE * coalesce(list_filter({z}, lambda x: x BETWEEN {low} AND 3)[1], least(greatest({z}[1], {low}), 3)))"


@query(f"""WITH a AS (SELECT event_id AS id, ['forward', 'backward', 'left', 'right', 'stop'][event_id % 5 + 1] AS move, CASE WHEN event_id % 5 < 2 THEN value / 100 ELSE value END AS amount FROM events),
b AS (SELECT *, CASE WHEN move IN ('backward', 'right') THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS s, radians(amount) AS r FROM a)
SELECT id, move, round(CASE WHEN move IN ('forward', 'backward') THEN s * (abs(amount) + {_deviate("linear", 0, "amount")}) WHEN move IN ('left', 'right') THEN {_deviate("rotational", 0)} END, 6) + 0.0::DOUBLE AS ahead,
  round(CASE WHEN move IN ('forward', 'backward') THEN s * {_deviate("linear", 1)} WHEN move IN ('left', 'right') THEN {_deviate("rotational", 1)} END, 6) + 0.0::DOUBLE AS aside,
  round(CASE WHEN move IN ('forward', 'backward') THEN {_deviate("linear", 2)} WHEN move IN ('left', 'right') THEN s * (abs(r) + {_deviate("rotational", 2, "r")}) END, 6) + 0.0::DOUBLE AS turn FROM b""")
def mth5_motion_noise(t: Tables) -> DataFrame:
    k = c("event_id") % 5
    names = F.array(*[lit(x) for x in ("forward", "backward", "left", "right", "stop")])
    own = t("events").select(c("event_id").alias("id"), F.get(names, k.cast("int")).alias("move"), F.when(k < 2, c("value") / 100).otherwise(c("value")).alias("amount"))
    out = noise.moved(own, "id", "move", "amount")
    return out.select("id", "move", *[(F.round(x, 6) + 0.0).alias(x) for x in ("ahead", "aside", "turn")])


EDGE = 8


@query(PIXELS.replace("(SELECT vec_id, unnest(image)", "(SELECT vec_id, image, unnest(image)") + f""", o AS (SELECT vec_id, image, unnest(range(5)) AS i FROM e), q AS (SELECT *, unnest(range(5)) AS j FROM o),
r AS (SELECT vec_id, i, j, list_avg(list_transform(list_filter(range({EDGE * EDGE}), lambda k: k // {EDGE} >= i * {EDGE} // 5 AND k // {EDGE} < ceil((i + 1) * {EDGE} / 5.0) AND k % {EDGE} >= j * {EDGE} // 5 AND k % {EDGE} < ceil((j + 1) * {EDGE} / 5.0)), lambda k: image[k + 1])) AS v,
  image[i * {EDGE} // 5 * {EDGE} + j * {EDGE} // 5 + 1] AS n FROM q)
SELECT vec_id, string_agg(trunc(v + 0.000000001)::BIGINT::VARCHAR, ' ' ORDER BY i, j) AS area, string_agg(n::VARCHAR, ' ' ORDER BY i, j) AS nearest, string_agg(trunc(v + 0.000000001)::BIGINT::VARCHAR, ' ' ORDER BY i, j) FILTER (i BETWEEN 1 AND 3 AND j BETWEEN 1 AND 2) AS middle, 3 AS n_virtual FROM r GROUP BY vec_id""")
def mth6_resized(t: Tables) -> DataFrame:
    shape = (EDGE, EDGE, 1)
    own = images(t).withColumn("area", gather.changed(gather.shortest_edge(shape, 5), "image", whole=True)).withColumn("nearest", gather.changed(gather.shortest_edge(shape, 5, "nearest"), "image", whole=True))
    own = gather.with_virtual_keys(own.withColumn("middle", gather.changed(gather.centred((5, 5, 1), (3, 2)), "area", whole=True)), {"goal": 3})
    return own.select("vec_id", *[F.array_join(x, " ").alias(x) for x in ("area", "nearest", "middle")], F.size("goal").alias("n_virtual"))


VIEWS = ", ".join(f"({n}, {', '.join(str(float(v)) + '::DOUBLE' for axis in axes for v in axis)})" for n, axes in enumerate(gather.FACES.values()))
HIGH, WIDE = 6, 12


@query(f"""WITH e AS (SELECT vec_id // 6 AS cube, vec_id % 6 AS face, list_transform(embedding, lambda x: x::DOUBLE) AS image FROM embeddings), k AS (SELECT cube FROM e GROUP BY cube HAVING count(*) = 6),
a AS (SELECT r, c, (c + 0.5) * {2 * math.pi!r} / {WIDE} - {math.pi!r} AS theta, (r + 0.5) * {math.pi!r} / {HIGH} - {math.pi / 2!r} AS phi FROM (SELECT unnest(range({HIGH})) AS r), (SELECT unnest(range({WIDE})) AS c)),
d AS (SELECT r, c, cos(phi) * sin(theta) AS x, sin(phi) AS y, cos(phi) * cos(theta) AS z FROM a), f(face, rx, ry, rz, dx, dy, dz, ax, ay, az) AS (VALUES {VIEWS}),
l AS (SELECT r, c, face, (x * rx + y * ry + z * rz) AS u, x * dx + y * dy + z * dz AS v, x * ax + y * ay + z * az AS w FROM d, f),
m AS (SELECT r, c, face, (u / w + 1) / 2 * {EDGE - 1} AS px, (v / w + 1) / 2 * {EDGE - 1} AS py FROM l WHERE w > 0 AND abs(u / w) <= 1 AND abs(v / w) <= 1 QUALIFY row_number() OVER (PARTITION BY r, c ORDER BY face) = 1),
t AS (SELECT r, c, face, unnest([floor(py), floor(py), floor(py) + 1, floor(py) + 1])::INT AS i, unnest([floor(px), floor(px) + 1, floor(px), floor(px) + 1])::INT AS j, px, py FROM m),
s AS (SELECT cube, r, c, sum(image[i * {EDGE} + j + 1] * (1 - abs(py - i)) * (1 - abs(px - j))) AS v FROM t JOIN e USING (face) JOIN k USING (cube) WHERE i BETWEEN 0 AND {EDGE - 1} AND j BETWEEN 0 AND {EDGE - 1} GROUP BY cube, r, c)
SELECT cube, r, c, round(v, 5) AS v FROM s""")
def mth6_panoramas(t: Tables) -> DataFrame:
    own = t("embeddings").select(F.floor(c("vec_id") / 6).alias("cube"), (c("vec_id") % 6).alias("face"), c("embedding").cast("array<double>").alias("image"))
    faces = own.groupBy("cube").agg(*[F.max(F.when(c("face") == n, c("image"))).alias(name) for n, name in enumerate(gather.FACES)])
    table = gather.cube_to_sphere(EDGE, (HIGH, WIDE))
    out = faces.withColumn("view", gather.changed(table, *gather.FACES)).filter(c("view").isNotNull())
    out = out.select("cube", F.posexplode("view").alias("p", "v"))
    return out.select("cube", F.floor(c("p") / WIDE).alias("r"), (c("p") % WIDE).cast("long").alias("c"), F.round("v", 5).alias("v"))


@query()
def gra4_straight_paths(t: Tables) -> DataFrame:
    """Open cells of a grid as square polygons; trips between them through shared sides."""
    k = c("c_custkey")
    spot = lambda x, z: F.array(x.cast("double"), lit(0.0), z.cast("double"))
    cells = t("customer").filter(k * 13 % 7 > 1).select(k.alias("poly"), F.floor(k / 30).alias("r"), (k % 30).alias("q"))
    other = cells.select(c("poly").alias("dst"), c("r").alias("_r"), c("q").alias("_q"))
    beside = cells.withColumn("_o", F.explode(F.array(*[F.struct(lit(a).alias("a"), lit(b).alias("b")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))])))
    pairs = beside.join(other.hint("merge"), (c("r") + c("_o.a") == c("_r")) & (c("q") + c("_o.b") == c("_q")))
    x, z = F.greatest("q", "_q"), F.greatest("r", "_r")
    portals = pairs.select(c("poly").alias("src"), "dst", spot(x, z).alias("p"), F.when(c("r") == c("_r"), spot(x, z + 1)).otherwise(spot(x + 1, z)).alias("q"))
    centres = cells.select("poly", spot(c("q") + 0.5, c("r") + 0.5).alias("centre"))
    edges = portals.select("src", "dst", lit(1.0).alias("weight"))
    ends = cells.select(c("poly").alias("goal"), spot(c("q") + 0.25, c("r") + 0.75).alias("end"))
    trips = cells.filter("poly % 50 = 1").select(c("poly").alias("id"), c("poly").alias("source"), spot(c("q") + 0.5, c("r") + 0.25).alias("start"), F.explode(F.array(*[c("poly") + d for d in (7, 40, 95)])).alias("goal"))
    trips = trips.join(ends.hint("merge"), "goal").withColumn("goal_id", c("goal"))
    out = paths.nearest(paths.straight_paths(trips, edges, paths.gates(portals, centres)))
    return out.select("id", "goal_id", F.round("distance", 6).alias("distance"), F.size("points").alias("corners"))
