"""Draws by counter, rejection, spacing and noise: exact reruns, brute force and moments."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import draws
from tessella.operators import mesh, noise, sampling
from tessella.operators.lineage import cut

TRIANGLE = "scene long, triangle long, " + ", ".join(f"{c} double" for c in mesh.CORNERS)


def uniform(*name):
    return int(hashlib.md5(":".join("" if n is None else str(n) for n in name).encode()).hexdigest()[:13], 16) / 2**52


def test_uniform_and_moments(spark):
    df = spark.range(4000).repartition(7)
    got = df.select("id", draws.uniform("s", F.col("id"), 3).alias("u"), draws.normal("n", F.col("id")).alias("z"), draws.poisson(F.lit(6.5), draws.uniform("p", F.col("id"))).alias("k"), draws.poisson(F.lit(0.0), draws.uniform("p", F.col("id"))).alias("o")).collect()
    assert all(r.u == uniform("s", r.id, 3) for r in got) and all(0 <= r.u < 1 for r in got)
    mean = lambda v: sum(v) / len(v)
    spread = lambda v: mean([(x - mean(v)) ** 2 for x in v])
    u, z, k = [r.u for r in got], [r.z for r in got], [r.k for r in got]
    assert abs(mean(u) - 0.5) < 0.02 and abs(spread(u) - 1 / 12) < 0.005
    assert abs(mean(z)) < 0.06 and abs(spread(z) - 1) < 0.08 and abs(mean([x**3 for x in z])) < 0.3
    assert abs(mean(k) - 6.5) < 0.15 and abs(spread(k) - 6.5) < 0.6 and {r.o for r in got} == {0}


def test_poisson_inversion(spark):
    """The count whose interval of the summed probabilities holds the number."""
    rows = [(rate, u / 97) for rate in (0.3, 4.0, 250.0) for u in range(97)]
    got = spark.createDataFrame(rows, "rate double, u double").select("rate", "u", draws.poisson(F.col("rate"), F.col("u")).alias("k")).collect()
    for r in got:
        total, k = math.exp(-r.rate), 0
        while total <= r.u:
            k += 1
            total += math.exp(k * math.log(r.rate) - r.rate - math.lgamma(k + 1))
        assert r.k == k


def test_poisson_draws_once(spark):
    """The number and the rate are worked out once, not anew at every step."""
    plan = spark.range(1).select(draws.poisson(F.col("id") + 0.5, draws.uniform("p", F.col("id"))).alias("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1 and plan.count("+ 0.5)") == 1


def test_truncated(spark):
    z = draws.truncated(F.lit(2.0), F.lit(0.5), F.lit(-0.1), F.lit(3.0), "t", F.col("id"))
    far = draws.truncated(F.lit(0.0), F.lit(1.0), F.lit(8.0), F.lit(9.0), "t", F.col("id"))
    got = spark.range(2000).select(z.alias("z"), far.alias("far")).collect()
    assert min(r.z for r in got) >= 1.95 and max(r.z for r in got) <= 3.5 and {r.far for r in got} == {8.0}


def test_truncated_draws_no_more(spark, monkeypatch):
    """What comes after the first deviate between the bounds isn't drawn."""
    column = lambda j: j if isinstance(j, Column) else F.lit(j)
    monkeypatch.setattr(draws, "normal", lambda seed, *keys: F.when(column(keys[-1]) < 3, column(keys[-1]) / 4.0).otherwise(F.raise_error(F.lit("drawn")).cast("double")))
    z = draws.truncated(F.lit(0.0), F.lit(1.0), F.lit(0.4), F.lit(0.6), "t", F.col("id"))
    assert {r.z for r in spark.range(5).select(z.alias("z")).collect()} == {0.5}


def test_on_mesh(spark):
    """Triangles are hit in proportion to their areas, places lie in them, a scene without area has none."""
    table = [(1, 1, *[0.0] * 3, 4.0, 0.0, 0.0, 0.0, 0.0, 1.0), (1, 2, *[10.0] * 3, 10.0, 10.0, 16.0, 12.0, 10.0, 10.0), (1, 3, *[5.0] * 9), (2, 9, *[1.0] * 9), (None, 7, *[0.0] * 3, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)]
    areas = sampling.prefix_areas(spark.createDataFrame(table, TRIANGLE))
    own = spark.range(3000).selectExpr("1L AS scene", "id").unionByName(spark.range(50).selectExpr("2L AS scene", "id")).unionByName(spark.range(40).selectExpr("CAST(NULL AS LONG) AS scene", "id"))
    got = sampling.on_mesh(own.repartition(5), areas, "m", ["id"]).collect()
    hits = Counter((r.scene, r.triangle) for r in got)
    assert set(hits) == {(1, 1), (1, 2), (None, 7)} and hits[1, 1] + hits[1, 2] == 3000 and abs(hits[1, 1] / 3000 - 2 / 8) < 0.03
    assert all(r.x >= 0 and r.z >= 0 and r.x / 4 + r.z <= 1 + 1e-9 and r.y == 0 for r in got if r.triangle == 1)
    assert sorted(got, key=str) == sorted(sampling.on_mesh(own, areas, "m", ["id"]).collect(), key=str)


def test_draws_are_not_dealt_by_scene(spark):
    """With few scenes the draws stay where they are until their triangle is known; as many scenes as are too many give the same places."""
    table = [(s, t, *[float(t)] * 3, t + 4.0, 0.0, 0.0, 0.0, 0.0, 1.0) for s in (1, 2) for t in range(3)]
    areas = cut(sampling.prefix_areas(spark.createDataFrame(table, TRIANGLE)))
    own = cut(spark.range(60).selectExpr("id % 2 + 1 AS scene", "id"))
    got = sampling.on_mesh(own, areas, "m", ["id"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1
    with pytest.MonkeyPatch.context() as m:
        m.setattr(sampling, "FEW", 1)
        assert sorted(map(tuple, sampling.on_mesh(own, areas, "m", ["id"]).collect())) == sorted(map(tuple, got.collect()))


def test_first_accepted(spark):
    """The first good attempt by a number of its own, whatever the rounds; keys without one stay with nulls."""
    keys = spark.range(300).select((F.col("id") % 100).alias("k"), F.when(F.col("id") >= 100, F.col("id")).alias("j")).distinct()
    propose = lambda rows: rows.withColumn("u", draws.uniform("r", F.col("k"), F.col("j"), F.col("attempt"))).withColumn("ok", F.col("u") < 0.2)
    for batch in (1, 2, 9):
        got = {(r.k, r.j): (r.attempt, r.u) for r in sampling.first_accepted(keys, propose, 9, batch).collect()}
        assert len(got) == keys.count()
        for (k, j), (attempt, u) in got.items():
            want = next(((a, x) for a in range(9) if (x := uniform("r", k, j, a)) < 0.2), (None, None))
            assert (attempt, u) == want


@pytest.mark.parametrize("kind", ["plane", "copies", "line"])
def test_spaced(spark, kind):
    rng = random.Random(8)
    table = {"plane": lambda i: (rng.uniform(0, 30), 0.0, rng.uniform(0, 30)), "copies": lambda i: (float(i % 3), 1.0, 2.0), "line": lambda i: (i * 0.9, 0.0, 0.0)}[kind]
    rows = [(i, *table(i)) for i in range(250)]
    want = []
    for r in rows:
        if all(math.dist(r[1:], q[1:]) >= 3.0 for q in want):
            want.append(r)
    got = sampling.spaced(spark.createDataFrame(rows, "id long, x double, y double, z double").repartition(3), 3.0)
    assert sorted(r.id for r in got.collect()) == [r[0] for r in want]


def test_point_goals(spark):
    """As many episodes as asked for where targets suffice, all of them compatible, the same whatever the rounds find first."""
    table = [(s, s * 10 + i, i * 6.0, 0.0, 0.0, i * 6.0 + 5, 0.0, 0.0, i * 6.0, 0.0, 5.0, 2.0 if i else 0.5) for s in (1, 2) for i in range(6)]
    table += [(3, 99, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 9.0)]
    meshes = spark.createDataFrame(table, TRIANGLE + ", island_radius double")
    scenes = spark.createDataFrame([(1, 12), (2, 5), (3, 4), (4, 2), (5, 0)], "scene long, n long")
    way = lambda _: F.abs(F.col("start_x") - F.col("goal_x")) + F.abs(F.col("start_z") - F.col("goal_z"))
    out = sampling.point_goals(scenes, meshes, way, near=3.0, far=20.0)
    got = out.collect()
    assert Counter(r.scene for r in got) == {1: 12, 2: 5}  # scene 3 is too small, scene 4 has no mesh
    for r in got:
        air = math.dist((r.start_x, r.start_y, r.start_z), (r.goal_x, r.goal_y, r.goal_z))
        luck = uniform("pointnav-ratio", r.scene, r.target, r.attempt)
        assert 3 <= r.geodesic <= 20 and (r.geodesic / air >= 1.1 or luck <= 20 * (r.geodesic / air - 0.98) ** 2)
        assert min(r.start_x, r.goal_x) >= 6 and r.rotation_y**2 + r.rotation_w**2 == pytest.approx(1)
    assert sorted(r.episode_id for r in got if r.scene == 1) == list(range(12))
    longer = {(r.scene, r.target): r.geodesic for r in sampling.point_goals(scenes.withColumn("n", F.col("n") * 2), meshes, way, near=3.0, far=20.0).collect()}
    assert all(longer[r.scene, r.target] == r.geodesic for r in got)


def test_noise_models(spark):
    """Reruns agree; moments are those of the model; salt and pepper where they are drawn; names are looked up."""
    flat = spark.range(60).select("id", F.array_repeat(F.lit(128), 48).alias("image")).unionByName(spark.createDataFrame([(60, None)], "id long, image array<int>"))
    shape, out = (4, 4, 3), flat.repartition(3)
    for model in noise.models.names("noise"):
        out = noise.noisy(out, model, "image", "id", shape, model)
    got = {r.id: r for r in out.collect()}
    assert got == {r.id: r for r in out.collect()} and got.pop(60).gaussian is None
    mean = lambda v: sum(v) / len(v)
    g = [v for r in got.values() for v in r.gaussian]
    assert abs(mean(g) - 127.5) < 2.5 and abs(mean([(v - mean(g)) ** 2 for v in g]) ** 0.5 - 50) < 4
    assert {v for r in got.values() for v in r.poisson} <= {0, 255} and {v for r in got.values() for v in r.none} == {128}
    assert mean([v == 255 for r in got.values() for v in r.speckle]) > 0.95
    for r in got.values():
        at = lambda kind: {(math.floor(uniform("salt", kind, r.id, j, 0) * 3) * 4 + math.floor(uniform("salt", kind, r.id, j, 1) * 3)) * 3 + math.floor(uniform("salt", kind, r.id, j, 2) * 2) for j in range(2)}  # noqa: E731, B023
        salt, pepper = at("salt"), at("pepper")
        assert list(r.salt_and_pepper) == [0 if i in pepper else 1 if i in salt else 128 for i in range(48)]
    with pytest.raises(KeyError):
        noise.noisy(flat, "os.system", "image", "id", shape, "x")


def test_motion_noise(spark):
    moves = ["forward", "backward", "left", "right", "stop"]
    df = spark.range(2000).select("id", F.get(F.array(*map(F.lit, moves)), (F.col("id") % 5).cast("int")).alias("move"), F.lit(0.25).alias("amount"))
    got = noise.moved(df, "id", "move", "amount").collect()
    by = {m: [r for r in got if r.move == m] for m in moves}
    mean = lambda v: sum(v) / len(v)
    assert all(r.ahead is r.aside is r.turn is None for r in by["stop"])
    assert abs(mean([r.ahead for r in by["forward"]]) - 0.264) < 0.02 and abs(mean([r.ahead for r in by["backward"]]) + 0.264) < 0.02
    assert all(r.ahead > 0.012 for r in by["forward"]) and all(r.ahead < 0 for r in by["backward"])
    assert all(r.turn > 0 for r in by["left"]) and all(r.turn < 0 for r in by["right"])
    widest = 3 * math.sqrt(0.005) + 0.009
    assert all(abs(r.aside) <= widest for r in by["forward"])
    still = noise.moved(df, "id", "move", "amount", multiplier=0.0).filter("move = 'forward'").first()
    assert (still.ahead, still.aside, still.turn) == (0.25, 0.0, 0.0)
    with pytest.raises(KeyError):
        noise.moved(df, "id", "move", "amount", robot="other")
