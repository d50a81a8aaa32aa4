"""Known values for single operators."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.functions import geometry as g
from tessella.functions import strings
from tessella.operators import catalogue, episodes, frames, graph, logic, metrics, profile, spatial
from tessella.operators.ranges import running
from tessella.operators.registry import Registry
from tessella.sources import profiles, scenes, sinks
from tessella.streaming import deltas


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def v3(*x):
    return F.array(*[F.lit(float(i)) for i in x])


def test_profile(spark):
    rows = [(60, 70, "child 4", 1), (20, 30, "child 1", 1), (10, 30, "child 0", 1), (10, 100, "root A", 1), (50, 90, "child 3", 1), (40, 80, "child 2", 1), (20, 90, "root B", 2), (30, 90, "child 6", 2), (40, 50, "child 7", 2), (80, 90, "child 7", 2)]
    df = spark.createDataFrame([(i, n, t, s, e) for i, (s, e, n, t) in enumerate(rows)], "id long, name string, thread long, start long, end long")
    got = {r.name: (r.n, r.inclusive, r.exclusive) for r in profile.summary(df).collect()}
    assert got == {"root A": (1, 90, 20), "root B": (1, 70, 10), "child 6": (1, 60, 40), "child 2": (1, 40, 10), "child 3": (1, 40, 30), "child 0": (1, 20, 10), "child 7": (2, 20, 20), "child 1": (1, 10, 10), "child 4": (1, 10, 10)}
    assert profile.summary(df.limit(0)).count() == 0


def test_triangle(spark):
    a, b, c = v3(0, 0, 1), v3(0, 1, 0), v3(0, 0, 0)
    inside = [(0, 0, 1), (0, 0.99, 0), (0, 0, 0), (0, 0.49, 0.49), (0, 0.2, 0.4), (1e-7, 0.1, 0.1)]
    outside = [(0, 0, 1.01), (0, 0, -0.01), (0, 0.51, 0.51), (0, -0.01, 0.51), (0.01, 0, 0), (0.1, 0.2, 0.2), (1e-6, 0.1, 0.1)]
    assert all(one(spark, g.in_triangle(v3(*p), a, b, c)) for p in inside)
    assert not any(one(spark, g.in_triangle(v3(*p), a, b, c)) for p in outside)


def test_boxes_and_polygons(spark):
    q = g.quat(*[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])
    center, half = v3(0, 0, 0), v3(10, 5, 1)
    assert all(one(spark, g.box_contains(v3(*p), center, half, q)) for p in [(0, 0, 0), (-5, -2, 0.5), (5, 0, -0.5)])
    assert not any(one(spark, g.box_contains(v3(*p), center, half, q)) for p in [(5, 0, 2), (-10, 0.5, -2)])
    assert one(spark, g.box_distance(v3(-20, 0, 0), center, half, q)) == 10
    assert one(spark, g.box_distance(v3(-10, -5, 2), center, half, q)) == 1
    assert [one(spark, x) for x in g.box_bounds(center, half, q)] == [[-10, -5, -1], [10, 5, 1]]
    loop = F.array(*[F.array(F.lit(float(x)), F.lit(float(z))) for x, z in [(-20, -10), (-25, 0), (-20, 10), (-10, 10), (-5, 0), (-10, -10)]])
    assert one(spark, g.polygon_area(loop)) == 300
    hit = lambda x, z: one(spark, g.in_polygon(F.lit(float(x)), F.lit(float(z)), loop))
    assert hit(-5.1, 0.01) and hit(-24.9, 0.01) and hit(-15.1, 9.9) and not hit(0, 0.01) and not hit(-6, 10.01)


def test_densify(spark):
    assert one(spark, g.densify(F.array(v3(0, 0, 0), v3(7, 0, 0)), 3.0)) == [[0, 0, 0], [3, 0, 0], [6, 0, 0], [7, 0, 0]]


def test_densify_short_segments(spark):
    path = lambda *xs: F.array(*[v3(x, 0, 0) for x in xs])
    xs = lambda p: [round(v[0], 6) for v in one(spark, g.densify(p, 3.0))]
    assert xs(path(0, 1, 2, 3)) == [0, 1, 2, 3]
    assert xs(path(0, 0.5, 1)) == [0, 1] and xs(path(0, 0.2)) == [0] and xs(path(0, 0, 8)) == [0, 3, 6, 8]


def test_preference_bands(spark):
    bands = {None: 0.6, 0.0: 0.3, -1.0: 0.3, 0.5: 0.3, 1.0: 0.5, 1.5: 0.5, 2.0: 0.75, 2.5: 0.75, 3.0: 1.0, 5.0: 1.0, 5.5: 0.75, 6.0: 0.75, 6.5: 0.5, 7.0: 0.5, 7.5: 0.3}
    assert {d: float(one(spark, frames.preference(F.lit(d).cast("double")))) for d in bands} == bands
    df = spark.createDataFrame([(0, 0, 10.0, 0.0), (0, 1, 9.0, 6.5), (0, 2, 8.0, 2.0)], "frame int, ord int, p double, d double")
    got = frames.top_salient(df, "frame", frames.salience_order(F.col("p"), F.col("d"), F.col("ord")), 3)
    assert [r.ord for r in got.orderBy("rank").collect()] == [2, 0, 1]  # a distance of 0 is unknown: 10 * 0.6


def test_phrases(spark):
    assert one(spark, frames.phrase(F.lit("beneath_of"))) == "below" and one(spark, frames.phrase(F.lit("far_from"))) == "far from"


def test_relation_axes(spark):
    for b, want in (((0.4, 0.3, 0), "left_of"), ((0, 0.24, 0.1), "behind"), ((0.1, 0.3, 0), "on_top_of"), ((0.1, -0.3, 0), "beneath_of"), ((0.2, 0, 0.2), "behind"), ((0.2, 0, -0.2), "in_front_of")):
        df = spark.createDataFrame([(0, 0, [0.0, 0.0, 0.0]), (0, 1, [float(x) for x in b])], "f int, o int, c array<double>")
        got = [r.relation for r in frames.relations(df, "f", "o", "c").collect()]
        assert got == [want], b


def test_force(spark):
    fold = lambda *v: [(x.add, x.accum) for x in one(spark, metrics.hysteresis(v3(*v), 2.0))]
    assert fold(10, 10, 10) == [(0, 0), (0, 0), (0, 0)]
    assert fold(10, 15, 16, 12, 20) == [(0, 0), (5, 5), (0, 5), (-3, 5), (8, 13)]
    assert one(spark, metrics.force_penalty(F.lit(-3.0), 0.1, 0.2)) == 0 and one(spark, metrics.force_penalty(F.lit(5.0), 0.1, 0.2)) == -0.2


def test_decay(spark):
    assert [round(one(spark, strings.cosine_decay(F.lit(x))), 9) for x in (-1.0, 0.0, 0.5, 1.0, 1.5)] == [1, 1, 0.5, 0, 0]
    assert one(spark, strings.linear_decay(F.lit(5), 10)) == 0.5 and one(spark, strings.linear_decay(F.lit(15), 10)) == -0.5


def test_routes(spark):
    rooms = spark.createDataFrame([("bedroom_1", "bedroom"), ("bedroom_2", "bedroom"), ("kitchen", "kitchen")], "room string, kind string")
    held = spark.createDataFrame([("bedroom_1", "bed", 1), ("bedroom_1", "lamp", 2), ("bedroom_2", "bed", 1), ("kitchen", "chair", 3), ("kitchen", "oven", 1)], "room string, category string, n long")
    asked = {("bedroom_1", "bed"): 1, ("kitchen", None): 2, (None, "bed"): 3, ("bedroom", None): 4, ("bedroom", "bed"): 4, (None, "chair"): 5, (None, "oven"): 5, ("bedroom_1", "lamp"): 6, ("cellar", None): 7, (None, "piano"): 7, ("kitchen", "bed"): 7, (None, None): 8}
    df = spark.createDataFrame(list(asked), "room string, object string")
    got = {(r.room, r.object): r for r in catalogue.route(df, held, rooms).collect()}
    assert {k: r.rule for k, r in got.items()} == asked
    assert got[None, "chair"].target_room == "kitchen" and got["bedroom", None].candidates == ["bedroom_1", "bedroom_2"]


def test_dialog(spark):
    things = spark.createDataFrame([("Hall", "Sofa", 2, 1.0, 3.0, 1.0), ("Hall", "sofa", 1, 2.0, 0.5, 2.0), ("Hall", "door", 3, 9.0, 9.0, 9.0)], "room string, category string, ordinal int, x double, y double, z double")
    said = spark.createDataFrame([(1, "1. hall, SOFA"), (2, "2. Hall"), (3, "3. which?"), (4, "7. no"), (5, "what"), (6, "5. cellar")], "request int, reply string")
    got = {r.request: (r.outcome, r.x, r.y, r.message) for r in catalogue.dialog(said, things).collect()}
    assert got == {1: ("go", 2.0, 0.163378, None), 2: ("go", 2.0, 0.163378, None), 3: ("say", None, None, "which?"), 4: ("say", None, None, "no"), 5: ("invalid", None, None, None), 6: ("absent", None, None, None)}


def test_clusters_against_brute_force(spark):
    import random

    rng, table = random.Random(2), []
    for i in range(200):
        x, y, z = (rng.uniform(0, 6) for _ in range(3))
        table.append((i % 3, f"l{i % 2}", i, rng.randint(50, 60), 0.1, x, y, z, rng.random(), [x - 1, y - 1, z - 1], [x + 1, y + 1, z + 1]))
    df = spark.createDataFrame(table, "frame long, label string, object_id long, pixel_count long, percent double, x double, y double, z double, distance double, low array<double>, high array<double>")
    want = {}
    for r in sorted(table, key=lambda r: (-r[3], r[2])):
        for home in want.setdefault((r[0], r[1]), []):
            if ((home["x"] - r[5]) ** 2 + (home["z"] - r[7]) ** 2) ** 0.5 <= 1.0:
                w = home["w"] + r[3]
                home["x"], home["z"] = (home["x"] * home["w"] + r[5] * r[3]) / w, (home["z"] * home["w"] + r[7] * r[3]) / w
                home["w"], home["ids"] = w, [*home["ids"], r[2]]
                break
        else:
            want[r[0], r[1]].append({"x": r[5], "z": r[7], "w": r[3], "ids": [r[2]]})
    got = frames.cluster(df, 1.0)
    assert {(r.frame, r.label, r.cluster): (list(r.ids), r.pixels, round(r.x, 6)) for r in got.collect()} == {(*k, i): (h["ids"], h["w"], round(h["x"], 6)) for k, homes in want.items() for i, h in enumerate(homes)}
    top = frames.top_clusters(got, 2).collect()
    assert max(Counter((r.frame, r.label) for r in top).values()) <= 2 and {r.uid[-2:] for r in top} == {"01", "02"}
    assert all(r.low[0] <= r.x <= r.high[0] for r in top)


def test_exclusive_time_in_cells(spark):
    """The same sums however finely a thread's time is cut, as by the union of what overlaps."""
    import random

    rng = random.Random(6)
    table = [(i, f"n{i % 7}", i % 2, a := rng.randint(0, 5000), a + rng.choice([0, 3, 40, 900, 4000])) for i in range(300)]
    want = Counter()
    for i, name, thread, a, b in table:
        later = [(c, d) for j, _, t, c, d in table if t == thread and (c, -d, j) > (a, -b, i) and a <= c <= b]
        want[name] += sum(not any(c <= x < d for c, d in later) for x in range(a, b))
    df = spark.createDataFrame(table, "id long, name string, thread long, start long, end long")
    for cell in (1000, 20, 2):
        assert {r.name: r.own for r in profile.exclusive(df, cell).collect()} == {k: v for k, v in want.items() if v}


def test_running_sums(spark):
    import random

    rng = random.Random(3)
    values = [(i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rng.sample(values, 500), "k int, v int")
    got = {r.k: (r.n, r.s) for r in running(running(df, [F.col("k")], name="n"), [F.col("k")], F.col("v"), "s").collect()}
    assert got == {k: (k, sum(v for j, v in values if j < k)) for k, _ in values}


def test_supercover_against_squares(spark):
    ends = [(x, y) for x in range(-5, 6) for y in range(-5, 6)]
    df = spark.createDataFrame(ends, "x int, y int")
    for r in df.select("x", "y", g.supercover(F.lit(0), F.lit(0), F.col("x"), F.col("y")).alias("line")).collect():
        touched = set()
        for i in range(-6, 7):
            for j in range(-6, 7):  # a segment touches a square if a line of its points does on both axes
                lo, hi = 0.0, 1.0
                for at, to in ((i, r.x), (j, r.y)):
                    if to == 0:
                        if abs(at) > 0.5:
                            hi = -1.0
                    else:
                        a, b = sorted(((at - 0.5) / to, (at + 0.5) / to))
                        lo, hi = max(lo, a), min(hi, b)
                if lo <= hi + 1e-12:
                    touched.add((i, j))
        assert {(c.x, c.y) for c in r.line} == touched and r.line[-1] == (r.x, r.y)


def test_hulls(spark):
    import random

    rng = random.Random(9)
    pts = [(k, round(rng.gauss(0, 1), 3), round(rng.gauss(0, 1), 3)) for k in (1, 2) for _ in range(200)]
    got = {}
    for r in sorted(spatial.hulls(spark.createDataFrame(pts, "k int, u double, v double"), "k").collect(), key=lambda r: (r.k, r.i)):
        got.setdefault(r.k, []).append((r.u, r.v))
    for k, corners in got.items():
        assert corners[0] == min(corners)
        for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):  # all points to the left of each edge
            assert all((bx - ax) * (v - ay) - (by - ay) * (u - ax) >= -1e-12 for j, u, v in pts if j == k)


def test_smooth(spark):
    path = F.array(v3(0, 0, 0), v3(1, 2, 0), v3(3, 2, 1))
    out = one(spark, g.smooth(path, 5))
    assert len(out) == 10 and out[0] == [0, 0, 0] and out[5] == pytest.approx([1, 2, 0]) and out[4] == pytest.approx([1, 2, 0]) and out[-1] == pytest.approx([3, 2, 1])


def test_registry(spark):
    own = Registry()
    own.register("sensor", "double")(lambda by: F.col("x") * by)
    with pytest.raises(ValueError):
        own.register("sensor", "double")(lambda by: F.col("x"))
    with pytest.raises(ValueError):
        own.register("thing")
    with pytest.raises(KeyError):
        own.get("predicate", "os.system")
    own.register("transformer", "plus")(lambda d: d.withColumn("y", F.col("x") + 1))
    df = spark.createDataFrame([(1, 2)], "id int, x int")
    assert own.observed(df, ["double"], by=3).first()["double"] == 6
    assert own.space(spark, df.schema, ["plus"]).names == ["id", "x", "y"]


def test_plans(spark):
    start = spark.createDataFrame([(["a"],)], "facts array<string>")
    actions = spark.createDataFrame([("one", ["a"], ["b"], []), ("two", ["b"], ["c"], ["a"])], "name string, needs array<string>, adds array<string>, removes array<string>")
    goal = lambda *f: spark.createDataFrame([(x,) for x in f], "fact string")
    assert [(r.plan, r.length) for r in graph.plans(start, actions, goal("c"), 5).collect()] == [(["one", "two"], 2)]
    assert graph.plans(start, actions, goal("c"), 1).count() == 0 and graph.plans(start, actions, goal("z"), 9).count() == 0


def test_deep_forest(spark):
    links = spark.range(1, 301).select(F.col("id").alias("child"), (F.col("id") - 1).alias("parent"))
    offsets = links.select("child", F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dz"))
    root = spark.createDataFrame([(0, 5.0, 0.0, 0.0)], "node long, x double, y double, z double")
    assert {r.node: (r.x, r.level) for r in graph.placed(links, offsets, root).collect()} == {i: (5.0 + i, i) for i in range(301)}


def test_profiles_and_templates(spark, tmp_path):
    import sqlite3

    for name, rows in (("a", [(1, 5, "x", 1), (2, None, "open", 1)]), ("b", None)):
        con = sqlite3.connect(tmp_path / f"{name}.sqlite")
        if rows:
            con.execute("CREATE TABLE NVTX_EVENTS (start BIGINT NOT NULL, end BIGINT, text STRING, globalTid BIGINT)")
            con.executemany("INSERT INTO NVTX_EVENTS VALUES (?, ?, ?, ?)", rows)
        else:
            con.execute("CREATE TABLE other (x)")
        con.commit()
        con.close()
    got = profiles.sqlite_events(spark, str(tmp_path)).collect()
    assert [(r.start, r.end, r.name, r.thread) for r in got] == [(1, 5, "x", 1)]
    assert [r.path[-8:] for r in profiles.sqlite_files(spark, str(tmp_path)).collect()] == ["a.sqlite", "b.sqlite"]
    (tmp_path / "c.json").write_text('{"mass": 2}')
    assert profiles.template(spark, str(tmp_path / "c.json")) == profiles.template(spark, '{"mass": 2}') == {"mass": 2}
    with pytest.raises(ValueError):
        profiles.template(spark, "{oops")


def test_datasets_and_writers(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"episodes": [{"episode_id": "1", "scene_id": "a/b.glb", "category": "bed"}], "goals_by_category": {"b.glb_bed": [{"x": 1.5}]}}))
    key = "concat(substring_index(scene_id, '/', -1), '_', category)"
    got = scenes.goal_episodes(spark, str(tmp_path / "e.json"), "episode_id: STRING, scene_id: STRING, category: STRING", "x: DOUBLE", key).first()
    assert got.episode_id == "1" and got.goals[0].x == 1.5
    (tmp_path / "v.json").write_text(json.dumps({"episodes": [{"episode_id": "1", "instruction": {"instruction_text": "go", "instruction_tokens": [2]}, "question": {"question_text": "q", "answer_text": "a", "answer_token": 3}}], "instruction_vocab": {"word_list": ["<pad>", "<unk>", "go"]}}))
    rows, words = scenes.instructions(spark, str(tmp_path / "v.json"))
    assert rows.first().instruction_text == "go" and {r.word: r.id for r in words.collect()}["go"] == 2
    assert scenes.questions(spark, str(tmp_path / "v.json")).first().answer_token == 3
    (tmp_path / "s.json").write_text(json.dumps({"stage_instance": {"template_name": "s"}, "object_instances": [{"template_name": "o"}, {"template_name": "o"}]}))
    assert {(r.kind, r.model) for r in scenes.scene_models(spark, str(tmp_path / "s.json")).collect()} == {("stage", "s"), ("object", "o")}
    one_frame = scenes.replay_keyframes(spark, '{"keyframe": {"deletions": [1]}}', "deletions ARRAY<BIGINT>")
    assert one_frame.first().deletions == [1] and scenes.replay_keyframes(spark, "oops", "deletions ARRAY<BIGINT>").count() == 0
    frames_ = spark.createDataFrame([(1, 0.123456789), (0, 2.0)], "seq int, x double")
    sinks.replay(frames_, str(tmp_path / "r"), digits=3)
    assert [k.x for k in spark.read.option("multiLine", True).json(str(tmp_path / "r")).first().keyframes] == [2.0, 0.123]
    sinks.replay(frames_, str(tmp_path / "ri"), incremental=True)
    assert spark.read.json(str(tmp_path / "ri")).select("keyframe.x").count() == 2
    sinks.scalars(spark.createDataFrame([(1, 2.0, None, "t")], "step int, loss double, lr double, note string"), str(tmp_path / "m"), "step", "train/")
    assert [(r.key, r.value) for r in spark.read.parquet(str(tmp_path / "m")).collect()] == [("train/loss", 2.0)]
    names = spark.createDataFrame([("active", "b"), ("active", "a")], "kind string, name string")
    sinks.receptacle_filters(names, str(tmp_path / "f"))
    assert spark.read.json(str(tmp_path / "f")).first().active == ["a", "b"]
    with pytest.raises(ValueError):
        sinks.receptacle_filters(spark.createDataFrame([("odd", "b")], "kind string, name string"), str(tmp_path / "g"))
    sinks.description(spark.createDataFrame([(" Go on. ",)], "description string"), str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["Go on."]


def test_salience(spark):
    rows = [("sofa", 10.0, 4.0), ("table", 12.0, 6.0), ("lamp", 15.0, None), ("door", 20.0, 9.0), ("wall", 50.0, 4.0)]
    df = frames.drop_labels(spark.createDataFrame([(0, i, *r) for i, r in enumerate(rows)], "frame int, ord int, label string, p double, d double"))
    got = frames.top_salient(df, "frame", frames.salience_order(F.col("p"), F.col("d"), F.col("ord")), 6)
    assert [r.label for r in got.orderBy("rank").collect()] == ["sofa", "table", "lamp", "door"]
    edges = {0.0: None, 0.99: "very close", 1.0: "near", 3.0: "mid-range", 5.0: "mid-range", 6.0: "slightly far", 6.01: "far"}
    assert {d: one(spark, frames.bucket(F.lit(d))) for d in edges} == edges


def test_relations(spark):
    for b, want in (((1, 0, -2), "left_of"), ((0, 1, -2), "on_top_of"), ((2, 0, -2), None)):
        df = spark.createDataFrame([(0, 0, [0.0, 0.0, -2.0]), (0, 1, [float(x) for x in b])], "f int, o int, c array<double>")
        got = [r.relation for r in frames.relations(df, "f", "o", "c").collect()]
        assert got == ([want] if want else [])


def test_relations_of_few_bytes_are_made_by_several_tasks(spark):
    """400 rows of one partition, some thousand pairs: each pair once, and not all by the task that reads the rows."""
    at = [(i % 5, i, [i * 7 % 13 / 9, i * 5 % 11 / 9, i * 3 % 17 / 9]) for i in range(400)]
    df = spark.createDataFrame(at, "f int, o int, c array<double>").coalesce(1)
    got = frames.relations(df, "f", "o", "c").withColumn("task", F.spark_partition_id()).collect()
    near = {(x[1], y[1]) for x in at for y in at if x[0] == y[0] and x[1] < y[1] and sum((p - q) ** 2 for p, q in zip(x[2], y[2], strict=True)) ** 0.5 <= 1.5}
    assert Counter((r.i, r.j) for r in got) == Counter(near)
    assert len({r.task for r in got}) > 1


def test_metrics(spark):
    assert one(spark, metrics.spl(F.lit(1.0), F.lit(5.0), F.lit(7.0))) == pytest.approx(5 / 7)
    assert one(spark, metrics.soft_spl(F.lit(0.0), F.lit(5.0), F.lit(7.0))) == pytest.approx(5 / 7)
    assert one(spark, metrics.spl(F.lit(1.0), F.lit(0.0), F.lit(0.0))) is None
    assert one(spark, metrics.discounted(v3(1, 1), v3(1, 1), 0.5)) == [1.5, 1]
    assert one(spark, metrics.gae(v3(1, 1), v3(0, 0), v3(1, 1), 0.5, 1.0)) == [1.5, 1]
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 6.0)], "t int, v double").withColumn("k", F.lit(0))
    got = df.select("t", metrics.windowed_mean(F.col("v"), metrics.over(["k"], ["t"]), 2).alias("m")).orderBy("t").collect()
    assert [r.m for r in got] == [1, 1.5, 4]
    some = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "k string, v double")
    assert metrics.mean_of_all(some, "k", "v", spark.range(4)).first().mean == 1 and metrics.mean_of_having(some, "k", "v").first().mean == 2


def test_splits(spark):
    df = spark.range(100).withColumnRenamed("id", "episode_id")
    sizes = lambda n, per=None: sorted(r["count"] for r in episodes.splits(df, "episode_id", n, "s", per).groupBy("split").count().collect())
    assert sizes(10) == [10] * 10 and sizes(11) == [9] * 11 and sizes(10, 3) == [3] * 10
    with pytest.raises(ValueError):
        episodes.splits(df, "episode_id", 10, "s", 11)
    assert episodes.sample(df, "episode_id", 100, "x").distinct().count() == 100
    with pytest.raises(ValueError):
        episodes.sample(df, "episode_id", 101, "x")


def test_strings(spark):
    assert one(spark, strings.tokenize(F.lit("What is it?"))) == ["what", "i", "s", "it", "?"]
    assert one(spark, strings.quoted_target(F.lit('Go to "The Sofa" now'))) == "the sofa"
    goal = one(spark, strings.reply_goal(F.lit("1. Kitchen, Table")))
    assert (goal.rule, goal.kind, goal.room, goal.object) == (1, "object_in_room", "Kitchen", "Table")
    kinds = {2: "room_only", 3: "ambiguous_object_rooms", 4: "ambiguous_room", 5: "object_in_single_room", 6: "object_repeated_in_room", 7: "not_found", 8: "friendly_conversation"}
    for rule, kind in kinds.items():
        goal = one(spark, strings.reply_goal(F.lit(f"{rule}. bedroom_1")))
        assert goal.kind == kind and (goal.room == "bedroom_1") == (rule in (2, 5, 6)) and (goal.message == "bedroom_1") == (rule in (3, 4, 7, 8))
    for text, error in (("hello", "format"), ("x. y", "format"), ("9. y", "rule"), ("1. kitchen", "room, object")):
        goal = one(spark, strings.reply_goal(F.lit(text)))
        assert goal.error == error and goal.rule is None and goal.kind is None
    assert one(spark, strings.bits(F.lit(5), 8)) == [0, 2]


def test_quantifiers_over_nothing(spark):
    df = spark.createDataFrame([], "k string, v boolean")
    assert logic.quantified(df, ["k"], "v").count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text('id stuff\n1,FF0000,"chair, big",2\n2,00FF00,"table",3\n')
    got = {r.id: (r.color, r.label, r.region) for r in scenes.annotations(spark, str(tmp_path / "a.txt"), "id stuff").collect()}
    assert got == {0: (0, "Unknown", -1), 1: (16711680, "chair, big", 2), 2: (65280, "table", 3)}
    assert [r.id for r in scenes.semantic_csv(spark, str(tmp_path / "a.txt")).collect()] == [2]
    with pytest.raises(ValueError):
        scenes.annotations(spark, str(tmp_path / "a.txt"), "other")
    (tmp_path / "h.house").write_text("ASCII 1.1\nH name\nL 0 2 a 1 2 3\nR 0 0 0 0 k 1 2 3\nC 0 4 dining#table 5 big#table\nO 0 0 0 1 2 3\n")
    house = scenes.house(spark, str(tmp_path / "h.house"))
    assert house["categories"].first().label == "dining table" and house["objects"].first().center == [1, 2, 3]
    assert scenes.kind_of(spark, str(tmp_path / "h.house")) == "house"
    (tmp_path / "o.json").write_text(json.dumps({"objects": [{"id": 5, "class_": "b"}, {"id": 6, "class_": "a"}, {"id": 7, "class_": "b"}]}))
    assert {(r.id, r.category) for r in scenes.class_objects(spark, str(tmp_path / "o.json")).collect()} == {(5, 1), (6, 2), (7, 1)}
    assert scenes.kind_of(spark, str(tmp_path / "o.json")) == "objects"
    assert scenes.keyframes(spark, str(tmp_path / "none.json"), "deletions ARRAY<BIGINT>").count() == 0
    bad = spark.createDataFrame([('{"a": 1}',), ("{oops",)], "value string")
    assert [r.a for r in scenes.messages(bad, "a INT").collect()] == [1]
    (tmp_path / "f.txt").write_text("x\nFPS: 12.5\nFPS: 13\n")
    assert scenes.fps_logs(spark, str(tmp_path / "f.txt")).first().fps == 12.5


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("r", "chair", 2), ("r", "bed", 1)], "room string, category string, n int")
    sinks.text_report(df, str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["r: bed: 1, chair: 2", "Categories: bed, chair"]
    sinks.json_files(df, str(tmp_path / "j"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.json_files(df, str(tmp_path / "j"), "error")
    assert sinks.rounded(spark.createDataFrame([(1.2345678, [0.1234567])], "a double, b array<double>")).first() == (1.23457, [0.12346])


def test_streams(spark, tmp_path):
    rows = [(1, 1, "create", 1.0), (1, 2, "update", 2.0), (2, 3, "create", 5.0), (2, 4, "delete", None), (3, 5, "create", 7.0), (3, 6, "update", 7.0)]
    df = spark.createDataFrame(rows, "k long, seq long, op string, v double")
    for i in range(3):
        df.filter(F.col("seq").isin(2 * i + 1, 2 * i + 2)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept = {"n": -1}

    def read(s):
        return s.read.parquet(f"{tmp_path}/state{kept['n']}") if kept["n"] >= 0 else s.createDataFrame([], "k long, seq long, v double")

    def write(new, number):
        new.write.mode("overwrite").parquet(f"{tmp_path}/state{number}")
        kept["n"] = number

    deltas.merge_stream(stream, read, write, "k", "seq", "op", "v", str(tmp_path / "cp")).awaitTermination()
    assert {(r.k, r.v) for r in read(spark).collect()} == {(r.k, r.v) for r in deltas.replay(df, "k", "seq", "op", "v").collect()} == {(1, 2.0), (3, 7.0)}
    changed = deltas.change_stream(stream.filter("v IS NOT NULL"), "k", "seq", "v")
    q = changed.writeStream.format("memory").queryName("changed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.k, r.seq) for r in spark.table("changed").collect()} == {(1, 1), (1, 2), (2, 3), (3, 5)}


def test_measures():
    from tessella.operators.registry import Measures

    own = Measures()
    own.register("a", ["b"])(lambda: F.col("b"))
    own.register("b", ["c"])(lambda: F.col("c"))
    own.register("c")(lambda: F.lit(1))
    assert own.order(["a"]) == ["c", "b", "a"]
    with pytest.raises(ValueError):
        own.register("a")(lambda: F.lit(1))
    own.register("x", ["y"])(lambda: F.lit(1))
    own.register("y", ["x"])(lambda: F.lit(1))
    with pytest.raises(ValueError):
        own.order(["x"])
    with pytest.raises(ValueError):
        own.order(["none"])
