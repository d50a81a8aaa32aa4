"""Folds and messages over streams give what they give in batch."""

import json
import random

from pyspark.sql import functions as F

from tessella.operators import scans
from tessella.sources import scenes
from tessella.streaming import deltas

SCHEMA = "k long, t long, at double"


def requests(spark, folder, parts=3):
    rng, clock, rows = random.Random(1), 0.0, []
    for i in range(90):
        clock += rng.choice([0.05, 0.4, 3.0])
        rows.append({"k": rng.randrange(4), "t": i, "at": clock})
    for p in range(parts):
        (folder / f"{p}.json").write_text("".join(json.dumps(r) + "\n" for r in rows[p * 30 : p * 30 + 30]))
    return spark.createDataFrame([(r["k"], r["t"], r["at"]) for r in rows], SCHEMA)


def test_limiter(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    batch = requests(spark, source)
    for name, fold in (("limited", scans.limited(0.5)), ("rates", scans.rates(2.0))):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
        out = deltas.folded_stream(stream, "k", "t", ["at"], fold)
        query = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        want = scans.scanned(batch, "k", F.col("t"), [F.col("at")], fold, "t")
        assert sorted(spark.table(name).collect()) == sorted(want.collect()) and query.exception() is None
        assert want.count() > 5


def test_messages_and_fan_out(spark, tmp_path):
    """Lines that are no JSON are dropped, each user gets its own in order, and every batch is told once."""
    source = tmp_path / "in"
    source.mkdir()
    lines = [json.dumps({"user": i % 3, "seq": i, "body": f"m{i}"}) for i in range(12)]
    (source / "0.txt").write_text("\n".join([*lines[:6], "{oops", ""]))
    stream = scenes.messages(spark.readStream.text(str(source)), "user INT, seq INT, body STRING").filter("user IS NOT NULL")
    payload = stream.withColumn("payload", F.to_json(F.struct("seq", "body")))
    send = lambda: deltas.fan_out(payload, "user", "seq", "payload", str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    send()
    (source / "1.txt").write_text("\n".join(lines[6:]))
    send()
    told = {}
    for file in sorted((tmp_path / "out").glob("batch=*/user=*/*.txt")):
        user = int(file.parent.name.removeprefix("user="))
        told.setdefault(user, []).append([x["seq"] for x in json.loads(file.read_text())["keyframes"]])
    assert told == {0: [[0, 3], [6, 9]], 1: [[1, 4], [7, 10]], 2: [[2, 5], [8, 11]]}
