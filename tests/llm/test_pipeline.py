import uuid
from collections import Counter

import pytest

import corpus_pipeline
from tessella.llm import pii, queries

from .data import SCHEMA, documents, prose, rows
from .test_forest import brute, shingle_set
from .test_native import contained

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder of tables: the awkward rows, a benchmark item and labels with an insult."""
    d = str(tmp_path_factory.mktemp("tables"))
    extra = [(200 + i, prose(700 + i, 80) + (" snotface" * 4 if i % 3 == 0 else ""), "en", "s1", 0) for i in range(90)]
    spark.createDataFrame([*rows(), *extra], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int("snotface" in r[1])) for r in extra], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, prose(2, 60))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    toxic = {r.doc_id for r in left["toxicity"]}
    assert not {200 + i for i in range(0, 90, 3)} & toxic and {200 + i for i in range(90) if i % 3} <= toxic
    alone = [r.doc_id for r in left["near_dedup"]]
    assert {0, 3, 4, 5} <= set(alone) and 1 not in alone and 2 not in alone and alone.count(0) == 1
    clean = {r.doc_id for r in left["decontamination"]}
    assert not {3, 4} & clean and {0, 5} <= clean
    assert all("ann.lee" not in (r.text or "") for r in left["pii"])
    assert len(left["mixing"]) == len(left["pii"])
    # each stage against brute force on its own input
    worded = lambda name: [r for r in left[name] if shingle_set(r.text)]
    blank = lambda name: Counter((r.doc_id, r.text) for r in left[name] if not shingle_set(r.text))
    groups = {k[2] if k[2] is not None else ("alone", k[0]) for k in brute([(r.doc_id, r.text) for r in left["toxicity"]], 80) if k[1]}
    assert len(worded("near_dedup")) == len(groups) and blank("near_dedup") == blank("toxicity")
    item = prose(2, 60)
    found = {r.doc_id for r in left["near_dedup"] if contained(r.text, item)[0] >= 0.8 * contained(r.text, item)[1]}
    assert Counter(r for r in left["decontamination"]) == Counter(r for r in left["near_dedup"] if r.doc_id not in found)
    assert Counter((r.doc_id, r.text) for r in left["pii"]) == Counter((r.doc_id, r.text and pii.mask(r.text, pii.KEY)[0]) for r in left["decontamination"])
    sizes = Counter((r.doc_id, len((r.text or "").split())) for r in left["pii"])
    assert Counter((r.doc_id, r["size"]) for r in left["mixing"]) == sizes and all(r.taken <= 3 * r["size"] for r in left["mixing"])


def test_stages_of_empty_tables(spark, tmp_path):
    """No labels, no benchmark, no documents; and clashing names."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    few = documents(spark, True).filter("doc_id IN (3, 6, 7)")
    for docs, n in ((documents(spark).limit(0), 0), (few, 3)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.count() == n, name
            assert name == "mixing" or out.columns == docs.columns


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "size", "taken", "target"} <= set(out.columns) and out.count() > 50


def test_queries_are_registered(spark):
    names = queries.queries()
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)


def test_texts_go_to_python_a_few_mb_at_a_time(spark, folder, tmp_path, monkeypatch):
    """Rows of one partition, 20 MB, are held neither outside the JVM's heap nor in a worker as one batch."""
    seen, frame = tmp_path / "seen", type(spark.range(0))
    plain = frame.mapInArrow
    seen.mkdir()

    def noted(df, run, schema):
        def sized(batches):
            for b in batches:
                (seen / f"{uuid.uuid4().hex}-{b.nbytes}").touch()
                yield b

        return plain(df, lambda batches: run(sized(batches)), schema)

    monkeypatch.setattr(frame, "mapInArrow", noted)
    long = [(i, prose(9000 + i % 20, 1500), "en", "s1", 0) for i in range(2000)]
    spark.createDataFrame(long, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/long")
    docs = spark.read.parquet(f"{tmp_path}/long")
    size = docs.selectExpr("sum(octet_length(text))").first()[0]
    for name, stage in corpus_pipeline.STAGES:
        if name in ("toxicity", "pii"):
            before = set(seen.iterdir())
            stage(spark, docs, folder).write.format("noop").mode("overwrite").save()
            sizes = [int(p.name.split("-")[1]) for p in set(seen.iterdir()) - before]
            assert sum(sizes) >= size > 15_000_000 and max(sizes) < 6_000_000, name
