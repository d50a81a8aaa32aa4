import random
import re
from collections import Counter

import pytest

from pyspark.sql import functions as F

from tessella.llm import forest

from .data import documents, empty, prose, rows


def shingle_set(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(table, percent=85):
    sets = [shingle_set(r[1]) for r in table]
    group = list(range(len(table)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                group[find(i)] = find(j)
    least = {}
    for i, r in enumerate(table):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(table))


def test_components(spark):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in forest.clusters(documents(spark, True)).collect())
    assert got == brute(rows())
    assert forest.clusters(empty(spark)).count() == 0


@pytest.fixture(scope="module")
def crowd():
    base = prose(20, 200).split()
    table = []
    for i in range(150):  # one large group of near copies, each with an edit of its own
        copy = list(base)
        copy[i] = f"w{i}"
        table.append((i, " ".join(copy)))
    for i in range(30):
        t = prose(100 + i, 60)
        table += [(1000 + 3 * i, t), (1001 + 3 * i, t + " end"), (1002 + 3 * i, prose(300 + i, 60))]
    return table


def test_crowd(spark, crowd):
    df = spark.createDataFrame(crowd, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in forest.clusters(df).collect())
    assert got == brute(crowd)


def test_blocks_are_bounded(spark, crowd, monkeypatch):
    """Crowds are told apart to any size asked for, and every member is in a block; those who speak join the blocks again."""
    df = spark.createDataFrame(crowd, "doc_id long, text string")
    monkeypatch.setattr(forest, "MEMBERS", 20)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in forest.clusters(df).collect())
    assert got == brute(crowd)
    signed = df.withColumn("_text_hash", F.xxhash64("text")).mapInArrow(forest._sign, forest.SIGNED)
    members = signed.select("node", "n_shingles", "lead", F.lit(b"c").alias("crowd"), F.lit(True).alias("large"))
    held = forest.blocks(members)
    assert held.select("node").distinct().count() == signed.select("node").distinct().count()
    assert max(r["count"] for r in held.groupBy("block").count().collect()) <= 20 * 2  # dealt by hash at the end


def test_rows_without_words_stay_whatever_repeats(spark):
    plain = [(1, None), (2, ""), (2, ""), (None, None), (3, " "), (4, "one two"), (None, "four")]
    for more in ([], [(9, "some words here"), (9, "some words here")], [(9, "Some words here"), (9, "some words here")]):
        out = Counter((r.doc_id, r.text) for r in forest.deduplicate(spark.createDataFrame(plain + more, "doc_id long, text string")).collect())
        assert not Counter(plain) - out and sum(out.values()) == len(plain) + bool(more)


def test_deduplicate(spark):
    out = forest.deduplicate(documents(spark, True)).collect()
    want = brute(rows(), 80)
    components = {k[2] if k[2] is not None else ("alone", k[0]) for k in want if k[1] > 0}
    with_words = [r for r in out if shingle_set(r.text)]
    assert len(with_words) == len(components)
    assert sum(1 for r in out if not shingle_set(r.text)) == sum(n for k, n in want.items() if k[1] == 0)
    assert out[0].asDict().keys() == documents(spark, True).limit(1).collect()[0].asDict().keys()


def test_links_inside_a_crowd(spark, monkeypatch):
    """Pairs at 0.85 to 0.9 among documents of one template at about 0.6: all are linked, in one block and in several."""
    base, table = prose(50, 400).split(), []
    rng = random.Random(5)
    for i in range(260):
        copy = list(base)
        for k in rng.sample(range(4, 396, 10), 10):
            copy[k] = f"w{i}x{k}"
        table.append((i, " ".join(copy)))
    for i in range(40):  # a partner that differs in some more words
        copy = table[i][1].split()
        for k in rng.sample(range(9, 396, 10), 5):
            copy[k] = f"v{i}x{k}"
        table.append((1000 + i, " ".join(copy)))
    sets = [shingle_set(t) for _, t in table]
    shares = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i]]
    assert sum(x >= 0.85 for x in shares) >= 40 and all(x < 0.9 for x in shares)
    df = spark.createDataFrame(table, "doc_id long, text string")
    want = brute(table)
    for members, block in ((forest.MEMBERS, forest.BLOCK), (30, 20_000)):  # in one block, and in several
        monkeypatch.setattr(forest, "BLOCK", block)
        monkeypatch.setattr(forest, "MEMBERS", members)
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in forest.clusters(df).collect()) == want


def test_pages_of_one_template(spark, monkeypatch):
    """Thousands of pages alike at about 0.78 with pairs at 0.86 to 0.9: every pair is found, though no task may hold more than 100."""
    rng, head = random.Random(8), prose(70, 190).split()
    table = []
    for i in range(1200):
        own = [f"i{i}w{k}" for k in range(22)]
        table.append((i, " ".join(head + own)))
        if i % 12 == 0:
            table.append((10_000 + i, " ".join(head + own[: rng.randint(10, 14)] + [f"z{i}w{k}" for k in range(8)])))
    monkeypatch.setattr(forest, "MEMBERS", 100)
    sets = {d: shingle_set(t) for d, t in table}
    assert all(0.85 <= len(sets[i] & sets[10_000 + i]) / len(sets[i] | sets[10_000 + i]) < 0.95 for i in range(0, 1200, 12))
    out = {r.doc_id: r.component_id for r in forest.clusters(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert out == {d: d % 10_000 for d, _ in table}
