import hashlib
import math
import re
import zlib
from collections import Counter

from tessella.llm import resample

from .data import documents, empty, prose, rows

LOWER = {c: c + 32 for c in range(65, 91)}


def features(text):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)) if w]
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def brute(table, target):
    """doc_id, text and target texts -> the rows by definition, over every row by itself."""
    bucket = lambda x: zlib.crc32(x.encode()) % 10000
    have, want = (Counter(bucket(f) for t in texts for f in features(t)[1]) for texts in ([t for _, t in table], target))
    s, t = sum(have.values()) + 10000, sum(want.values()) + 10000
    out = []
    for doc_id, text in table:
        words, own = features(text)
        gain = [math.floor(1000 * math.log((want[b] + 1) * s / ((have[b] + 1) * t))) for b in map(bucket, own)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= 20])
    may = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is not None, x[0]))
    rank = {id(x): i + 1 for i, x in enumerate(may[: 25 * len(may) // 100])}
    return Counter((*x[:4], rank.get(id(x))) for x in out)


def got(df):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect())


def test_awkward_rows(spark):
    target = [prose(2, 60), "Ann's MIT añb ÄÖ", None, ""]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(target)], "item_id long, text string, weight string")
    want = brute([(r[0], r[1]) for r in rows()], target)
    assert got(resample.resample(documents(spark, True), bench)) == want
    assert sum(x[4] is not None for x in want.elements()) == 3


def test_copies_ties_and_letters(spark):
    """A text that half the rows hold, ids that repeat, words of other scripts, one very long word and one very long text."""
    table = [(i, prose(50 + i % 7, 25) if i % 2 else "ÄRGER Straße İstanbul 東京 don't " * 8) for i in range(400)]
    table += [(7, table[7][1]), (9, "x" * 300_000), (10, prose(3, 200_000)), (11, "a-b" * 30)]
    target = [prose(51, 25), "straße ärger"]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(7)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    assert got(resample.resample(docs, bench)) == brute(table, target)


def test_texts_are_collapsed(spark):
    docs = spark.createDataFrame([(i, "one two one") for i in range(50)] + [(50, None), (51, "")], "doc_id long, text string")
    found = {r._words: (r._n, len(r._buckets)) for r in resample.collapsed(docs).collect()}
    assert found == {3: (50, 5), 0: (2, 0)}


def test_target_counts(spark):
    """Documents that talk like the target come first in the mean."""
    table = [(i, prose(100 + i, 40) if i % 4 else " ".join(["alpha beta gamma delta"] * 10)) for i in range(400)]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    out = resample.resample(docs, spark.createDataFrame([("alpha beta gamma delta " * 50,)] * 200, "text string")).filter("rank IS NOT NULL").collect()
    assert len(out) == 100 and sum(r.doc_id % 4 == 0 for r in out) > 60


def test_empty(spark):
    none = spark.createDataFrame([], "text string")
    assert resample.resample(empty(spark), none).count() == 0
    assert got(resample.resample(documents(spark), none)) == brute([(r[0], r[1]) for r in rows()], [])
