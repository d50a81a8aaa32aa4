"""Words that a sum modulo 2**64 can't tell apart, and texts longer than one pass."""

import hashlib

import numpy as np

from tessella.llm import forest, kernels, substring

from .data import prose


def doubled(n, a="a", b="b"):
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_hashes():
    for n in (2, 64, 128, 1024, 4096):
        a, b = (x.encode() for x in doubled(n))
        assert a != b and len(a) == len(b) == n
        buf = np.frombuffer(a + b" " + b, np.uint8)
        start, end, _ = kernels.words(buf, np.array([0, len(buf)]))
        h = kernels.word_hash(buf, start, end)
        assert h[0] != h[1], n


def test_documents_of_doubled_words(spark):
    """No shingle in common, so no link; one word differs, so no window repeats."""
    one, two = doubled(1024)
    docs = spark.createDataFrame([(1, " ".join([one] * 5)), (2, " ".join([two] * 5)), (3, " ".join([one] * 5))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in forest.clusters(docs).collect()} == {1: 1, 2: 2, 3: 1}
    rest = prose(4, 34)
    docs = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}")], "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(docs).collect()} == {1: (35, 0), 2: (35, 0)}


def test_texts_longer_than_a_pass(spark):
    long = prose(5, 400_000)
    words = long.split()
    assert len(long) > 1.5 * kernels.PASS_BYTES
    near = " ".join([*words[:1000], "other", *words[1001:]])
    passage = " ".join(words[300_000:300_050])
    docs = spark.createDataFrame([(1, long), (2, near), (3, f"some own words {passage} and more"), (4, prose(6, 50))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in forest.clusters(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    got = {r.doc_id: r for r in substring.remove_repeats(docs).collect()}
    assert (got[3].n_removed, got[3].clean_text) == (50, "some own words and more") and got[4].n_removed == 0
    seen, twice = set(), set()
    for w in (words, near.split(), f"some own words {passage} and more".split()):
        for i in range(len(w) - 34):
            g = hashlib.md5(" ".join(w[i : i + 35]).encode()).digest()
            (twice if g in seen else seen).add(g)
    w, gone = near.split(), set()
    for i in range(len(w) - 34):
        if hashlib.md5(" ".join(w[i : i + 35]).encode()).digest() in twice:
            gone.update(range(i, i + 35))
    assert got[2].n_removed == len(gone)


def test_memory_of_a_pass():
    """Each core's worker holds a pass; two of 107 MB did not fit beside an executor's heap."""
    import tracemalloc

    import pyarrow as pa

    from tessella.llm import toxicity

    texts = pa.array([prose(7, 400) + f" {i}" for i in range(2000)])
    model = toxicity.Model(np.zeros(toxicity.BUCKETS + 1, np.float32), 0.0, 0.0)
    tracemalloc.start()
    model.scores(*kernels.column(texts))
    for _ in forest.lowered(pa.record_batch([texts], ["text"])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6
