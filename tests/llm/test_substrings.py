import hashlib
import random
import re
from collections import Counter

import pytest

from tessella.llm import repeats, substring, suffix

from .data import documents, empty, prose, rows


def brute_words(table, window):
    all_of = [[w for w in re.split(r"[\x20\x09-\x0D]+", r[1] or "") if w] for r in table]
    often = Counter(tuple(w[i : i + window]) for w in all_of for i in range(len(w) - window + 1))
    out = Counter()
    for r, w in zip(table, all_of, strict=True):
        gone = {j for i in range(len(w) - window + 1) if often[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def brute_bytes(table, window):
    all_of = [(r[1] or "").encode() for r in table]
    often = Counter(b[i : i + window] for b in all_of for i in range(len(b) - window + 1))
    out = Counter()
    for r, b in zip(table, all_of, strict=True):
        keep = bytearray(b"k" * len(b))
        for i in range(len(b) - window + 1):
            if often[b[i : i + window]] > 1:
                keep[i : i + window] = b"." * window
        kept = bytes(x for x, f in zip(b, keep, strict=True) if f == ord("k"))
        out[r[0], len(b), len(b) - len(kept), len(re.findall(rb"\.+", keep)), hashlib.sha256(kept).hexdigest()] += 1
    return out


def passages():
    """Many documents that share a passage in contexts of their own, and texts that repeat themselves."""
    shared = prose(50, 50)
    table = [(i, prose(500 + i, 30 + i) + " " + shared + " " + prose(900 + i, 25)) for i in range(40)]
    return [*table, (100, "a b c d e " * 50), (101, "é" * 300), (102, shared), (103, shared + " x")]


@pytest.mark.parametrize("bucket", [1000, 5])
def test_substring(spark, monkeypatch, bucket):
    monkeypatch.setattr(repeats, "BUCKET", bucket)
    for table in (rows(), passages()):
        df = documents(spark, True) if table == rows() else spark.createDataFrame(table, "doc_id long, text string")
        got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(df).collect())
        assert got == brute_words(table, 35)


@pytest.mark.parametrize("bucket", [1000, 5])
def test_suffix(spark, monkeypatch, bucket):
    monkeypatch.setattr(repeats, "BUCKET", bucket)
    for table in (rows(), passages()):
        df = documents(spark, True) if table == rows() else spark.createDataFrame(table, "doc_id long, text string")
        out = suffix.remove_repeats(df).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == brute_bytes(table, 200)
        assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in out)


def test_empty(spark):
    assert substring.remove_repeats(empty(spark)).count() == 0
    assert suffix.remove_repeats(empty(spark)).count() == 0


def test_transform_against_sorted_suffixes(tmp_path):
    import numpy as np

    rng = random.Random(3)
    for _ in range(60):
        strings = [np.array([rng.choice((1, 2, 700)) for _ in range(rng.randint(0, 12))], np.uint16) for _ in range(rng.randint(1, 8))]
        bwt, lcp = suffix.build(strings, 200, str(tmp_path))
        order = sorted((s[i:].tolist(), k, i) for k, s in enumerate(strings) for i in range(len(s) + 1))
        assert sorted(np.fromfile(bwt, np.uint16).tolist()) == sorted(int(strings[k][i - 1]) if i else suffix.END for _, k, i in order)
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert np.fromfile(lcp, np.uint8).tolist() == [0] + [common(order[i - 1][0], order[i][0]) for i in range(1, len(order))]


def test_breaks_are_alike_to_nothing(tmp_path):
    import numpy as np

    strings = [np.array([3, suffix.BREAK, 4], np.uint16)] * 2
    _, lcp = suffix.build(strings, 200, str(tmp_path))
    # the suffixes: twice each of nothing, BREAK 4, 3 BREAK 4, and 4
    assert np.fromfile(lcp, np.uint8).tolist() == [0, 0, 0, 0, 0, 1, 0, 1]


def test_shared_windows():
    rng = random.Random(1)
    for _ in range(60):
        w = rng.choice([2, 3, 5, 8, 12, 16])
        base = bytes(rng.choice(b"ab") for _ in range(60))
        strings = [base[(a := rng.randint(0, 25)) : a + rng.randint(0, 35)] + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 10))) for _ in range(rng.randint(1, 12))]
        counts = [max(len(s) - w + 1, 0) for s in strings]
        often = Counter(s[i : i + w] for s in set(strings) for i in range(len(s) - w + 1))
        want = [[often[s[i : i + w]] > 1 for i in range(n)] for s, n in zip(strings, counts, strict=True)]
        assert [f.tolist() for f in suffix.shared_windows(strings, counts, w)] == want
