from collections import Counter

import numpy as np
import pytest

from tessella.llm import lines, mph

from .data import documents, empty, prose, rows

BLANK = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(table, least_docs=10, least_chars=1):
    key = lambda x: x.strip(BLANK).translate(LOWER)
    split = [(i, (t or "").split("\n")) for i, t in table]
    held = Counter(k for _, ls in split for k in {key(x) for x in ls})
    out = []
    for i, ls in split:
        gone = [held[key(x)] for x in ls if len(key(x)) >= least_chars and held[key(x)] >= least_docs]
        out.append((i, len(ls), len(gone), max(gone, default=0), "\n".join(x for x in ls if not (len(key(x)) >= least_chars and held[key(x)] >= least_docs))))
    return Counter(out)


def got(df):
    return Counter((r.doc_id, r.n_lines, r.n_dropped, r.most_docs, r.clean_text) for r in df.collect())


def test_awkward_rows(spark):
    for least in (2, 3, 10):
        assert got(lines.deduplicate(documents(spark, True), least)) == brute([r[:2] for r in rows()], least)
    assert lines.deduplicate(empty(spark)).count() == 0


def test_edges(spark):
    """Found in nine and in ten documents; many times in one; other case, other blanks; a third of all; letters that only look alike."""
    table = [(i, f"own line {i}\n" + ("Nine\n" if i < 9 else "") + ("\t TEN \r\n" if i < 10 else "") + ("ten\n" if i == 3 else "") + ("Share this\n" if i % 3 == 0 else "") + ("É\n" if i < 6 else "é\n" if i < 12 else "")) for i in range(60)]
    table += [(100, "again\n" * 50), (101, " ten \nten"), (102, "Share this"), (103, "x" * 2_000_000 + "\nshare this\n" + prose(4, 100_000)), (103, "\n\n")]
    want = brute(table)
    assert got(lines.deduplicate(spark.createDataFrame(table, "doc_id long, text string").repartition(6))) == want
    dropped = {x[0]: x[2] for x in want}
    assert dropped[3] == 3 and dropped[100] == 0 and dropped[102] == 1 and dropped[12] == 1


def test_least_chars(spark):
    table = [(i, "ab\nabc\n日本\n日本語\n" + str(i)) for i in range(12)]
    assert got(lines.deduplicate(spark.createDataFrame(table, "doc_id long, text string"), 10, 3)) == brute(table, 10, 3)


def test_many_shards(spark):
    """One index for two limits, in shards of a few names each."""
    table = [(i, "\n".join(f"Line {j}" for j in range(i, i + 40))) for i in range(300)]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    assert got(lines.deduplicate(docs, 20, shard_keys=3)) == brute(table, 20)
    counts = lines.counted(docs)
    own = lines.index(counts, lines.uri(spark) + "/own-lines", 10)
    assert own.bits >= 5 and len(own.present) > 16
    assert own.counts([b"line 60", b"line 0", b"no such line"]).tolist() == [40, 1, 0]
    assert got(lines.drop(docs, own, 35)) == brute(table, 35)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    hi, lo = rng.integers(0, 1 << 63, n).astype(np.uint64), rng.integers(0, 1 << 63, n).astype(np.uint64)
    hi[: n // 2] = hi[: n // 2] // 1000 * 0 + 7  # half of the names share their first half
    counts = rng.integers(1, 1 << 40, n)
    made = mph.load(mph.build(hi, lo, counts).dump())
    assert sorted(made.index(hi, lo).tolist()) == list(range(n))
    assert (made.lookup(hi, lo) == np.minimum(counts, 0xFFFFFFFF)).all()
    assert not made.lookup(hi, lo ^ np.uint64(1)).any() and not made.lookup(np.full(9, 5, np.uint64), np.arange(9, dtype=np.uint64)).any()
    if n == 5000:
        assert len(made.dump()) < 14 * n


def test_written_twice(tmp_path):
    """A task that runs again changes nothing, and leaves no part behind."""
    made = mph.build(np.arange(9, dtype=np.uint64), np.arange(9, dtype=np.uint64), np.arange(9))
    for attempt in ("a", "b"):
        mph.save(f"file://{tmp_path}/x", 3, made, attempt)
    assert [p.name for p in (tmp_path / "x").iterdir()] == ["00000003.mph"]
    assert mph.fetch(f"file://{tmp_path}/x", 3).lookup(np.array([4], np.uint64), np.array([4], np.uint64)).tolist() == [4]
