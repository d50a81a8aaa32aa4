"""Windows that repeat anywhere in a corpus, found bucket by bucket of super-k-mers (free style).

Both substring operators share the way there and back:

1. Each document is cut into segments: runs of consecutive windows with the same minimiser (the smallest hash of k
   symbols within a window).  Equal windows have equal minimisers, so only segments of one minimiser can share a window.
2. Minimisers that come once in all drop out, with them all that can't repeat.
3. Segments that are alike as a whole are counted before anything is moved; all their windows repeat.
4. Where a minimiser has several different segments, one copy of each travels as a packed string to the minimiser's bucket,
   where `decide` says exactly which windows occur in more than one of them.  A bucket of more than BUCKET
   segments is dealt out in parts; what is single in its part meets that of the others once more, by slots of digests.
5. The repeated windows go back to every row that holds the segment, and become spans of its text.

Hashes of 64 bits name minimisers, and segments within a minimiser; rows are known by doc_id and a hash of the text.  The windows of
different segments are compared byte by byte, those of different parts of a bucket by digests of 128 bits."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import U64, _BASE, _INVERSE, column, mix, passes, powers, prefix, range_hash, segments, window_hash, word_hash, words
from .native import narrow
from .store import cut

#: Segments of one bucket, or of several small ones, that are decided together.
BUCKET = 1000
#: (start * RUN + number of windows) * RUN + distance of the minimiser is one number; runs are shorter than RUN.
RUN = 1 << 10


@dataclass(frozen=True)
class Unit:
    """What a symbol is: a byte or a word."""

    word: bool
    window: int
    k: int

    def cut(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """document, start, windows, minimiser's distance from the start, minimiser, segment hash; starts count within the document."""
        if self.word:
            start, end, first = words(buf, off)
            h = word_hash(buf, start, end)
            grams = window_hash(h, self.k)
            sums = np.zeros(len(h) + 1, U64)
            np.cumsum(h * powers(_BASE, len(h)), out=sums[1:])
        else:
            sums = prefix(buf)
            first = off
            at = np.arange(max(len(buf) - self.k + 1, 0))
            grams = range_hash(sums, at, at + self.k)
        doc, begin, n, best = segments(grams, first, self.window, self.k)
        last = begin + n + self.window - 1
        name = mix((sums[last] - sums[begin]) * powers(_INVERSE, len(sums))[begin] + n.astype(U64))
        return doc, begin - first[doc], n, best - begin, grams[best] if len(best) else np.zeros(0, U64), name


def _rows(batch: pa.RecordBatch, unit: Unit) -> Iterator[tuple]:
    buf, off = column(batch.column("text"))
    for a, z in passes(off):
        doc, *rest = unit.cut(buf[off[a] : off[z]], off[a : z + 1] - off[a])
        yield (doc + a, *rest)


def _bounds(unit: Unit) -> Callable:
    """Minimisers with their counts, summed for each pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, mz, _name in _rows(batch, unit):
                value, n = np.unique(mz, return_counts=True)
                yield pa.record_batch([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], ["mz", "n"])

    return run


def _references(unit: Unit) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, text_hash = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_row", "_hash"))
            for doc, begin, n, far, mz, name in _rows(batch, unit):
                yield pa.record_batch([pa.array(mz.view(np.int64)), pa.array(name.view(np.int64)), pa.array(row[doc]), pa.array(text_hash[doc]), pa.array((begin * RUN + n) * RUN + far)], ["mz", "seg", "_row", "_hash", "at"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = [squeeze.compress(t.as_buffer()) if t.is_valid else None for t in batch.column("text")]
        at = batch.schema.get_field_index("text")
        yield pa.record_batch([pa.array(texts, pa.binary()) if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)


def unpack(value: bytes | None) -> bytes:
    return zstandard.ZstdDecompressor().decompress(value) if value else b""


def _extract(unit: Unit) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for text, wanted in zip(batch.column("text"), batch.column("_wanted"), strict=True):
                text = unpack(text.as_py())
                tokens = None
                if unit.word:
                    buf = np.frombuffer(text, np.uint8)
                    start, end, _ = words(buf, np.array([0, len(buf)]))
                    tokens = [text[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                for x in wanted.as_py():
                    begin, n, far = x["at"] // RUN // RUN, x["at"] // RUN % RUN, x["at"] % RUN
                    past = begin + n + unit.window - 1
                    rows.append((x["mz"], x["part"], x["parts"], x["seg"], x["once"], n, far, b" ".join(tokens[begin:past]) if unit.word else text[begin:past]))
                    size += len(rows[-1][-1])
                if size > 4 << 20:
                    yield pa.record_batch([list(c) for c in zip(*rows, strict=True)], schema=_PACKED)
                    rows, size = [], 0
            if rows:
                yield pa.record_batch([list(c) for c in zip(*rows, strict=True)], schema=_PACKED)

    return run


_PACKED = pa.schema([("mz", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("seg", pa.int64()), ("once", pa.bool_()), ("n", pa.int64()), ("far", pa.int64()), ("packed", pa.binary())])
PACKED = "mz long, part int, parts int, seg long, once boolean, n long, far long, packed binary"
#: What is found of a segment (runs), or what a part sends on (records).
DECIDED = "mz long, seg long, runs array<struct<first:long,n:long>>, part int, slot int, records binary"
_RUNS = pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))
_DECIDED = pa.schema([("mz", pa.int64()), ("seg", pa.int64()), ("runs", _RUNS), ("part", pa.int32()), ("slot", pa.int32()), ("records", pa.binary())])
#: A window that is the only one of its part: its digest, its segment and its place in it.
RECORD = np.dtype([("a", "<u8"), ("b", "<u8"), ("seg", "<i8"), ("at", "<i4")])


class Segment(NamedTuple):
    """n windows in `packed`; its minimiser begins `far` symbols from the start of the first."""

    mz: int
    part: int
    parts: int
    seg: int
    once: bool
    n: int
    far: int
    packed: bytes


#: For each segment whether each of its windows is in a different one of the same minimiser too; a window is known by its bytes.
Decide = Callable[[list[Segment]], list[np.ndarray]]


def runs_of(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    """first, length of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    yield from zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist(), strict=True)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([list(c) for c in zip(*rows, strict=True)] if rows else [[]] * len(_DECIDED), schema=_DECIDED)


def _found(mz: int, seg: int, flags: np.ndarray) -> list[tuple]:
    runs = [{"first": a, "n": n} for a, n in runs_of(flags)]
    return [(mz, seg, runs, None, None, None)] if runs else []


def _decide(decide: Decide, windows: Callable[[bytes, int], list[bytes]]) -> Callable:
    """Rows sorted by minimiser and part, several whole buckets or one part of a large one at a time.

    Of a part (part >= 0) one record of each of its windows is sent on, to meet those of the other parts: the records
    with one digest meet in one of as many slots as there are parts."""

    def work(held: list[Segment]) -> pa.RecordBatch:
        rows, seen = [], {}
        for x, f in zip(held, decide(held), strict=True):
            if x.once:
                rows += _found(x.mz, x.seg, f)
            if x.part >= 0:
                for i, window in enumerate(windows(x.packed, x.n)):
                    seen.setdefault(hashlib.blake2b(window, digest_size=16).digest(), (x.seg, i))
        if seen:
            sent = np.empty(len(seen), RECORD)
            digests = np.frombuffer(b"".join(seen), np.uint64).reshape(-1, 2)
            sent["a"], sent["b"] = digests.T
            sent["seg"], sent["at"] = np.array(list(seen.values()), np.int64).T
            slot = sent["a"] % U64(held[0].parts)
            rows += [(held[0].mz, None, None, held[0].part, int(k), sent[slot == k].tobytes()) for k in np.unique(slot)]
        return _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Segment] = []
        for batch in batches:
            for x in map(Segment, *[batch.column(c).to_pylist() for c in Segment._fields]):
                if held and (x.mz, x.part) != (held[-1].mz, held[-1].part) and (len(held) >= BUCKET or x.part >= 0 or held[-1].part >= 0):
                    yield work(held)
                    held = []
                held.append(x)
        if held:
            yield work(held)

    return run


def _together(batches: Iterator[pa.RecordBatch], key: tuple[str, str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Sorted rows, those with one key at a time."""
    held: list[dict] = []
    for batch in batches:
        for x in batch.to_pylist():
            if held and any(x[k] != held[-1][k] for k in key):
                yield tuple(held[-1][k] for k in key), held
                held = []
            held.append(x)
    if held:
        yield tuple(held[-1][k] for k in key), held


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of one slot, by (mz, slot): those whose digest comes from several parts go back to their parts."""
    for (mz, _), held in _together(batches, ("mz", "slot")):
        records = [np.frombuffer(x["records"], RECORD) for x in held]
        every, part = np.concatenate(records), np.repeat([x["part"] for x in held], [len(r) for r in records])
        order = np.lexsort((every["b"], every["a"]))
        every, part = every[order], part[order]
        same = (every["a"][1:] == every["a"][:-1]) & (every["b"][1:] == every["b"][:-1])  # a part sends a digest once
        several = np.append(same, False) | np.append(False, same)
        yield _batch([(mz, None, None, int(p), None, every[several & (part == p)].tobytes()) for p in np.unique(part[several])])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that came back, by (mz, part), to the runs of each segment."""
    for (mz, _), held in _together(batches, ("mz", "part")):
        every = np.concatenate([np.frombuffer(x["records"], RECORD) for x in held])
        every = every[np.lexsort((every["at"], every["seg"]))]
        edge = np.flatnonzero(np.append(True, every["seg"][1:] != every["seg"][:-1]))
        rows = []
        for a, z in zip(edge.tolist(), [*edge[1:].tolist(), len(every)], strict=True):
            flags = np.zeros(every["at"][z - 1] + 1, bool)
            flags[every["at"][a:z]] = True
            rows += _found(mz, int(every["seg"][a]), flags)
        yield _batch(rows)


def run_length(at: Column) -> Column:
    return F.pmod(F.shiftright(at, RUN.bit_length() - 1), F.lit(RUN)).cast("long")


def repeats(docs: DataFrame, unit: Unit, decide: Decide, windows: Callable[[bytes, int], list[bytes]]) -> DataFrame:
    """docs (_row, _hash, text) -> _row, _hash, spans: array of (first, past) symbols covered by repeated windows, for the rows that have any.

    Rows that are alike in (_row, _hash) must be alike in text."""
    own = docs.select("_row", "_hash", "text")
    often = own.select("text").mapInArrow(_bounds(unit), "mz long, n long").groupBy("mz").agg(F.sum("n").alias("_n")).filter("_n > 1")
    refs = own.mapInArrow(_references(unit), "mz long, seg long, _row long, _hash long, at long")
    # dealt anew, so that both sides of the join have a shuffle of their own and Spark may split a hot minimiser
    often = often.select("mz").repartition(F.xxhash64("mz"))
    refs = cut(refs.join(often, "mz", "left_semi"))
    alike = cut(refs.groupBy("mz", "seg").agg(F.count(F.lit(1)).alias("_c"), F.min(F.struct("_row", "_hash", "at")).alias("_h")))
    several = alike.groupBy("mz").agg(F.count(F.lit(1)).alias("_d"), F.min("_c").alias("_least")).filter("_d > 1 AND _least = 1")
    parts = F.ceil(F.col("_d") / F.lit(BUCKET)).cast("int")
    part = F.when(parts > 1, F.pmod(F.xxhash64("seg"), parts)).otherwise(F.lit(-1)).cast("int")
    segment = F.struct("mz", "seg", F.col("_h.at").alias("at"), part.alias("part"), parts.alias("parts"), (F.col("_c") == 1).alias("once"))
    wanted = alike.join(several, "mz").select("_h._row", "_h._hash", segment.alias("_w"))
    wanted = wanted.groupBy("_row", "_hash").agg(F.collect_list("_w").alias("_wanted"))
    packed = own.filter(F.length("text") > 0).mapInArrow(_pack, "_row long, _hash long, text binary")
    shipped = packed.join(wanted, ["_row", "_hash"]).select("text", "_wanted").mapInArrow(_extract(unit), PACKED)
    # rows that repeat bring the same segment twice
    # a number of its own: a decision costs far more than its bytes tell, so small partitions must not be merged
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shipped = shipped.repartition(tasks, "mz", "part").sortWithinPartitions("mz", "part", "seg")
    decided = cut(shipped.mapInArrow(_decide(decide, windows), DECIDED))
    # what is single in its part of a hot minimiser: a row for each part and slot, not for each window
    met = decided.filter(F.col("slot").isNotNull()).repartition(tasks, "mz", "slot").sortWithinPartitions("mz", "slot").mapInArrow(_meet, DECIDED)
    across = met.repartition(tasks, "mz", "part").sortWithinPartitions("mz", "part").mapInArrow(_gather, DECIDED)
    marks = decided.filter(F.col("slot").isNull()).unionByName(across).select("mz", "seg", "runs")
    all_of = F.array(F.struct(F.lit(0).cast("long").alias("first"), run_length(F.col("_h.at")).alias("n")))
    back = refs.join(marks.union(alike.filter("_c > 1").select("mz", "seg", all_of)), ["mz", "seg"])
    begin = F.shiftright("at", 2 * RUN.bit_length() - 2).cast("long")
    spans = F.transform("runs", lambda r: F.struct((begin + r["first"]).alias("first"), (begin + r["first"] + r["n"] + F.lit(unit.window - 1)).alias("past")))
    return back.select("_row", "_hash", spans.alias("_s")).groupBy("_row", "_hash").agg(F.flatten(F.collect_set("_s")).alias("spans"))


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, with what overlaps or touches joined."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def with_spans(docs: DataFrame, unit: Unit, decide: Decide, windows: Callable[[bytes, int], list[bytes]]) -> DataFrame:
    """doc_id, text (packed), spans of each row of docs (null where nothing repeats)."""
    if unit.window - unit.k + 1 >= RUN:
        raise ValueError(f"a window has at most {RUN + unit.k - 2} symbols")
    # a row is known by its id (or a second hash of the text) and a hash of its text: 128 bits in all
    own = narrow(docs, "doc_id", "text").withColumn("_row", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text", F.lit(1)))).withColumn("_hash", F.xxhash64("text"))
    found = repeats(own, unit, decide, windows)
    return own.mapInArrow(_pack, "doc_id long, text binary, _row long, _hash long").join(found, ["_row", "_hash"], "left").select("doc_id", "text", "spans")
