"""Suffix-array dedup: column-wise construction of a collection's Burrows-Wheeler transform with common prefixes (free style).

Round by round one symbol of each string, from its end to its start, is inserted: the place of a suffix c + S follows from the
place of S and the number of c's before it in the transform so far.  The transform and the array of longest common prefixes
lie in two files that a round reads from start to end and writes anew."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Segment, Unit, covered, unpack, with_spans

WINDOW, GRAM = 200, 32
#: Distances of the minimiser that share one middle part in the test before the transform.
STEP = 24
#: Codes of symbols: that which comes once, and what stands before a whole string; others lie in between.
BREAK, END = 0, (1 << 16) - 1


def _minima(lcp: np.ndarray) -> list[np.ndarray]:
    """For each power of two the minima of so many values from each place on."""
    out = [lcp]
    while len(out[-1]) > (half := 1 << (len(out) - 1)):
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


def _least(minima: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of the values in places a..b for each pair with a <= b."""
    out = np.empty(len(a), minima[0].dtype)
    power = np.frexp(b - a + 1)[1] - 1
    for k in np.unique(power).tolist():
        i = np.flatnonzero(power == k)
        out[i] = np.minimum(minima[k][a[i]], minima[k][b[i] + 1 - (1 << k)])
    return out


def _spread(old: np.ndarray, where: np.ndarray, values: np.ndarray) -> np.ndarray:
    """old with values inserted so that they stand at `where` in the result (ascending)."""
    new = np.empty(len(old) + len(where), old.dtype)
    keep = np.ones(len(new), bool)
    keep[where] = False
    new[keep] = old
    new[where] = values
    return new


def _standing(bwt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places sorted by symbol and then by themselves, and where each place stands among them."""
    order = np.argsort(bwt, kind="stable")  # a radix sort for small symbols
    rank = np.empty(len(bwt), np.int32)
    rank[order] = np.arange(len(bwt), dtype=np.int32)
    return order, rank


def build(strings: list[np.ndarray], depth: int, folder: str) -> tuple[str, str]:
    """Files with the Burrows-Wheeler transform and the common prefixes, up to `depth` symbols, of all suffixes of the strings.

    A symbol BREAK is like no other, not even another BREAK; END stands before a whole string and occurs in none."""
    m = len(strings)
    size = np.array([len(s) for s in strings])
    text = np.concatenate(strings)
    past = np.cumsum(size)
    names = [os.path.join(folder, f"{what}{i}") for what in ("bwt", "lcp") for i in (0, 1)]

    def before(who: np.ndarray, length: int) -> np.ndarray:
        inside = size[who] > length
        out = np.full(len(who), END, np.uint16)
        out[inside] = text[past[who[inside]] - length - 1]
        return out

    who = np.arange(m)
    before(who, 0).tofile(names[0])  # round 0: the empty suffixes, in the strings' order
    np.zeros(m, np.uint8).tofile(names[2])
    place, side = np.arange(m), 0
    for length in range(1, int(size.max(initial=0)) + 1):
        bwt, lcp = np.fromfile(names[side], np.uint16), np.fromfile(names[2 + side], np.uint8)
        live = size[who] >= length
        who, place = who[live], place[live]
        order, rank = _standing(bwt)
        at = rank[place].astype(np.int64)
        by = np.argsort(at)
        who, place, at = who[by], place[by], at[by]
        symbol = bwt[place]
        above, below = order[np.maximum(at - 1, 0)], order[np.minimum(at + 1, len(bwt) - 1)]
        has_above, has_below = (at > 0) & (bwt[above] == symbol) & (symbol != BREAK), (at + 1 < len(bwt)) & (bwt[below] == symbol) & (symbol != BREAK)
        minima = _minima(lcp)
        up, down = np.zeros(len(at), np.uint8), np.zeros(len(at), np.uint8)
        for has, out, a, b in ((has_above, up, above + 1, place), (has_below, down, place + 1, below)):
            i = np.flatnonzero(has)
            out[i] = np.minimum(_least(minima, a[i], b[i]).astype(np.int64) + 1, depth)
        where = m + at
        bwt = _spread(bwt, where, before(who, length))
        lcp = _spread(lcp, where, up)
        after = where + 1
        some = np.flatnonzero(after < len(lcp))
        lcp[after[some]] = down[some]
        side = 1 - side
        for name, values in ((names[side], bwt), (names[2 + side], lcp)):
            if os.path.exists(name):
                os.remove(name)  # some file systems flush a file that is cut to nothing and written again
            values.tofile(name)
        place = where
    return names[side], names[2 + side]


def symbols(strings: list[bytes], window: int) -> tuple[int, list[np.ndarray]]:
    """Bytes in a symbol, and the strings as such symbols, each from its first byte, its second, up to a symbol's last.

    The widest symbol that divides the window and of which there are few enough that come twice: it needs the fewest
    rounds.  One that comes once can't be in a repeated window and is a BREAK."""
    for wide in (w for w in (8, 4, 2, 1) if window % w == 0):
        kind = np.dtype(f"u{wide}")
        parts = [np.frombuffer(s, kind, max(len(s) - i, 0) // wide, i) if len(s) - i >= wide else np.zeros(0, kind) for s in strings for i in range(wide)]
        _, code, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        several = count > 1
        if several.sum() < END - BREAK:
            break
    number = np.where(several, np.cumsum(several) + BREAK, BREAK).astype(np.uint16)
    return wide, np.split(number[code], np.cumsum([len(p) for p in parts])[:-1])


def shared_windows(strings: list[bytes], counts: list[int], window: int) -> list[np.ndarray]:
    """For each string whether the window at each of its first `count` places is in the collection once more."""
    known: dict[bytes, int] = {}
    for s in strings:
        known.setdefault(s, len(known))
    wide, parts = symbols(list(known), window)
    size, depth = np.array([len(p) for p in parts]), window // wide
    start = np.append(0, np.cumsum([max(len(s) - window + 1, 0) for s in known]))
    flags = np.zeros(start[-1], bool)
    with tempfile.TemporaryDirectory() as folder:
        files = build(parts, depth, folder)
        bwt, lcp = np.fromfile(files[0], np.uint16), np.fromfile(files[1], np.uint8)
    twice = lcp >= depth
    twice[:-1] |= lcp[1:] >= depth
    _, rank = _standing(bwt)
    who, place = np.arange(len(parts)), np.arange(len(parts))
    for length in range(1, int(size.max(initial=0)) + 1):  # walk back through each string
        live = size[who] >= length
        who = who[live]
        place = len(parts) + rank[place[live]]
        if length >= depth:
            hit = who[twice[place]]
            flags[start[hit // wide] + (size[hit] - length) * wide + hit % wide] = True
    return [flags[start[known[s]] :][:n] for s, n in zip(strings, counts, strict=True)]


def alive(bucket: list[Segment], window: int, step: int = STEP) -> list[bool]:
    """False for segments that can't share a window with a different one of their minimiser.

    Windows in which the minimiser stands at similar distances from the start have a middle part in common; a shared window
    shares it.  So where no other segment has the same middle part for any group of distances, nothing is shared."""
    found: dict[tuple, int] = {}
    middles = []
    for x in bucket:
        mine = []
        for low in range((x.far - x.n + 1) // step * step, x.far + 1, step):
            mine.append((x.mz, low, x.packed[x.far - low : x.far + window - low - step + 1]))
        middles.append(mine)
    known = set()
    for x, mine in zip(bucket, middles, strict=True):
        if (x.mz, x.seg) not in known:  # a segment that comes twice is one
            known.add((x.mz, x.seg))
            for m in mine:
                found[m] = found.get(m, 0) + 1
    return [any(found[m] > 1 for m in mine) for mine in middles]


def by_transform(window: int):
    def decide(bucket: list[Segment]) -> list[np.ndarray]:
        flags = [np.zeros(x.n, bool) for x in bucket]
        live = [i for i, a in enumerate(alive(bucket, window)) if a]
        if live:
            for i, f in zip(live, shared_windows([bucket[i].packed for i in live], [bucket[i].n for i in live], window), strict=True):
                flags[i] = f
        return flags

    return decide


def windows_of(window: int):
    def keys(packed: bytes, n: int) -> list[bytes]:
        return [packed[i : i + window] for i in range(n)]

    return keys


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _finish(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for x in batch.slice(at, 256).to_pylist():
                    text = unpack(x["text"])
                    spans = covered([(s["first"], s["past"]) for s in x["spans"] or ()])
                    edges = [0, *[e for s in spans for e in s], len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    rows.append((x["doc_id"], len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if texts else None))
                yield pa.record_batch([list(c) for c in zip(*rows, strict=True)], schema=_SCHEMA)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = GRAM, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes; null unless `texts`): every byte of a string of `window` bytes that starts anywhere else too goes.

    Texts are UTF-8 bytes; a cut may split a character, so `kept` is binary.  Strings never leave their document and are judged
    on the input.  Texts that are null, empty or shorter than the window lose nothing; rows that repeat lose all of their windows."""
    unit = Unit(False, window, k)
    return with_spans(docs, unit, by_transform(window), windows_of(window)).mapInArrow(_finish(texts), SCHEMA)
