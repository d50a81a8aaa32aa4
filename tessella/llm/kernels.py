"""Vectorised text kernels over Arrow string columns (numpy, no per-character Python).

A column is viewed as one byte buffer with document offsets.  Word and window
hashes come from one prefix sum of ``table[byte] * base**position`` modulo 2**64,
so that the hash of any byte range is a difference of two prefix values times the
inverse power of its start.  All constants derive from fixed seeds: every executor
computes the same hashes, and a task that runs again gives the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one numpy pass handles; a longer text is a pass of its own.  A pass holds up to 100 times as much in arrays, in each worker.
PASS_BYTES = 1 << 18
#: Words of more bytes are hashed one by one.
LONG = 64
#: Java and SQL form of a word: a run without ASCII white space.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

_seed = np.random.RandomState(20240229)
_BYTE = _seed.randint(0, 1 << 62, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        grown = np.full(max(n, PASS_BYTES + 1), base, U64)
        grown[0] = 1
        have = _powers[base] = np.cumprod(grown)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null counts as empty."""
    if pa.types.is_dictionary(array.type):
        array = array.dictionary_decode()
    array = array.cast(pa.large_binary() if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else pa.large_string())
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_large_binary(array.type) else "")
    _, where, data = array.buffers()
    off = np.frombuffer(where, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def passes(off: np.ndarray, most: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most `most` bytes, or of one longer document."""
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def prefix(buf: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences are range hashes, up to the power of the start."""
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum(_BYTE[buf] * powers(_BASE, len(buf)), out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, end)."""
    return mix(((sums[end] - sums[start]) * powers(_INVERSE, len(sums))[start]) ^ (end - start).astype(U64))


def word_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words.  Sums modulo 2**64 can't tell long words apart that are built by doubling (ab, abba, abbabaab, ...), so
    words of more than LONG bytes get a cryptographic hash."""
    h = range_hash(prefix(buf), start, end)
    for i in np.flatnonzero(end - start > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word (n + 1 values)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    space = _IS_SPACE[buf]
    before = np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    inner = off[(off > 0) & (off < n)]
    before[inner] = True
    start = np.flatnonzero(~space & before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, space[1:]
    after[inner - 1] = True
    end = np.flatnonzero(~space & after) + 1
    return start, end, np.searchsorted(start, off)


def window_hash(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hashes of k consecutive hashes (len(h) - k + 1 values, or none)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    sums = np.zeros(len(h) + 1, U64)
    np.cumsum(h * powers(_BASE, len(h)), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers(_INVERSE, n) + U64(salt))


def shingles(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document the sorted distinct hashes of its k-word shingles, back to back, and the offsets.

    With fewer words than k the whole sequence is one shingle; without words there is none."""
    start, end, first = words(buf, off)
    h = word_hash(buf, start, end)
    count = np.diff(first)
    w = window_hash(h, k)
    doc_of = np.repeat(np.arange(len(count)), np.maximum(count - k + 1, 0))
    have = np.maximum(count - k + 1, 0)
    at = np.arange(have.sum()) - np.repeat(np.cumsum(have) - have, have) + np.repeat(first[:-1], have)
    doc, val = doc_of, w[at]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        whole = np.array([int(window_hash(h[first[d] : first[d + 1]], int(count[d]), int(count[d]))[0]) for d in short], U64)
        doc, val = np.concatenate([doc, short]), np.concatenate([val, whole])
    order = np.lexsort((val, doc))
    doc, val = doc[order], val[order]
    keep = np.ones(len(val), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (val[1:] != val[:-1])
    doc, val = doc[keep], val[keep]
    return val, np.searchsorted(doc, np.arange(len(count) + 1))


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """For each of the len(h) - w + 1 windows the position of its smallest value (by the upper 32 bits), the leftmost on ties."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = U64(0xFFFFFFFF)
    best = (h & ~low) | np.arange(len(h), dtype=U64)
    span = 1
    while span * 2 <= w:
        best = np.minimum(best[: len(best) - span], best[span:])
        span *= 2
    return (np.minimum(best[:n], best[w - span : w - span + n]) & low).astype(np.int64)


def segments(grams: np.ndarray, first: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers: document, first window, number of windows and minimiser position of each run of windows with one minimiser.

    grams[i]: hash of the k symbols from i; first: where each document's symbols begin (n + 1 values).  A window is
    `window` symbols of one document; all positions count from the start of the buffer."""
    n = int(first[-1])
    if n < window:
        return (np.zeros(0, np.int64),) * 4
    best = sliding_argmin(grams, window - k + 1)
    size = np.diff(first)
    have = np.maximum(size - window + 1, 0)
    at = np.arange(have.sum()) - np.repeat(np.cumsum(have) - have, have) + np.repeat(first[:-1], have)
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    best, doc = best[at], np.repeat(np.arange(len(size)), have)
    edge = np.ones(len(at), bool)
    edge[1:] = (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(edge)
    return doc[begin], at[begin], np.diff(np.append(begin, len(at))), best[begin]
