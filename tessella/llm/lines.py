"""Lines that many documents share, found by counting names of lines and dropped by probing a perfect hash."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mph
from .kernels import LOWER, column, passes
from .native import narrow
from .store import cut, uri

#: Lines whose key has fewer code points stay; those found in at least so many documents go.
LEAST_CHARS, LEAST_DOCS = 1, 10
BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Names in a shard on average, and the least number of shards as a power of 2.
SHARD_KEYS, SHARD_BITS = 1 << 16, 5
#: Bytes of text that a task looks at together; a longer text is a pass of its own.
PASS_BYTES = 4 << 20
_TABLE = LOWER.tobytes()


def keys(text: bytes, least: int) -> list[bytes | None]:
    """For each line of UTF-8 text its key (no white space at its ends, A-Z lowered), None if it has fewer than `least` code points."""
    out = [line.strip(BLANK) for line in text.translate(_TABLE).split(b"\n")]
    if least <= 1:
        return [k if len(k) >= least else None for k in out]
    return [k if len(k) >= least and len(k.decode("utf-8", "replace")) >= least else None for k in out]


def names(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each key: the first half chooses the shard, both the place, the second is the fingerprint."""
    both = np.frombuffer(b"".join([hashlib.sha256(k).digest()[:16] for k in found]), "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        buf, off = column(batch.column("text"))
        for a, b in passes(off, PASS_BYTES):
            yield batch.slice(a, b - a), [buf[off[i] : off[i + 1]].tobytes() for i in range(a, b)]


def _name(least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _texts(batches):
            hi, lo = names([k for t in texts for k in set(keys(t, least)) if k is not None])
            order = np.lexsort((lo, hi))
            hi, lo = hi[order], lo[order]
            first = np.flatnonzero(np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))) if len(hi) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(hi)))
            yield pa.record_batch([hi[first].view(np.int64), lo[first].view(np.int64), n], names=["hi", "lo", "n"])

    return run


def counted(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """docs (text) -> hi, lo, n: the name of each different key and how many rows hold it, counted in tasks before names travel."""
    each = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(_name(least_chars), "hi long, lo long, n long")
    return each.groupBy("hi", "lo").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Index:
    """Shards by the upper bits of names, in a folder that all executors share."""

    folder: str
    bits: int
    present: frozenset[int]

    def counts(self, found: list[bytes]) -> np.ndarray:
        """How many documents hold each key; 0 for those not in the index."""
        return mph.counts_of(self.folder, self.bits, self.present, *names(found))


def _build(folder: str) -> Callable:
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        hi, lo = (group[c].to_numpy(np.int64).view(np.uint64) for c in ("hi", "lo"))
        order = np.lexsort((lo, hi))
        size = mph.save(folder, int(key[0]), mph.build(hi[order], lo[order], group["n"].to_numpy(np.int64)[order]), uuid.uuid4().hex)
        return pd.DataFrame({"shard": [key[0]], "bytes": [size]})

    return run


def index(counts: DataFrame, folder: str, shard_keys: int = SHARD_KEYS) -> Index:
    """counts (hi, lo, n) -> the index in `folder`.  The hash deals names evenly, so each shard is built in one task from about
    `shard_keys` of them, or a few; the driver gets a number for each shard."""
    counts = cut(counts)
    bits = max(SHARD_BITS, (max(counts.count() // shard_keys, 1) - 1).bit_length())
    shard = F.shiftrightunsigned("hi", 64 - bits).alias("shard")
    made = counts.select(shard, "hi", "lo", "n").groupBy("shard").applyInPandas(_build(folder), "shard long, bytes long")
    return Index(folder, bits, frozenset(r["shard"] for r in made.collect()))


def _drop(own: Index, least_chars: int, least_docs: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in _texts(batches):
            every = [keys(t, least_chars) for t in texts]
            counts = own.counts([k for ks in every for k in ks if k is not None])
            sizes = [len(ks) for ks in every]
            named = np.fromiter((k is not None for ks in every for k in ks), bool, sum(sizes))
            docs = np.zeros(len(named), np.int64)
            docs[named] = counts
            goes, clean, dropped, most = docs >= least_docs, [], [], []
            for text, a, b in zip(texts, np.cumsum([0, *sizes]), np.cumsum(sizes), strict=False):
                own_goes = goes[a:b]
                dropped.append(int(own_goes.sum()))
                most.append(int(docs[a:b][own_goes].max(initial=0)))
                clean.append(b"\n".join([x for x, gone in zip(text.split(b"\n"), own_goes, strict=True) if not gone]) if dropped[-1] else text)
            yield pa.record_batch([piece.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(dropped, pa.int64()), pa.array(most, pa.int64()), pa.array(clean, pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "most_docs", "clean_text"])

    return run


def drop(docs: DataFrame, own: Index, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_lines, n_dropped, most_docs (documents that hold the commonest dropped line), clean_text.
    `least_docs` may be more than the index was built for."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = narrow(docs, "doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_drop(own, least_chars, least_docs), f"doc_id {kind}, n_lines long, n_dropped long, most_docs long, clean_text string")


def deduplicate(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Drops, from every document, all lines whose key at least `least_docs` documents hold; see drop() for what comes out.

    A key is the line without white space at its ends and with A-Z lowered; keys of fewer than `least_chars` code points (so
    blank lines) always stay.  Keys are named by 128 bits of SHA-256 and counted by name, once for each row that holds
    them.  Names that reach `least_docs` get a sharded minimal perfect hash over arrays of fingerprints and counts, about 13
    bytes for each, in the shared folder; others can't be dropped, and their fingerprints (64 bits besides the place) say
    so.  Documents aren't shuffled: each task probes the shards that its own lines need, one after the other.

    A null or empty text is one empty line; its clean_text is empty, as is that of a text which loses all lines.  Rows that
    repeat a doc_id, or all of it, are documents of their own.  A text of any length is looked at whole.  An empty table
    gives an empty one; other columns aren't read."""
    own = index(counted(docs, least_chars).filter(F.col("n") >= least_docs), f"{uri(docs.sparkSession)}/lines-{uuid.uuid4().hex}", shard_keys)
    return drop(docs, own, least_docs, least_chars)
