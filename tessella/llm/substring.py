"""Substring dedup: super-k-mers of words; each bucket counts its windows by sorting (free style)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import words
from .repeats import Segment, Unit, covered, unpack, with_spans

WINDOW, GRAM = 35, 8


def windows_of(window: int):
    def keys(packed: bytes, n: int) -> list[bytes]:
        tokens = packed.split(b" ")
        return [b" ".join(tokens[i : i + window]) for i in range(n)]

    return keys


def by_sorting(window: int):
    """Sorts the windows of all segments; equal ones stand together."""
    keys = windows_of(window)

    def decide(bucket: list[Segment]) -> list[np.ndarray]:
        flags = [np.zeros(x.n, bool) for x in bucket]
        known: dict[tuple, int] = {}  # a segment that comes twice is one
        rows = sorted((x.mz, key, s, i) for s, x in enumerate(bucket) if known.setdefault((x.mz, x.seg), s) == s for i, key in enumerate(keys(x.packed, x.n)))
        for x, y in zip(rows, rows[1:], strict=False):
            if x[:2] == y[:2]:
                flags[x[2]][x[3]] = flags[y[2]][y[3]] = True
        return [flags[known[x.mz, x.seg]] for x in bucket]

    return decide


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, clean_text string"


def _finish(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for x in batch.slice(at, 256).to_pylist():
                    text = unpack(x["text"])
                    buf = np.frombuffer(text, np.uint8)
                    start, end, _ = words(buf, np.array([0, len(buf)]))
                    keep = np.ones(len(start), bool)
                    for a, b in covered([(s["first"], s["past"]) for s in x["spans"] or ()]):
                        keep[a:b] = False
                    kept = b" ".join(text[a:b] for a, b in zip(start[keep].tolist(), end[keep].tolist(), strict=True))
                    rows.append((x["doc_id"], len(start), int((~keep).sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None))
                yield pa.record_batch([list(c) for c in zip(*rows, strict=True)], schema=_SCHEMA)

    return run


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("clean_text", pa.string())])


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = GRAM, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, clean_text (null unless `texts`): every word in a window of `window` words that starts anywhere else too goes.

    Windows never leave their document and are judged on the input.  Texts that are null, empty or shorter than a window lose nothing; rows that
    repeat are copies of each other and lose all their windows.  clean_text has single spaces."""
    unit = Unit(True, window, k)
    return with_spans(docs, unit, by_sorting(window), windows_of(window)).mapInArrow(_finish(texts), SCHEMA)
