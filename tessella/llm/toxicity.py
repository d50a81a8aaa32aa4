"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly in numpy (free style)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .kernels import LOWER, U64, _BASE, _BYTE, column, mix, passes, powers
from .native import narrow
from .store import in_batches

GRAMS = (3, 4, 5)
BUCKETS = 1 << 18
DIMENSION = 8
#: Words of one bag; a document scores as its worst bag does, so its length doesn't dilute an insult.
BAG_WORDS = 12
#: The classifier is fitted on at most so many labelled rows of each class, chosen by a hash of doc_id, none longer than this.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 1200, 2400, 8_000
EPOCHS, RATE, BATCH, SEED = 14, 0.5, 64, 7
CUT = 0.3

# Letters, digits and all of UTF-8 beyond ASCII make words; what else there is parts them.
_LETTER = LOWER.copy()
for _b in range(128):
    if not chr(_b).isalnum():
        _LETTER[_b] = 0x20


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions x features) bucket numbers, BUCKETS where there is none; starts of bags; first bag of each document.

    At each byte: the 3- to 5-grams that begin there, of one word with its edges, and at a word's start the word."""
    docs = len(off) - 1
    text = np.full(len(buf) + docs + 1, 0x20, np.uint8)  # a space before each document and at the end
    text[np.arange(len(buf)) + np.repeat(np.arange(1, docs + 1), np.diff(off))] = _LETTER[buf]
    start = off + np.arange(docs + 1)
    gap = text == 0x20
    n = len(text)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[text] * powers(_BASE, n), out=sums[1:])
    inverse = powers(pow(_BASE, -1, 1 << 64), n + 1)
    gaps = np.zeros(n + 1, np.int32)
    np.cumsum(gap, out=gaps[1:])
    out = np.full((len(GRAMS) + 1, n), BUCKETS, np.int32)
    for row, k in enumerate(GRAMS):
        m = n - k + 1
        if m <= 0:
            continue
        inner = gaps[k - 1 : k - 1 + m] - gaps[1 : 1 + m]  # gaps strictly inside
        value = mix((sums[k:] - sums[:-k]) * inverse[:m] + U64(k)) & U64(BUCKETS - 1)
        out[row, :m] = np.where(inner == 0, value.astype(np.int32), BUCKETS)
    first = np.flatnonzero(~gap[1:] & gap[:-1]) + 1
    last = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    out[-1, first] = (mix((sums[last] - sums[first]) * inverse[first] + U64(99)) & U64(BUCKETS - 1)).astype(np.int32)
    of = np.searchsorted(first, start)  # the first word of each document
    rank = np.arange(len(first)) - np.repeat(of[:-1], np.diff(of))
    bags = np.flatnonzero(rank % BAG_WORDS == 0)
    return out, np.append(first[bags] - 1, n), np.searchsorted(bags, of)


@dataclass
class Model:
    """What scoring needs: for each bucket the difference of its two logits, the intercept and the score of no words."""

    table: np.ndarray
    intercept: float
    empty: float

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        out = np.full(len(off) - 1, self.empty)
        for a, z in passes(off):
            cells, bags, of = features(buf[off[a] : off[z]], off[a : z + 1] - off[a])
            if len(bags) < 2:
                continue
            total = np.zeros(cells.shape[1])
            count = np.zeros(cells.shape[1], np.int32)
            for row in cells:
                total += self.table[row]
                count += row != BUCKETS
            logit = np.add.reduceat(total, bags[:-1]) / np.maximum(np.add.reduceat(count, bags[:-1]), 1) + self.intercept
            have = np.flatnonzero(np.diff(of) > 0)
            worst = np.maximum.reduceat(logit, of[have])
            out[a + have] = 1 / (1 + np.exp(-np.clip(worst, -30, 30)))
        return out


def fit(buf: np.ndarray, off: np.ndarray, label: np.ndarray, share: float) -> Model:
    """Stochastic gradient steps (Adagrad) on embeddings and softmax together, through the worst bag of each document.

    share: that of toxic documents where the model is used; the intercept is moved from the sample's to it."""
    rng = np.random.RandomState(SEED)
    vectors = np.zeros((BUCKETS + 1, DIMENSION), np.float32)  # so a subword that was never seen says nothing
    heads = rng.uniform(-1, 1, (DIMENSION, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen, seen_heads, seen_bias = np.full(BUCKETS + 1, 1e-3, np.float32), np.full((DIMENSION, 2), 1e-3, np.float32), np.full(2, 1e-3, np.float32)
    parts, docs = [], []
    for a, z in passes(off):
        cells, bags, of = features(buf[off[a] : off[z]], off[a : z + 1] - off[a])
        parts.append(cells)
        docs += [(len(parts) - 1, bags[of[d] : of[d + 1] + 1]) for d in range(z - a)]
    usable = [d for d in range(len(label)) if len(docs[d][1]) > 1]
    scale = 30.0  # a bag's mean over its features is small
    for _ in range(EPOCHS):
        rng.shuffle(usable)
        for at in range(0, len(usable), BATCH):
            table = vectors @ (heads[:, 1] - heads[:, 0]) * scale
            table[BUCKETS] = 0
            ids, owner, hot = [], [], []
            for d in usable[at : at + BATCH]:
                part, bags = docs[d]
                cells = parts[part][:, bags[0] : bags[-1]]
                where = bags[:-1] - bags[0]
                logit = np.add.reduceat(table[cells].sum(0), where) / np.maximum(np.add.reduceat((cells != BUCKETS).sum(0), where), 1)
                best = int(logit.argmax())
                cell = cells[:, where[best] : bags[best + 1] - bags[0]].ravel()
                cell = cell[cell != BUCKETS]
                ids.append(cell)
                owner.append(np.full(len(cell), len(hot)))
                hot.append(label[d])
            ids, owner, hot = np.concatenate(ids), np.concatenate(owner), np.array(hot)
            size = np.maximum(np.bincount(owner, minlength=len(hot)), 1).astype(np.float32)[:, None]
            mean = np.zeros((len(hot), DIMENSION), np.float32)
            np.add.at(mean, owner, vectors[ids])
            mean *= scale / size
            z = mean @ heads + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(hot)), hot] -= 1
            back = (p @ heads.T) * scale / size
            g_heads, g_bias = mean.T @ p / len(hot), p.mean(0)
            unique, inverse = np.unique(ids, return_inverse=True)
            g = np.zeros((len(unique), DIMENSION), np.float32)
            np.add.at(g, inverse, back[owner])
            seen[unique] += (g**2).mean(1)
            vectors[unique] -= RATE * g / np.sqrt(seen[unique])[:, None] * 0.1
            seen_heads += g_heads**2
            heads -= RATE * 0.1 * g_heads / np.sqrt(seen_heads)
            seen_bias += g_bias**2
            bias -= RATE * 0.1 * g_bias / np.sqrt(seen_bias)
    table = (vectors @ (heads[:, 1] - heads[:, 0]) * scale).astype(np.float32)
    table[BUCKETS] = 0
    own = min(max(label.mean(), 1e-3), 1 - 1e-3)
    share = min(max(share, 1e-3), 1 - 1e-3)
    shift = np.log(share / (1 - share)) - np.log(own / (1 - own))
    return Model(table, float(bias[1] - bias[0] + shift), float(share))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled rows of `labels` (doc_id, toxic) with a text in docs.

    Rows without label, id or text are left out; without rows of both classes every text scores as their share."""
    labels = narrow(labels, "doc_id", "toxic").filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    order = F.xxhash64("doc_id")
    some = [labels.filter(F.col("toxic") == c).select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_y"), order.alias("_o")).orderBy("_o", "_id").limit(n) for c, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    counts = labels.agg(F.avg("toxic").alias("share")).first()
    sample = some[0].unionByName(some[1])
    texts = narrow(docs, "doc_id", "text").filter(F.length("text") <= SAMPLE_CHARS)
    rows = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("_o", "_id", "_y", "text")
    rows = rows.orderBy("_o", "_id", "text").limit(SAMPLE_TOXIC + SAMPLE_CLEAN).toArrow().combine_chunks()
    label = np.array(rows.column("_y").to_pylist(), np.int64)
    share = counts["share"] or 0.0
    if not len(label) or label.min() == label.max():
        return Model(np.zeros(BUCKETS + 1, np.float32), float(np.log(max(share, 1e-3) / max(1 - share, 1e-3))), float(share))
    texts = pa.concat_arrays(rows.column("text").chunks)
    return fit(*column(texts), label, share)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a score (0 to 1) added; a text that is null or has no words scores as the share of toxic labels."""
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.intercept, model.empty))  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column(name, pa.array(own.scores(*column(batch.column("text")))))

    return in_batches(docs, run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def held_out(doc_id: Column) -> Column:
    """The quarter of the ids from which no label is learnt; a null id belongs to it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, learnt from labels outside the held-out quarter.

    A null or empty text, or one without words, scores as the share of toxic labels; rows that repeat score alike; a very long
    text is scored whole, bag by bag; an empty table gives an empty one.  Only doc_id and text of docs are read."""
    model = learn(docs, labels.filter(~held_out(labels["doc_id"])))
    out = score(narrow(docs, "doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of docs, with all their columns, that aren't predicted toxic; null and empty texts score as the share of toxic labels."""
    model = learn(docs, labels.filter(~held_out(labels["doc_id"])))
    names = docs.columns
    return score(docs, model, "_toxic_score").filter(F.col("_toxic_score") < cut).select(*names)
