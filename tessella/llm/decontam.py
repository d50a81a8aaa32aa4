"""Benchmark decontamination: size-partitioned bottom-k MinHash containment search (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import let, narrow, windows
from .store import cut

SHINGLE = 5
THRESHOLD = 0.8
#: Items of at most so many words in all are broadcast; beyond, Spark shuffles both sides.
BROADCAST_WORDS = 2_000_000
#: So many ids of contaminated documents are broadcast.
BROADCAST_IDS = 1_000_000


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, so that case, punctuation and separators don't hide a passage."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(items: Column, k: int) -> Column:
    """Distinct runs of k words."""
    runs = F.transform(F.sequence(F.lit(0), F.size(items) - k), lambda i: F.concat_ws(" ", *[F.get(items, i + j) for j in range(k)]))
    return F.when(F.size(items) >= k, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def sketches(bench: DataFrame, threshold: float, k: int) -> DataFrame:
    """item_id, width, shingles, size_class, sketch: the bottom of each item's MinHash order.

    Items are partitioned by the power of two of their number of shingles; all of a partition have a sketch as deep as
    its largest item can need: if a document holds `threshold` of n shingles, it misses at most floor((1 - threshold) n),
    so of the smallest floor((1 - threshold) n) + 1 values at least one is in the document.  Hence no pair is missed,
    however long the document is."""
    items = narrow(bench, "item_id", "text").withColumn("_w", tokens(F.col("text"))).filter(F.size("_w") > 0)
    items = items.withColumn("width", F.least(F.size("_w"), F.lit(k)))
    pick = lambda f: F.coalesce(*[F.when(F.col("width") == n, f(F.col("_w"), n)) for n in range(1, k + 1)])
    items = items.select("item_id", "width", pick(shingles).alias("shingles"), F.array_sort(F.array_distinct(pick(windows))).alias("_h"))
    top = F.floor(F.log2(F.size("_h"))).cast("int")
    items = items.withColumn("size_class", top)
    depth = F.floor((1 - threshold) * (F.pow(F.lit(2), F.col("size_class") + 1) - 1) + 1e-9).cast("int") + 1
    return items.withColumn("sketch", F.slice("_h", F.lit(1), depth)).drop("_h")


def search(docs: DataFrame, bench: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment: the pairs with at least `threshold` of the item's shingles in the document.

    Shingles are sets of k words after normalisation; an item of m < k words is one shingle of m words, looked for among
    the documents' runs of m words.  Items or documents without words give no row.  doc_id and item_id may repeat: the
    result has a row for each pair of ids, of the largest containment; empty tables give none.  Other columns aren't read.

    Search: a document's hashes up to the largest value in any sketch meet the sketches by equality (a broadcast of
    at most `broadcast_words` words of items, else a join that AQE splits where skewed).  Verification: the texts of
    candidates are shingled again, once each, and the shingles themselves, not hashes, are intersected.  Candidates with
    at most `broadcast_words` words of items in all are broadcast to the texts; beyond that both sides are shuffled."""
    items = sketches(bench, threshold, k)
    facts = items.agg(F.sum(F.size("shingles") * F.col("width")).alias("words"), F.collect_set("width").alias("widths"), F.max(F.array_max("sketch")).alias("top")).first()
    empty = not facts["widths"]
    widths, small = sorted(facts["widths"]), (facts["words"] or 0) <= broadcast_words
    hint = F.broadcast if small else (lambda d: d)
    own = narrow(docs, "doc_id", "text").filter(F.length("text") > 0)
    probe = let(tokens(F.col("text")), lambda w: F.concat(*[F.filter(windows(w, n), lambda h: h <= F.lit(facts["top"])) for n in widths])) if not empty else F.array().cast("array<bigint>")
    keys = hint(items.select(F.col("item_id").alias("_item"), F.explode("sketch").alias("_k")))
    found = own.select(F.col("doc_id").alias("_doc"), F.explode(probe).alias("_h")).join(keys, F.col("_h") == F.col("_k")).select("_doc", "_item").distinct()
    found = cut(found)
    # each candidate document with its items meets its text once; only these rows move if they are few, which is checked
    wanted = found.join(hint(items.select(F.col("item_id").alias("_id"), "width", F.col("shingles").alias("_s"))), F.col("_item").eqNullSafe(F.col("_id")))
    held = wanted.agg(F.sum(F.size("_s") * F.col("width"))).first()[0] or 0
    wanted = wanted.groupBy("_doc").agg(F.collect_list(F.struct(F.col("_item").alias("item_id"), "width", F.col("_s").alias("s"))).alias("_items"))
    texts = own.join(F.broadcast(wanted) if held <= broadcast_words else wanted, F.col("doc_id").eqNullSafe(F.col("_doc")))
    by_width = lambda w: F.map_from_entries(F.array(*[F.struct(F.lit(n), shingles(w, n)) for n in widths or [k]]))
    count = lambda sets: F.transform("_items", lambda i: F.struct(i["item_id"].alias("item_id"), F.size(F.array_intersect(i["s"], sets[i["width"]])).cast("long").alias("n_shared"), F.size(i["s"]).cast("long").alias("n_item")))
    hits = let(tokens(F.col("text")), lambda w: let(by_width(w), count))
    out = texts.select("doc_id", F.explode(F.filter(hits, lambda h: h["n_shared"] >= F.lit(threshold) * h["n_item"] - 1e-9)).alias("_h"))
    best = F.max(F.struct((F.col("_h.n_shared") / F.col("_h.n_item")).alias("containment"), "_h.n_shared", "_h.n_item")).alias("_b")
    return out.groupBy("doc_id", F.col("_h.item_id").alias("item_id")).agg(best).select("doc_id", "item_id", "_b.n_shared", "_b.n_item", "_b.containment")


def remove_contaminated(docs: DataFrame, bench: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """The documents that contain no benchmark item; rows that share a doc_id, or have none, are judged together.

    Null and empty texts contain none and stay; an empty benchmark removes nothing."""
    bad = cut(search(docs, bench, threshold, k).select(F.col("doc_id").alias("_bad")).distinct())
    few = bad.count() <= BROADCAST_IDS  # else the documents are shuffled
    return docs.join(F.broadcast(bad) if few else bad, docs["doc_id"].eqNullSafe(F.col("_bad")), "left_anti")
