"""Importance resampling towards a target distribution (built-in functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.ranges import running

from .native import let, narrow
from .store import cut

#: Words are runs of digits, ASCII letters and all that isn't ASCII.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS, LONGEST, SEED = 10_000, 2, 7
#: Documents of fewer words are never drawn; so many in a hundred of the others are.
LEAST_WORDS, PERCENT = 20, 25


def tokens(text: Column) -> Column:
    """Words with A-Z lowered and no other letter changed."""
    low = lambda w: F.when(F.length(w) == F.octet_length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))
    return F.transform(F.array_remove(F.split(text, GAPS), ""), low)


def hashed(words: Column, longest: int, buckets: int) -> Column:
    """The bucket of every run of 1 to `longest` words, repeats included."""
    kind = "smallint" if buckets <= 1 << 15 else "int"

    def runs(w: Column, k: int) -> Column:
        text = lambda x, i: x if k == 1 else F.concat_ws(" ", x, *[F.get(w, i + j) for j in range(1, k)])
        each = F.transform(w, lambda x, i: (F.crc32(text(x, i).cast("binary")) % buckets).cast(kind))
        return each if k == 1 else F.slice(each, 1, F.greatest(F.size(w) - (k - 1), F.lit(0)))

    return F.concat(*[runs(words, k) for k in range(1, longest + 1)])


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def collapsed(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """text -> _text (digest), _n (rows with that text), _words, _buckets: one row for each different text, a null one being empty.

    Rows are counted before they travel, so a text that a third of all rows hold is a row from each task."""
    once = texts.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("_n"))
    made = let(tokens(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("words"), hashed(w, longest, buckets).alias("buckets")))
    out = once.select(digest(F.col("text")).alias("_text"), "_n", made.alias("_made"))
    return out.select("_text", "_n", F.col("_made.words").alias("_words"), F.col("_made.buckets").alias("_buckets"))


def counts(texts: DataFrame) -> dict[int, int]:
    """How often each bucket comes in all rows; at most one number for each bucket reaches the driver."""
    each = texts.select("_n", F.explode("_buckets").alias("_bucket")).groupBy("_bucket").agg(F.sum("_n").alias("_n"))
    return {r["_bucket"]: r["_n"] for r in each.collect()}


def gains(have: dict[int, int], want: dict[int, int], buckets: int) -> list[int]:
    """For each bucket floor(1000 * log of how much likelier it is in the target), both smoothed by one."""
    s, t = float(sum(have.values()) + buckets), float(sum(want.values()) + buckets)
    return [math.floor(1000 * math.log((want.get(b, 0) + 1.0) * s / ((have.get(b, 0) + 1.0) * t))) for b in range(buckets)]


def weighed(texts: DataFrame, gain: list[int]) -> DataFrame:
    """_text, _words, n_features, weight: the mean gain of a text's features, rounded down; 0 without features."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded to one literal
    total = F.aggregate("_buckets", F.lit(0).cast("long"), lambda a, b: a + F.get(table, b.cast("int")))
    out = texts.select("_text", "_words", F.size("_buckets").cast("long").alias("n_features"), total.alias("_sum"))
    return out.select("_text", "_words", "n_features", F.when(F.col("n_features") > 0, F.expr("(_sum - pmod(_sum, n_features)) div n_features")).otherwise(F.lit(0)).cast("long").alias("weight"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel deviate, rounded down, from the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text), target (text) -> doc_id, n_features, weight, score, rank for every row of docs.

    Of the documents with at least `least_words` words the `percent` in a hundred with the highest scores are drawn, which
    is drawing without replacement in proportion to exp(weight / 1000); rank counts them from 1 and is null for all others.
    Equal texts are collapsed: features and weight are made once for each, counted as often as it comes, and joined back before
    the noise, which depends on doc_id alone.  Gains are a table of `buckets` numbers.  Ranks are those of ranges
    of scores plus those within, so no task sorts all rows.

    A null or empty text has no features, weight 0, and isn't drawn.  Ties go to the smaller doc_id, a null one first (its noise
    is that of the empty id); rows that repeat an id and a text have one score and ranks that follow each other.  An empty target
    gives every bucket the gain of a uniform one, an empty docs an empty result; other columns aren't read."""
    own = narrow(docs, "doc_id", "text")
    texts = cut(collapsed(own, longest, buckets))
    gain = gains(counts(texts), counts(collapsed(narrow(target, "text"), longest, buckets)), buckets)
    named = own.select("doc_id", digest(F.coalesce(F.col("text"), F.lit(""))).alias("_of"))
    out = named.join(weighed(texts, gain), F.col("_of") == F.col("_text"))
    out = cut(out.select("doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), (F.col("_words") >= least_words).alias("_may")))
    may = out.filter("_may")
    most = percent * may.count() // 100
    ranked = running(may, [-F.col("score"), F.col("doc_id")], name="_before")
    rank = F.when(F.col("_before") < most, F.col("_before") + 1).cast("long").alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, rank).unionByName(out.filter("NOT _may").select(*columns, F.lit(None).cast("long").alias("rank")))
