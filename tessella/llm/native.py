"""Column helpers shared by the native operators (built-in functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once: a lambda's argument isn't inlined where it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The runs without ASCII white space; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def count_in(text: Column, characters: str) -> Column:
    """How many of these characters the text holds."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{characters}]+", ""))


def windows(items: Column, k: int) -> Column:
    """64-bit hashes of the runs of k items; empty if there are fewer."""
    run = lambda w: lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, k)])
    all_of = lambda w: F.slice(F.transform(w, run(w)), 1, F.size(w) - k + 1)
    return let(items, lambda w: F.when(F.size(w) >= k, all_of(w)).otherwise(F.array().cast("array<bigint>")))


def narrow(df: DataFrame, *columns: str) -> DataFrame:
    """Only these columns, so that whatever else a table holds can't clash with an operator's own."""
    return df.select(*[df[c] for c in columns])
