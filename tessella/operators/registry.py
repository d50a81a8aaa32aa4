"""Named measures, sensors, transformers, predicates and generators that users add."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KINDS = ("measure", "sensor", "transformer", "predicate", "generator", "dataset", "task", "noise", "move", "control")


@dataclass
class Registry:
    """What users register by kind and name; a name is taken once in its kind."""

    known: dict[tuple[str, str], Callable] = field(default_factory=dict)

    def register(self, kind: str, name: str | None = None) -> Callable:
        if kind not in KINDS:
            raise ValueError(f"{kind} is none of {', '.join(KINDS)}")

        def add(f: Callable) -> Callable:
            key = (kind, name or f.__name__)
            if key in self.known:
                raise ValueError(f"there is a {kind} {key[1]} already")
            self.known[key] = f
            return f

        return add

    def get(self, kind: str, name: str) -> Callable:
        """KeyError for what isn't registered: names are never imported."""
        if (kind, name) not in self.known:
            raise KeyError(f"no {kind} {name}")
        return self.known[kind, name]

    def names(self, kind: str) -> list[str]:
        return sorted(n for k, n in self.known if k == kind)

    def observed(self, df: DataFrame, sensors: Sequence[str], **config: object) -> DataFrame:
        """df with a column for each sensor: a function of the configuration that gives a Column over the state."""
        return df.withColumns({n: self.get("sensor", n)(**config) for n in sensors})

    def transformed(self, df: DataFrame, transformers: Sequence[str]) -> DataFrame:
        """df after the transformers (DataFrame -> DataFrame) in order."""
        return reduce(lambda d, n: d.transform(self.get("transformer", n)), transformers, df)

    def space(self, spark: SparkSession, schema: StructType, transformers: Sequence[str]) -> StructType:
        """The schema that the transformers make of one, without reading a row."""
        return self.transformed(spark.createDataFrame([], schema), transformers).schema

    def valid(self, df: DataFrame, predicate: str, **config: object) -> DataFrame:
        """The rows for which a predicate (a function of the configuration that gives a boolean Column) holds; null is no."""
        return df.filter(F.coalesce(self.get("predicate", predicate)(**config), F.lit(False)))

    def generated(self, df: DataFrame, generator: str, schema: str) -> DataFrame:
        """The rows that a generator (an iterator of pandas frames -> another) yields."""
        return df.mapInPandas(self.get("generator", generator), schema)


@dataclass
class Measures:
    """name -> function that gives a Column; it may use the columns of the measures it needs."""

    known: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = field(default_factory=dict)

    def register(self, name: str, needs: Iterable[str] = ()) -> Callable:
        def add(f: Callable[[], Column]) -> Callable[[], Column]:
            if name in self.known:
                raise ValueError(f"{name} is there already")
            self.known[name] = (tuple(needs), f)
            return f

        return add

    def order(self, wanted: Iterable[str]) -> list[str]:
        """The wanted measures and all they need; ValueError for one that is unknown or needs itself."""
        out: list[str] = []

        def visit(name: str, path: tuple[str, ...]) -> None:
            if name in path:
                raise ValueError(" needs ".join((*path, name)))
            if name not in self.known:
                raise ValueError(f"no measure {name}")
            for n in self.known[name][0]:
                visit(n, (*path, name))
            if name not in out:
                out.append(name)

        for w in wanted:
            visit(w, ())
        return out

    def apply(self, df: DataFrame, wanted: Iterable[str]) -> DataFrame:
        """df with a column for each measure: its value after every step."""
        for name in self.order(wanted):
            df = df.withColumn(name, self.known[name][1]())
        return df

    def results(self, df: DataFrame, wanted: Sequence[str], episode: str, step: str) -> DataFrame:
        """The measures' values after the last step of each episode."""
        out = self.apply(df, wanted)
        return out.groupBy(episode).agg(*[F.max_by(n, step).alias(n) for n in wanted])
