import random

import pytest

from tessella.llm import components as own
from tessella.llm.components import components


def roots(links):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def graphs():
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(200)]
    star = [(0, i) for i in range(1, 300)] + [(7, 1000), (1000, 999)]
    return {"chain": chain, "shuffled": [(a * 7919 % 211, b * 7919 % 211) for a, b in chain], "star": star, "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(260)], "repeats": [(1, 2), (2, 1), (1, 2), (3, 3), (5, 4)], "none": []}


@pytest.mark.parametrize("local", [0, 30, 50_000])
@pytest.mark.parametrize("kind", list(graphs()))
def test_components(spark, kind, local, monkeypatch):
    """By rounds alone, by rounds and then one task, by one task.  Labels go the other way round than nodes, so the smallest label isn't that of the smallest node."""
    monkeypatch.setattr(own, "LOCAL", local)
    links = [x for x in graphs()[kind] if x[0] != x[1]]
    df = spark.createDataFrame(graphs()[kind], "a long, b long").repartition(3)
    label = spark.range(1200).selectExpr("id AS node", "struct(5000 - id AS id, id AS node) AS label")
    want, least = roots(links), {}
    for x, r in want.items():
        least[r] = min(least.get(r, 9999), 5000 - x)
    assert {r.node: r.label.id for r in components(df, label).collect()} == {x: least[r] for x, r in want.items()}
