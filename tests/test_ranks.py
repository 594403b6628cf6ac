"""Order statistics by histograms against sorting."""

import math
import random

import pytest

from sparkmix.operators import corpus as C
from sparkmix.operators import ranks as R

NAMES = ["even", "ties", "heavy", "tiny", "wide", "signed", "one", "none", "odd"]


def column(name, n, rnd):
    match name:
        case "even":
            return [rnd.random() for _ in range(n)]
        case "ties":
            return [float(rnd.randint(0, 3)) for _ in range(n)]
        case "heavy":
            return [math.exp(rnd.gauss(0, 40)) for _ in range(n)]
        case "tiny":
            return [rnd.randint(0, 9) * 5e-324 for _ in range(n)]
        case "wide":
            return [rnd.choice([-1, 1]) * 2.0 ** rnd.randint(-1070, 1023) for _ in range(n)]
        case "signed":
            return [rnd.choice([0.0, -0.0, 1.5, -1.5, math.inf, -math.inf, 1e308, -1e308]) for _ in range(n)]
        case "one":
            return [7.25] * n
        case "none":
            return [None] * n
        case _:
            return [rnd.choice([None, math.nan, 1.0, 2.0, 3.0]) for _ in range(n)]


@pytest.mark.parametrize("n", [1, 2, 37, 5000])
def test_places_against_sorting(spark, n):
    rnd = random.Random(n)
    data = {c: column(c, n, rnd) for c in NAMES}
    df = spark.createDataFrame(list(zip(*data.values())), ", ".join(f"{c} double" for c in NAMES)).repartition(3)
    pick = lambda k: sorted({0, (k - 1) // 2, k // 2 if k > 1 else 0, int(0.95 * (k - 1)), k - 1})
    row, got = R.values_at(df, NAMES, pick)
    for c, values in data.items():
        kept = sorted(v for v in values if v is not None and not math.isnan(v))
        assert row[f"n_{c}"] == len(kept)
        assert got[c] == [kept[p] for p in pick(len(kept))] if kept else got[c] == []


def test_few_passes_and_narrow_plans(spark, monkeypatch):
    df = spark.range(200_000).selectExpr("cast(id * 7919 % 200000 as double) / 3 AS a", "exp(cast(id % 700 as double)) AS b")
    passes = []
    seen = type(df).groupBy
    monkeypatch.setattr(type(df), "groupBy", lambda self, *c: passes.append(1) or seen(self, *c))
    _, got = R.values_at(df, ["a", "b"], lambda n: [n // 2])
    assert got["a"] == [100_000 / 3] and len(passes) <= 4


def test_summary_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a double, b int")
    assert [tuple(r) for r in C.numeric_summary(df, ["a", "b"]).collect()] == [("a", *[None] * 5), ("b", *[None] * 5)]
