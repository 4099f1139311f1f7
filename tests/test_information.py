"""Information by nearest neighbours against its definition."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import features as X


def psi(n):
    return sum(1 / i for i in range(1, n)) - X.EULER


def by_hand(rows, k):
    sizes = {}
    for y, _ in rows:
        sizes[y] = sizes.get(y, 0) + 1
    rows = [(y, x) for y, x in rows if sizes[y] > 1]
    total = 0
    for i, (y, x) in enumerate(rows):
        near = sorted(abs(v - x) for j, (c, v) in enumerate(rows) if c == y and j != i)[:k]
        r = near[-1]
        m = sum(v == x if r == 0 else x - r < v < x + r for _, v in rows)
        total += psi(len(near)) - psi(sizes[y]) - psi(m)
    return psi(len(rows)) + total / len(rows)


@pytest.mark.parametrize("span", [10_000, 17])
def test_nearest_information(spark, span):
    rng = random.Random(2)
    rows = []
    for i in range(260):
        y = rng.choice(["a", "a", "b"]) if i else "alone"
        near = rng.randrange(64) / 8 + (2 if y == "b" else 0)  # many ties, exact in binary
        rows.append((i, y, near, rng.randrange(1 << 20) / 1024, 1.0))
    rows += [(900 + i, "few", 0.25 * i, 3.0 * i, 1.0) for i in range(3)]
    odd = [(1000, None, 1.0, 1.0, 1.0), (1001, "a", None, float("nan"), float("inf"))]
    df = spark.createDataFrame(rows + odd, "id int, y string, u double, v double, w double").repartition(5)
    got = {r.feature: r.mi for r in X.nearest_information(df, ["u", "v", "w"], "y", "id", 4, span).collect()}
    for c, name in enumerate("uvw"):
        assert got[name] == pytest.approx(by_hand([(r[1], r[2 + c]) for r in rows], 4), abs=1e-9)


def test_copies_are_counted_first(spark, monkeypatch):
    """What goes into the orders is a row a class and value, not a row a row."""
    rng, sizes = random.Random(5), []
    rows = [(i, rng.choice("ab"), rng.randrange(6) / 4 if i % 97 else 50.0 + i) for i in range(900)]

    def watched(df, *a, f=X.ordered, **b):
        sizes.append(df.count())
        return f(df, *a, **b)

    monkeypatch.setattr(X, "ordered", watched)
    df = spark.createDataFrame(rows, "id int, y string, u double").repartition(3)
    got = X.nearest_information(df, ["u"], "y", "id", 3, 5).first().mi
    values = len({r[1:] for r in rows})
    assert sizes == [values, 3 * values] and got == pytest.approx(by_hand([r[1:] for r in rows], 3), abs=1e-9)


def test_digamma(spark):
    for r in spark.range(1, 60).select("id", X.digamma(F.col("id")).alias("v")).collect():
        assert math.isclose(r.v, psi(r.id), abs_tol=1e-11)
