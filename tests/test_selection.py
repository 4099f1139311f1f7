"""The first rows by counting in ranges against a sort on the driver."""

import math
import random

import pytest

from sievework.plans import selection


def table(kind, n=4000):
    rng = random.Random(7)
    value = {
        "uniform": lambda i: rng.random(),
        "hot": lambda i: 0.5 if i % 3 else rng.random(),
        "far": lambda i: rng.choice([1e-300, 1e300, -1e300, 0.0, -0.0]) * rng.random(),
        "odd": lambda i: [None, float("nan"), float("inf"), -float("inf"), rng.random()][rng.randrange(5)],
        "long": lambda i: (1 << 60) + rng.randrange(50),
        "one": lambda i: 1.0,
    }[kind]
    return [(i * 7919 % 10007, value(i)) for i in range(n)]


def place(desc):
    def of(row):
        key, v = row
        rank = 0 if v is None else 2 if v != v else 1
        number = 0 if rank != 1 else v
        return (-rank, -number, key) if desc else (rank, number, key)

    return of


@pytest.mark.parametrize("desc", [False, True])
@pytest.mark.parametrize("kind", ["uniform", "hot", "far", "odd", "long", "one"])
def test_first_rows(spark, monkeypatch, kind, desc):
    monkeypatch.setattr(selection, "FEW", 20)
    monkeypatch.setattr(selection, "RANGES", 8)
    rows = table(kind)
    df = spark.createDataFrame(rows, f"k long, v {'long' if kind == 'long' else 'double'}").repartition(6).cache()
    wanted = [k for k, _ in sorted(rows, key=place(desc))]
    for k in (0, 1333, 3999, 9000):
        got = selection.first_rows(df, "v", "k", k, desc)
        assert got.columns == ["k", "v"]
        assert sorted(r.k for r in got.collect()) == sorted(wanted[:k]), k


def test_text_and_small_tables(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "a")], "k int, v string")
    assert sorted(r.k for r in selection.first_rows(df, "v", "k", 2).collect()) == [2, 3]
    assert sorted(r.k for r in selection.first_rows(df, "v", "k", 2, desc=True).collect()) == [1, 3]
    assert selection.first_rows(df.where("k > 9"), "k", "v", 2).count() == 0


def test_rows_stay_where_they_are(spark):
    df = spark.range(0, 200_000, 1, 16).selectExpr("id AS k", "CAST((id * 7919) % 200003 AS double) AS v")
    got = selection.first_rows(df, "v", "k", 100_000)
    sizes = sorted(len(p) for p in got.select("k").rdd.glom().collect())
    assert sum(sizes) == 100_000 and sizes[-1] < 20_000
    assert math.isclose(got.agg({"v": "max"}).first()[0], sorted((i * 7919) % 200003 for i in range(200_000))[99_999])
