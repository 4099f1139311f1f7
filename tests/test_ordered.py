"""Global ranks, quantiles and falls over many buckets, groups and levels against plain sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.operators import aggregates as A
from sievework.operators import contracts as K
from sievework.operators import encode as E
from sievework.plans import ordered as O


@pytest.fixture
def small_buckets(spark):
    """Many ranges on few rows."""
    changed = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("sent", [1000, 2])
@pytest.mark.parametrize("groups", [(), ("g",)])
@pytest.mark.parametrize("text", [False, True])
def test_positions_and_sums(spark, small_buckets, monkeypatch, sent, groups, text):
    monkeypatch.setattr(O, "MOST_SENT", sent)
    rng = random.Random(9)
    rows = [(i, i % 3 if i % 7 else None, rng.choice([None, 2.5, rng.random() * 50, float(rng.randrange(6))])) for i in range(150)]
    if text:
        rows = [(i, g, None if v is None else f"é{v:08.3f}") for i, g, v in rows]
    df = spark.createDataFrame(rows, f"k long, g int, v {'string' if text else 'double'}").repartition(4)
    got = {r.k: r for r in O.ordered(df, "v", ("k",), groups, sums={"s": F.col("k")}).collect()}
    assert len(got) == len(rows)
    for g in {r[1] for r in rows} if groups else {0}:
        own = sorted(((v is not None, v or 0 if not text else v or "", k) for k, q, v in rows if q == g or not groups))
        run = 0
        for place, (known, v, k) in enumerate(own, 1):
            run += k
            r = got[k]
            assert (r.position, r.total, r.run_s, r.all_s) == (place, len(own), run, sum(x[2] for x in own))
            assert r.below == sum((a, b) < (known, v) for a, b, _ in own) and r.ties == sum((a, b) == (known, v) for a, b, _ in own)


def hot_time(spark):
    """Nine tenths of the rows share one time, and all keys share their first nine bytes."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 < 9, F.lit(5)).otherwise(F.col("id") % 1000).alias("t"), F.format_string("row-%09d", F.col("id") * 7 % 20_011).alias("k"))
    return rows.repartition(6)


@pytest.mark.parametrize("value,tie", [("t", ("k",)), ("k", ()), ("t", ())])
def test_a_hot_value_and_a_long_common_beginning_spread_over_all_ranges(spark, small_buckets, value, tie):
    counts = [r["count"] for r in O.ranged(hot_time(spark), value, tie).groupBy("_b").count().collect()]
    assert len(counts) == 23 and max(counts) < 2 * 20_000 / 23


def test_ranks_of_a_hot_value_equal_sql(spark, small_buckets, monkeypatch):
    monkeypatch.setattr(O, "MOST_SENT", 50)
    rows = hot_time(spark)
    want = rows.collect()
    place = {k: i for i, (_, k) in enumerate(sorted((r.t, r.k) for r in want), 1)}
    below, ties = {}, {}
    for r in want:
        ties[r.t] = ties.get(r.t, 0) + 1
    for t in ties:
        below[t] = sum(n for x, n in ties.items() if x < t)
    for r in O.ordered(rows, "t", ("k",)).collect():
        assert (r.position, r.below, r.ties, r.total) == (place[r.k], below[r.t], ties[r.t], 20_000)


def test_rows_that_are_equal_in_all_columns(spark, small_buckets):
    rows = spark.range(3000).select(F.lit(1.5).alias("v"), F.lit("g").alias("g"), F.lit(2).alias("n"))
    got = O.ordered(rows, "v", (), ("g",), sums={"n": F.col("n")}).collect()
    assert sorted(r.position for r in got) == list(range(1, 3001)) and {(r.run_n, r.all_n) for r in got if r.position == 7} == {(14, 6000)}
    assert {(r.below, r.ties) for r in got} == {(0, 3000)}


def test_order_of_dates_decimals_nan_and_falling_nulls(spark, small_buckets):
    rows = spark.sql("SELECT * FROM VALUES (1, DATE'2024-01-02', 1.50BD, double('NaN')), (2, NULL, NULL, NULL), (3, DATE'2023-01-02', 2.25BD, 1.0D), (4, DATE'2024-01-02', 1.50BD, 7.0D) t(k, d, x, f)")
    for column, desc in [("d", False), ("d", True), ("x", False), ("x", True), ("f", False), ("f", True)]:
        got = [r.k for r in O.ordered(rows, column, ("k",), desc=desc).orderBy("position").collect()]
        assert got == [r.k for r in rows.orderBy(F.desc(column) if desc else F.asc(column), "k").collect()]


def test_quantiles_by_group(spark, small_buckets):
    rng = random.Random(2)
    rows = [(i % 4, float(rng.randrange(30)) if i % 4 else 7.0) for i in range(300)] + [(1, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    qs = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    for r in A.quantiles(df, "v", qs, ("g",)).collect():
        assert r.value == pytest.approx(np.quantile([v for g, v in rows if g == r.g and v is not None], r.q))
    assert A.quantiles(df.limit(0), "v", qs).count() == 0


def test_empirical_distribution_with_a_hot_value(spark, small_buckets):
    rng = random.Random(4)
    rows = [(i, 1.0 if i % 3 else rng.random() * 4, int(i % 2)) for i in range(200)] + [(900, None, 1), (901, None, 0)]
    df = spark.createDataFrame(rows, "k long, v double, f int")
    fit = sorted(v for _, v, f in rows if f and v is not None)
    for r in E.ecdf(df.where("v IS NOT NULL"), "v", F.col("f") == 1).collect():
        assert (r.n_lt, r.n_le, r.n_fit) == (sum(x < r.v for x in fit), sum(x <= r.v for x in fit), len(fit))
    assert E.ecdf(df, "v", F.col("f") == 1).count() == len(rows)


@pytest.mark.parametrize("width", [2, 5, 4096])
def test_falls_over_levels_and_gaps(spark, width):
    rng = random.Random(1)
    rows = sorted({rng.randrange(5000) for _ in range(120)})
    rows = [(k, rng.randrange(9)) for k in rows]
    df = spark.createDataFrame(rows, "k long, v int").repartition(3)
    assert K.falls(df, "v", "k", width).first().falls == sum(b[1] < a[1] for a, b in zip(rows, rows[1:], strict=False))
    assert K.falls(df.limit(0), "v", "k", width).first().falls == 0
