"""Empirical distributions from packed blocks against the plain form, whatever the blocks, ranges and odd values."""

import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import block_ranks as R
from sievework.operators.encode import ecdf


@pytest.mark.parametrize("block, size", [(1 << 15, 1 << 20), (16, 40)])
def test_block_ecdf_equals_ecdf(spark, monkeypatch, block, size):
    monkeypatch.setattr(R, "BLOCK", block)
    monkeypatch.setattr(R, "RANGE", size)
    rng = random.Random(4)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 7.0, 7.0, 7.0]
    rows = [(f"r{i}" if i else None, rng.choice([True, False, None]), rng.choice(odd) if rng.random() < 0.5 else rng.gauss(0, 3), float(rng.randrange(5))) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, f boolean, a double, b double").repartition(3).cache()
    got = {r.k: (r.au, r.bu) for r in R.block_ecdf(df, {"a": F.col("a"), "b": F.col("b")}, F.col("f"), ("k",)).collect()}
    want = [{r.k: r.u for r in ecdf(df, c, F.coalesce(F.col("f"), F.lit(False))).collect()} for c in "ab"]
    assert len(got) == 300
    for i in range(2):
        assert {k: v[i] for k, v in got.items()} == pytest.approx(want[i])


def test_steps_of_whole_numbers_come_back():
    import numpy as np

    x = np.array([-(2**63), -5, 0, 3, 2**62, 2**63 - 1])
    assert (R.thick(R.thin(x)) == x).all()


def test_overlap_does_not_move_whole_rows_once_a_variate(spark, tmp_path):
    """nothing but blocks and ranks is written, three tables in place of one for each of six variates."""
    from sievework.plans import staging
    from sievework.plans import q_features as Q

    made, real = [], staging.scratch
    with pytest.MonkeyPatch.context() as m:
        m.setattr(staging, "scratch", lambda spark, name: made.append(name) or real(spark, name))
        Q.feat_cross_view_overlap(spark, "/root/testdata/sf0.001")
    assert sorted(made) == ["blocks", "features", "ranks"]


@pytest.mark.parametrize("block, size", [(1 << 16, 1 << 20), (16, 40)])
def test_stable_orders_equal_the_plain_form(spark, monkeypatch, block, size):
    """Ties by key, one score for all rows, odd scores, null labels; with small blocks and ranges cut within a score."""
    from sievework.operators import metrics as M

    monkeypatch.setattr(R, "KEYED", block)
    monkeypatch.setattr(R, "RANGE", size)
    rng = random.Random(5)
    odd = [None, float("nan"), float("inf"), 0.0, -0.0, 2.0]
    rows = [(f"k{rng.random()}", rng.choice([0, 0, 1, None]), rng.choice(odd) if rng.random() < 0.4 else float(rng.randrange(6)), rng.random()) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, y int, a double, b double").repartition(3)
    scores = {"a": F.col("a"), "b": F.col("b"), "one": F.lit(0.5)}
    got = {r.method: r.ap for r in R.ap_stable_orders(df, scores, "y", "k").collect()}
    want = {m: M.ap_stable_order(df.withColumn("s", c), "s", "y", "k").first().ap for m, c in scores.items()}
    assert got == pytest.approx(want)
    assert [r.ap for r in R.ap_stable_orders(df.where("y = 0"), {"a": F.col("a")}, "y", "k").collect()] == [None]
    assert R.ap_stable_orders(df.limit(0), scores, "y", "k").count() == 0


def test_the_query_orders_its_lines_once(spark):
    """packed blocks and the positives' steps are written, not a row for each line and method."""
    from sievework.plans import q_metrics as Q
    from sievework.plans import staging

    made, real = [], staging.scratch
    with pytest.MonkeyPatch.context() as m:
        m.setattr(staging, "scratch", lambda spark, name: made.append(name) or real(spark, name))
        Q.ap_stable_order(spark, "/root/testdata/sf0.001")
    assert sorted(made) == ["blocks", "steps"]


def test_ends_of_a_split_in_time(spark, monkeypatch):
    """Against the plain order: ends within a time, at its last row, null times and keys, equal rows on both sides; and only rows
    of the times at the ends are put in order."""
    from sievework.operators import sampling as P

    def plain(rows, train, val):
        first = lambda x: (x is not None, x or 0)
        order = sorted(rows, key=lambda r: (first(r[0]), first(r[1])))
        n = len(rows)
        return sorted(str((*r, "train" if i < int(round(n * train, 9)) else "val" if i < int(round(n * val, 9)) else "test")) for i, r in enumerate(order))

    rng = random.Random(6)
    tables = [[(i % 7, i) for i in range(101)], [(1, i) for i in range(20)], [(i, 0) for i in range(10)], [(rng.choice([None, 1, 2]), i or None) for i in range(50)], [(1, 5)] * 10, [(2, 1)]]
    for rows in tables:
        df = spark.createDataFrame(rows, "t long, k long").repartition(3)
        for train, val in ((0.6, 0.8), (0.0, 1.0)):
            got = sorted(str((r.t, r.k, r.split)) for r in P.split_chronological(df, "t", "k", train, val).select("t", "k", "split").collect())
            assert got == plain(rows, train, val), (rows[:3], train)
    monkeypatch.setattr(P, "chrono_rank", None)
    P.split_chronological(spark.createDataFrame(tables[0], "t long, k long"), "t", "k").count()


def test_the_flagship_joins_no_rows_by_their_ids(spark):
    """the scores come with label and split, nothing is written per row and column."""
    from sievework.plans import q_flagship as Q
    from sievework.plans import staging

    made, real = [], staging.scratch
    with pytest.MonkeyPatch.context() as m:
        m.setattr(staging, "scratch", lambda spark, name: made.append(name) or real(spark, name))
        assert Q.routed_evaluation(spark, "/root/testdata/sf0.001").count() == 3
    assert "long" not in made and {"blocks", "ranks", "scored"} <= set(made)
