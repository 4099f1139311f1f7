"""Rows are made once, put in order packed, and cut at bounds from marks; methods may be columns of a row."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.operators import bootstrap as B
from sievework.operators import metrics as M


def test_places():
    scores = [float("nan"), float("inf"), 1e300, 2.5, 1e-310, 0.0, -1e-310, -2.5, -1e300, float("-inf"), None]
    places = B.places_of(pa.array(scores, pa.float64()))
    assert (places[1:] > places[:-1]).all()
    same = B.places_of(pa.array([0.0, -0.0, float("nan"), -float("nan")]))
    assert same[0] == same[1] and same[2] == same[3] == places[0]


@pytest.mark.parametrize("step", [1, 40])
def test_run_sums(step):
    w, begins = np.random.default_rng(3).integers(0, 9, (400, 6), np.uint8), np.arange(0, 400, step)
    assert (B.run_sums(w, begins) == [w[a : a + step].sum(0) for a in begins]).all()


def expected(spark, df, n, draws, seed):
    weights = B.row_weights(seed, 0, draws, [f"r{i}" for i in range(n)])
    long = spark.createDataFrame([(f"r{i}", d, float(w)) for i, row in enumerate(weights) for d, w in enumerate(row)], "id string, draw int, w double")
    return {(r.draw, r.method): pytest.approx(r.ap, abs=1e-12) for r in M.ap_tie_aware(df.join(long, "id").where(F.col("w") > 0), "score", "y", ("draw", "method"), "w").collect()}


def test_methods_as_columns(spark, monkeypatch):
    rng = np.random.default_rng(4)
    n, rows = 300, []
    for i in range(n):
        rows.append((f"r{i}", int(rng.random() < 0.2), float(np.round(rng.random(), 1)), [None, float("nan"), 1.0, -float("inf")][i % 4]))
    df = spark.createDataFrame(rows, "id string, y int, a double, b double").repartition(3)
    long = df.select("id", "y", F.explode(F.array(*(F.struct(F.lit(k).alias("method"), F.col(k).alias("score")) for k in "ab"))).alias("e")).select("id", "y", "e.*")
    want = expected(spark, long, n, 4, 5)
    monkeypatch.setattr(B, "PACKED", 20)
    monkeypatch.setattr(B, "HELD", 64)
    monkeypatch.setattr(B, "MARKED", 8)
    # null is below -inf and NaN above all, as in the order of Spark and the SQL
    assert {(r.draw, r.method): r.ap for r in B.ap_draws(long, "id", "method", "score", "y", 4, 5).collect()} == want
    assert {(r.draw, r.method): r.ap for r in B.ap_draws(df, "id", "method", {k: F.col(k) for k in "ab"}, "y", 4, 5).collect()} == want


def test_rows_are_made_once_and_a_hot_score_is_dealt_out(spark, monkeypatch):
    made, n = spark.sparkContext.accumulator(0), 4000

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = spark.range(n, numPartitions=3).select(F.concat(F.lit("r"), F.col("id")).alias("id"), F.lit("m").alias("method"), F.when(F.col("id") % 10 == 0, F.col("id") / n).otherwise(0.5).alias("score"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    want = expected(spark, df, n, 3, 9)
    monkeypatch.setattr(B, "PACKED", 100)
    monkeypatch.setattr(B, "HELD", 500)
    monkeypatch.setattr(B, "MARKED", 10)
    written = {}

    def kept(frame, name, f=B.staged):
        written[name] = f(frame, name)
        return written[name]

    monkeypatch.setattr(B, "staged", kept)
    got = {(r.draw, r.method): r.ap for r in B.ap_draws(df.mapInArrow(seen, df.schema), "id", "method", "score", "y", 3, 9).collect()}
    assert got == want and made.value == n
    sizes = [r.n for r in written["order"].groupBy(F.expr("range >> 33")).agg(F.sum(F.col("p") + F.col("n")).alias("n")).collect()]
    assert sum(sizes) == n and len(sizes) >= 30 and max(sizes) <= 300


@pytest.mark.parametrize(("most", "kept"), [(0, "none"), (2, "some"), (1000, "all")])
def test_runs_are_kept_where_few(spark, monkeypatch, most, kept):
    """Sums of few runs are written with the piece's totals, so its rows are weighted once; many runs are made from the rows again."""
    n = 600
    rows = [(f"r{i}", m, float(i // 2 if m == "a" else i // 200), int(i % 3 == 0)) for i in range(n) for m in "ab"]
    df = spark.createDataFrame(rows, "id string, method string, score double, y int")
    want = expected(spark, df, n, 4, 7)
    monkeypatch.setattr(B, "PACKED", 150)
    monkeypatch.setattr(B, "WEIGHTS", 240)
    monkeypatch.setattr(B, "ROW_BYTES", 1)
    monkeypatch.setattr(B, "KEPT", most)
    written = {}

    def keep(frame, name, f=B.staged):
        written[name] = f(frame, name)
        return written[name]

    monkeypatch.setattr(B, "staged", keep)
    got = {(r.draw, r.method): r.ap for r in B.ap_draws(df, "id", "method", "score", "y", 4, 7).collect()}
    assert got == want
    share = written["sums"].agg(F.avg(F.col("run_n").isNotNull().cast("int"))).first()[0]
    assert {"none": share == 0, "some": 0 < share < 1, "all": share == 1}[kept]
