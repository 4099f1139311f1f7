"""Draws sum up runs of negatives together and give the same precisions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.operators import bootstrap as B
from sievework.operators import metrics as M


def test_runs_of_negatives_are_one():
    y = np.array([0, 0, 0, 0, 1, 0, 0, 0, 0], bool)
    assert B.segments(np.array([0, 1, 2, 3, 5, 6, 7, 8]), y).tolist() == [0, 1, 3, 5, 8]
    assert B.segments(np.array([0]), y).tolist() == [0]


def test_small_weights_equal_the_weights():
    keys = [f"k{i}" for i in range(3000)]
    assert (B.small_weights(5, 3, 90, keys) == B.row_weights(5, 3, 90, keys)).all() and B.small_weights(5, 3, 90, keys).dtype == np.uint8


def test_draws_equal_weighted_precision(spark):
    rng = np.random.default_rng(4)
    rows = [(f"r{i}", m, float(np.round(s, 2)), int(rng.random() < 0.1)) for i in range(600) for m, s in (("a", rng.random()), ("b", i // 200))]
    df = spark.createDataFrame(rows, "id string, method string, score double, y int")
    got = {(r.draw, r.method): r.ap for r in B.ap_draws(df, "id", "method", "score", "y", 5, 8).collect()}
    weights = B.row_weights(8, 0, 5, [f"r{i}" for i in range(600)])
    long = spark.createDataFrame([(f"r{i}", d, float(w)) for i, row in enumerate(weights) for d, w in enumerate(row)], "id string, draw int, w double")
    want = M.ap_tie_aware(df.join(long, "id").where(F.col("w") > 0), "score", "y", ("draw", "method"), "w").collect()
    assert got == {(r.draw, r.method): pytest.approx(r.ap, abs=1e-12) for r in want}
