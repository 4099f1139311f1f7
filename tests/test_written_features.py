"""Features are joined once where they are read again, the joins carry no flags, and trees take odd numbers as before."""

import os

import numpy as np
import pytest

from sievework.operators import models as L
from sievework.plans import q_models
from sievework.plans import views as V

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_features_hold_the_join(spark):
    rows = V.written_features(spark, SF, "row_id", "y", "x1")
    assert "Join" not in plan_of(rows) and rows.columns == ["row_id", "y", "x1"]
    assert sorted(rows.collect()) == sorted(V.features(spark, SF).select("row_id", "y", "x1").collect())


def test_heads_are_read_from_a_table(spark):
    assert all("lineitem" not in plan_of(df) for df in q_models.heads(spark, SF))


def test_odd_numbers_go_down_a_tree(spark):
    tree = (np.array([0, 0, 0], "<i2"), np.array([1.0, np.inf, np.inf]), np.array([1, 1, 2], "<i4"), np.array([0.0, 3.0, 9.0], "<f4"), 8)
    df = spark.createDataFrame([(0, 0.5), (1, 1.0), (2, float("nan")), (3, float("inf")), (4, float("-inf")), (5, None)], "k int, a double")
    score = {r.k: r.score for r in L.isolation_score(df, [tree], ["a"]).collect()}
    assert score[0] == score[4] > score[1] == score[2] == score[3] == score[5]
