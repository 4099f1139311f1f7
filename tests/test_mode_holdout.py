"""The dominant kind of positives is unknown to the fit."""

import numpy as np

from sievework.operators import models as L


def test_dominant_kind_is_held_out(spark):
    rng = np.random.default_rng(6)
    centres = np.array([[0.0, 0.0], [9.0, 0.0], [0.0, 9.0]])
    kind = np.repeat([0, 1, 2, -1], [20, 60, 30, 90])
    at = np.where(kind[:, None] >= 0, centres[kind], 4.0) + rng.normal(0, 0.3, (200, 2))
    rows = [(i, int(kind[i] >= 0), int(kind[i]), float(at[i, 0]), float(at[i, 1])) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id int, y int, kind int, a double, b double").repartition(3)
    fit, test = df.where("row_id % 2 = 0"), df.where("row_id % 2 = 1")
    known, unknown, found, dominant = L.dominant_holdout(fit, test, ["a", "b"], "y", 3)
    assert np.allclose(found[dominant], at[(kind == 1) & (np.arange(200) % 2 == 0)].mean(0))  # a centre is its rows' mean
    assert known.columns == unknown.columns == df.columns
    assert sorted(r.row_id for r in known.collect()) == [i for i in range(0, 200, 2) if kind[i] != 1]
    assert sorted(r.row_id for r in unknown.collect()) == [i for i in range(1, 200, 2) if kind[i] in (-1, 1)]


def test_no_positives(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (2, 1, 0.7)], "row_id int, y int, a double")
    known, unknown, centres, dominant = L.dominant_holdout(df.where("y = 0"), df, ["a"], "y", 3)
    assert known.count() == 1 and [r.row_id for r in unknown.collect()] == [1] and centres == [] and dominant == -1
