"""Rows in order are packed into pieces, and draws read these without another shuffle or hash."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.operators import bootstrap as B
from sievework.operators import metrics as M


def test_rare_weights():
    words = np.random.default_rng(1).integers(0, 1 << 32, (4000, 2), np.uint32)
    x = B.numbers_of(words, 2, 50)
    want = sum((x >= np.uint32(c)).astype(np.uint8) for c in B.CUTS)
    assert want.max() > B.COMMON and (B.weights_of(words, 2, 50) == want).all()


@pytest.mark.parametrize("most", [1, 7, 50])
def test_small_pieces(spark, monkeypatch, most):
    rng = np.random.default_rng(6)
    rows = [(f"r{i}", m, s, int(rng.random() < 0.3)) for i in range(240) for m, s in (("a", float(np.round(rng.random(), 1))), ("b", float(i)), ("c", 0.5 if i % 9 else float("nan")))]
    df = spark.createDataFrame(rows, "id string, method string, score double, y int")
    monkeypatch.setattr(B, "PACKED", most)
    monkeypatch.setattr(B, "WEIGHTS", 60)
    written = {}

    def kept(made, name, f=B.staged):
        written[name] = f(made, name)
        return written[name]

    monkeypatch.setattr(B, "staged", kept)
    got = {(r.draw, r.method): r.ap for r in B.ap_draws(df, "id", "method", "score", "y", 5, 8).collect()}
    weights = B.row_weights(8, 0, 5, [f"r{i}" for i in range(240)])
    long = spark.createDataFrame([(f"r{i}", d, float(w)) for i, row in enumerate(weights) for d, w in enumerate(row)], "id string, draw int, w double")
    want = M.ap_tie_aware(df.join(long, "id").where(F.col("w") > 0), "score", "y", ("draw", "method"), "w").collect()
    assert got == {(r.draw, r.method): pytest.approx(r.ap, abs=1e-12) for r in want}
    # bytes of a row in the order: 8 of score, 8 of words, 1 of label
    sizes = written["order"].select(F.length("scores") / 8, F.length("words") / 8, F.length("labels")).collect()
    assert all(a == b == c <= most for a, b, c in sizes) and sum(r[2] for r in sizes) == 720


def test_later_draws_read_the_same_pieces(spark, monkeypatch):
    """However many blocks of draws are read, rows are put in order and written once, and keys are no part of that."""
    df = spark.createDataFrame([(f"r{i}", "a", float(i % 11), int(i % 4 == 0)) for i in range(120)], "id string, method string, score double, y int")
    want = {r.draw: r.ap for r in B.ap_draws(df, "id", "method", "score", "y", 9, 3).collect()}
    names, columns = [], []

    def kept(made, name, f=B.staged):
        names.append(name)
        columns.extend(made.columns if name == "order" else [])
        return f(made, name)

    monkeypatch.setattr(B, "staged", kept)
    monkeypatch.setattr(B, "BLOCK", 4)
    got = {r.draw: r.ap for r in B.ap_draws(df, "id", "method", "score", "y", 9, 3).collect()}
    assert got == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}
    assert names.count("order") == 1 and names.count("draws") == 3 and "key" not in columns
