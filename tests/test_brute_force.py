"""Fitted models, draws and features against plain numpy forms of their definitions."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions import scalars as S
from sievework.operators import bootstrap as B
from sievework.operators import drift as D
from sievework.operators import features as X
from sievework.operators import models as L
from sievework.operators import sampling as P
from sievework.operators import scores as C

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(3)
    rows = []
    for i in range(240):
        y = int(i % 4 == 0)
        a = rng.gauss(2 * y, 1)
        rows.append((i, y, a, 0.6 * a + rng.gauss(0, 1), round(rng.gauss(-y, 1), 1)))
    return rows, spark.createDataFrame(rows, "row_id long, y int, a double, b double, c double").repartition(3)


def matrix(rows, only=None):
    return np.array([r[2:] for r in rows if only is None or r[1] == only])


def test_pca_error(points):
    rows, df = points
    fit, x = matrix(rows, 0), matrix(rows)
    _, _, vt = np.linalg.svd(fit - fit.mean(0), full_matrices=False)
    z = x - fit.mean(0)
    left = z - z @ vt[:2].T @ vt[:2]
    got = {r.row_id: r.score for r in L.pca_error(df.where("y = 0"), df, COLS, 2).collect()}
    assert np.allclose([got[r[0]] for r in rows], (left**2).mean(1))


def test_gmm_is_expectation_maximisation(points):
    rows, df = points
    fit = df.where("y = 0")
    starts = np.array([[r[c] for c in COLS] for r in P.landmarks(fit, "row_id", 3, 1).collect()])
    x = matrix(rows, 0)
    w, mean, var = np.full(3, 1 / 3), starts, np.tile(x.var(0) + 1e-6, (3, 1))
    for _ in range(4):
        logs = np.log(w) - 0.5 * (len(COLS) * math.log(2 * math.pi) + np.log(var).sum(1) + (((x[:, None] - mean) ** 2) / var).sum(2))
        r = np.exp(logs - logs.max(1, keepdims=True))
        r /= r.sum(1, keepdims=True)
        mass = r.sum(0)
        w, mean = mass / len(x), r.T @ x / mass[:, None]
        var = np.maximum(1e-6, r.T @ (x * x) / mass[:, None] - mean**2)
    got = sorted(L.gmm_diag(fit, COLS, 3, 4), key=lambda m: m[1])
    want = sorted(zip(w, mean.tolist(), var.tolist(), strict=True), key=lambda m: m[1])
    for g, t in zip(got, want, strict=True):
        assert np.allclose(g[0], t[0]) and np.allclose(g[1], t[1]) and np.allclose(g[2], t[2])


def test_isotonic_pools_adjacent_violators(spark):
    rng = random.Random(4)
    rows = [(float(rng.randrange(40)), int(rng.random() < 0.2 + 0.01 * i)) for i in range(60)]
    sums = {}
    for s, y in rows:
        n, p = sums.get(s, (0, 0))
        sums[s] = (n + 1, p + y)
    blocks = []
    for s in sorted(sums):
        blocks.append([*sums[s], [s]])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] > blocks[-1][1] / blocks[-1][0]:
            n, p, at = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n, blocks[-1][1] + p, blocks[-1][2] + at]
    want = {s: p / n for n, p, at in blocks for s in at}
    df = spark.createDataFrame(rows, "s double, y int")
    for r in L.isotonic(df, df, "s", "y").collect():
        assert r.calibrated == pytest.approx(want[r.s])


def test_nystrom_features_give_the_kernel_back(points):
    rows, df = points
    marks = P.landmarks(df, "row_id", 12, 5)
    kernel = lambda u, v: S.rbf_kernel(u, v, 0.5)
    f = X.nystrom(df, marks, COLS, kernel)
    at = {r[0]: np.array(r[2:]) for r in rows}
    m = np.array([at[i] for i in sorted(r.row_id for r in marks.collect())])
    k = lambda p, q: np.exp(-0.5 * ((p[:, None] - q[None]) ** 2).sum(2))
    for r in f.collect()[:20]:
        own = np.array([r[f"f{i}"] for i in range(len(m))])
        row = k(at[r.row_id][None], m)
        assert own @ own == pytest.approx((row @ np.linalg.pinv(k(m, m)) @ row.T).item(), rel=1e-4, abs=1e-6)


def test_isolation_trees_and_paths(spark, points):
    rows, df = points
    forest = L.isolation_forest(df.where("y = 0"), COLS, "row_id", 6, 32, 2)
    assert len(forest) == 6 and all(n == 32 for *_, n in forest)
    got = {r.row_id: r.score for r in L.isolation_score(df, forest, COLS).collect()}

    def path(tree, x):
        feature, cut, left, length, _ = tree
        node = 0
        while left[node] != node:
            node = left[node] + (0 if x[feature[node]] < cut[node] else 1)
        return float(length[node])

    for r in rows[:40]:
        mean = sum(path(t, r[2:]) for t in forest) / 6
        assert got[r[0]] == pytest.approx(2 ** (-mean / float(L.expected_path(32))))
    # samples are of different rows, the same on every run, and drawn alike where the rows are many
    many = spark.range(3000).select(F.col("id").alias("row_id"), *(S.keyed_uniform(i, 0, "id").alias(c) for i, c in enumerate(COLS)))
    first, again = (L.isolation_forest(many.repartition(k), COLS, "row_id", 3, 64, 2) for k in (1, 4))
    assert [n for *_, n in first] == [64] * 3 and all(np.array_equal(a[1], b[1]) for a, b in zip(first, again, strict=True))
    drawn = L.tree_samples(many, COLS, "row_id", 3, 64, 2)
    sizes = [r.n for r in drawn.groupBy("tree").agg(F.count_distinct("_key").alias("n")).collect()]
    assert len(sizes) == 3 and all(64 <= n < 64 + 120 for n in sizes)  # not every row for every tree
    few = L.isolation_forest(many.limit(20), COLS, "row_id", 2, 64, 2)
    assert [n for *_, n in few] == [20, 20]


def test_kde_and_neighbours(points):
    rows, df = points
    marks = df.where("row_id < 60")
    x, m = matrix(rows)[:, :2], matrix(rows)[:60, :2]
    d = ((x[:, None] - m[None]) ** 2).sum(2)
    want = np.log(np.exp(-d / (2 * 0.3**2)).mean(1)) - 2 * math.log(0.3 * math.sqrt(2 * math.pi))
    got = {r.row_id: r.log_density for r in C.kde(df, marks, ["a", "b"], 0.3).collect()}
    assert np.allclose([got[r[0]] for r in rows], want)
    near = {}
    for r in C.neighbours(df.select("row_id", "c"), marks, ["c"], 4).collect():
        near.setdefault(r.row_id, set()).add(r.mark)
    for i, r in enumerate(rows):  # rounded values: many ties
        order = sorted((abs(r[4] - rows[j][4]), j) for j in range(60) if j != i)
        assert near[r[0]] == {j for _, j in order[:4]}
    with pytest.raises(ValueError):
        C.shipped_landmarks(marks, ["a"], 59)


@pytest.mark.parametrize("parts", [1, 5])
def test_draws_of_average_precision(spark, parts):
    """Ties within and across ranges, a constant score, two methods that share weights."""
    rng = random.Random(6)
    rows = [(f"r{i}", int(rng.random() < 0.2), m, s) for i in range(150) for m, s in (("one", rng.randrange(12) / 4), ("flat", 0.5), ("fine", rng.random()))]
    df = spark.createDataFrame(rows, "key string, y int, method string, score double")
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, str(parts == 1).lower())
    try:
        got = {(r.draw, r.method): r.ap for r in B.ap_draws(df, "key", "method", "score", "y", 7, 3).collect()}
    finally:
        spark.conf.unset(name)

    def mixed(x):
        x = (x ^ x >> 16) * 0x85EBCA6B % 2**32
        x = (x ^ x >> 13) * 0xC2B2AE35 % 2**32
        return x ^ x >> 16

    def weight(d, key):
        digest = hashlib.md5(f"3:{key}".encode()).hexdigest()
        u = mixed(mixed((int(digest[:8], 16) + d * 0x9E3779B9) % 2**32) ^ int(digest[8:16], 16)) / 2**32
        return sum(u >= c for c in S.POISSON_CUTS)

    for d in range(7):
        for m in ("one", "flat", "fine"):
            n = p = total = 0.0
            own = [(s, y, weight(d, k)) for k, y, q, s in rows if q == m]
            for s in sorted({s for s, _, _ in own}, reverse=True):
                here = [(y, w) for t, y, w in own if t == s]
                pos = sum(y * w for y, w in here)
                n, p = n + sum(w for _, w in here), p + pos
                total += pos * p / n if n else 0
            assert got[d, m] == pytest.approx(total / p)
    assert len(got) == 21


def test_draws_of_one_class_are_replaced(spark, monkeypatch):
    """Of a draw that lacks positives or negatives another takes the place; a method of one class has none."""
    monkeypatch.setattr(B, "BLOCK", 3)
    df = spark.createDataFrame([("a", 0, "m", 1.0), ("b", 1, "m", 0.5), ("c", 0, "none", 0.5)], "key string, y int, method string, score double")
    got = sorted((r.draw, r.method) for r in B.ap_draws(df, "key", "method", "score", "y", 8, 1).collect())
    w = B.row_weights(1, 0, 64, ["a", "b"])
    valid = [d for d in range(64) if w[0, d] > 0 and w[1, d] > 0][:8]
    assert got == [(d, "m") for d in valid] and valid[-1] > 8
    assert B.ap_draws(df.limit(0), "key", "method", "score", "y", 8, 1).count() == 0


def test_weights_are_poisson_and_unrelated():
    w = B.row_weights(5, 100, 400, [f"k{i}" for i in range(2000)])
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.01
    assert max(abs(np.mean(w == k) - math.exp(-1) / math.factorial(k)) for k in range(6)) < 0.002
    off = np.corrcoef(w[:60])[np.triu_indices(60, 1)], np.corrcoef(w[:, :60].T)[np.triu_indices(60, 1)]
    assert np.abs(off[0]).max() < 0.25 and np.abs(off[1]).max() < 0.12
    assert (B.row_weights(5, 130, 7, ["k3"]) == w[3, 30:37]).all()


def test_permutation_test(points, spark):
    rows, df = points
    sample = df.where("row_id < 60").select("row_id", "y", "a", F.lit("w").alias("g"))
    r = D.permutation_test(sample, "row_id", "y", ["a"], 49, 8, ("g",)).first()
    seen = D.energy_distance(sample, "row_id", "y", ["a"]).first().statistic
    labelled = P.permuted_labels(sample, "row_id", "y", 49, 8).select("permutation", "row_id", "a", F.col("permuted").alias("y"))
    null = [D.energy_distance(labelled.where(F.col("permutation") == k), "row_id", "y", ["a"]).first().statistic for k in range(0, 49, 12)]
    assert r.statistic == pytest.approx(seen)
    assert 1 / 50 <= r.p <= 1 and (max(null) < seen or r.p > 1 / 50)


def test_choice_of_strength(points):
    _, df = points
    p = df.withColumn("p", F.lit(0.5) + F.col("a") / 20)
    grid = L.strength_grid(p.where("row_id % 2 = 0"), p.where("row_id % 2 = 1"), "p", ["b", "c"], "y", [0.01, 1.0]).collect()
    assert [r.c for r in grid if r.best] == [max(grid, key=lambda r: (r.ap, r.c)).c]
