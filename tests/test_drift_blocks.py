"""Permutation tests by pairs of blocks against whole distance matrices."""

import hashlib
import random

import numpy as np
import pytest

from sievework.operators import drift as D

SEED, DRAWS = 9, 30


def by_hand(rows, used):
    """(statistic, p) of (key, label, x) by the definition, one permutation after the other."""
    rows = sorted(rows, key=lambda r: r[0])
    x, y = np.array([[r[2][k] for k in used] for r in rows]), np.array([r[1] for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))

    def statistic(label):
        a, b = label == 1, label == 0
        return 2 * d[a][:, b].mean() - d[a][:, a].mean() - d[b][:, b].mean()

    seen, large = statistic(y), 0
    for p in range(DRAWS):
        u = [int(hashlib.md5(f"{SEED}:{p}:{r[0]}".encode()).hexdigest()[:8], 16) for r in rows]
        label = np.zeros(len(rows))
        label[np.lexsort((range(len(rows)), u))[: y.sum()]] = 1
        large += statistic(label) >= seen - 1e-12
    return seen, (large + 1) / (DRAWS + 1)


@pytest.mark.parametrize("block", [512, 37])
def test_blocks_give_the_whole(spark, block):
    rng = random.Random(5)
    groups = {"a": 150, None: 90}
    rows = [(g, i, int(rng.random() < 0.3), rng.gauss(0, 1), round(rng.random(), 1)) for g, n in groups.items() for i in range(n)]
    rows += [("one", i, 1, 0.5, 0.5) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, id long, y int, u double, v double").repartition(3)
    got = {(r.g, r.representation): (r.statistic, r.p) for r in D.permutation_tests(df, "id", "y", {"u": ["u"], "uv": ["u", "v"]}, DRAWS, SEED, ("g",), block).collect()}
    assert len(got) == 6 and got["one", "u"] == (None, None)
    for g in groups:
        for name, used in (("u", [0]), ("uv", [0, 1])):
            assert got[g, name] == pytest.approx(by_hand([(i, y, (u, v)) for h, i, y, u, v in rows if h == g], used))


def test_more_rows_than_once_were_allowed(spark):
    df = spark.range(4600).selectExpr("id", "CAST(id % 5 = 0 AS int) AS y", "CAST((id * 7919) % 4603 AS double) / 4603 AS x")
    r = D.permutation_test(df, "id", "y", ["x"], 20, 3).first()
    x = np.array([(i * 7919) % 4603 / 4603 for i in range(4600)])
    a, b = x[::5], np.delete(x, np.arange(0, 4600, 5))
    gap = lambda u, v: np.abs(u[:, None] - v[None]).mean()
    assert r.statistic == pytest.approx(2 * gap(a, b) - gap(a, a) - gap(b, b)) and 0 < r.p <= 1
