"""Pools that merge against pooling all scores in one list."""

import random

import numpy as np
import pytest

from sievework.operators import isotonic as I


def by_hand(rows):
    """The pools as lists of scores with their mean, by the textbook's pass over all scores."""
    sums = {}
    for s, y in rows:
        n, p = sums.get(s, (0, 0))
        sums[s] = (n + 1, p + y)
    blocks = []
    for s in sorted(sums):
        blocks.append([*sums[s], [s]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n, p, at = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n, blocks[-1][1] + p, blocks[-1][2] + at]
    return [(at[0], at[-1], n, p) for n, p, at in blocks]


def table(trend, n=3000):
    rng = random.Random(trend)
    chance = {"rises": lambda s: s, "falls": lambda s: 1 - s, "waves": lambda s: 0.5 + 0.4 * np.sin(40 * s), "one": lambda s: 1.0}[trend]
    scores = [0.25 if i % 3 == 0 else rng.random() for i in range(n)]  # a third have one score
    return [(s, int(rng.random() < chance(s))) for s in scores]


@pytest.mark.parametrize("trend", ["rises", "falls", "waves", "one"])
@pytest.mark.parametrize("ranges", [1, 13])
def test_pools_of_ranges_merge(spark, trend, ranges):
    rows = table(trend)
    found = I.pools(spark.createDataFrame(rows, "s double, y int"), "s", "y", ranges)
    assert sorted(tuple(r) for r in found.collect()) == by_hand(rows)


@pytest.mark.parametrize("most_sent", [10**6, 0])
def test_scores_between_and_beyond_pools(spark, most_sent):
    rows = table("rises", 900)
    df = spark.createDataFrame(rows, "s double, y int")
    asked = [(i, v, "x") for i, v in enumerate([-1.0, 2.0, None, float("nan"), *(k / 97 for k in range(98)), *(s for s, _ in rows[:50])])]
    got = I.calibrated(spark.createDataFrame(asked, "row_id int, s double, calibrated string"), I.pools(df, "s", "y", 5), "s", most_sent)
    assert got.columns == ["row_id", "s", "calibrated"]
    values = {r.row_id: r.calibrated for r in got.collect()}
    pools = by_hand(rows)
    x, y = [v for low, high, *_ in pools for v in (low, high)], [p / n for *_, n, p in pools for _ in range(2)]
    assert len(values) == len(asked)
    for i, s, _ in asked:
        assert values[i] is None if s is None or s != s else values[i] == pytest.approx(np.interp(s, x, y))


@pytest.mark.parametrize("most_sent", [10**6, -1])
def test_no_rows_to_fit(spark, most_sent):
    none = spark.createDataFrame([(None, 1), (0.5, None)], "s double, y int")
    asked = spark.createDataFrame([(1, 0.5), (2, None)], "row_id int, s double")
    assert [r.calibrated for r in I.calibrated(asked, I.pools(none, "s", "y"), "s", most_sent).collect()] == [None, None]
