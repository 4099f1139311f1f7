"""Neighbours and kernel sums by boxes against all distances."""

import numpy as np
import pytest

from sievework.operators.boxes import Boxes


def all_distances(x, at):
    return np.sqrt(((x[:, None] - at[None]) ** 2).sum(2))


def placed(n, seed, dims=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) + rng.integers(0, 4, (n, 1))
    x[: n // 3] = x[0]  # a third are copies
    return x


@pytest.mark.parametrize(("n", "k"), [(0, 3), (1, 3), (2, 5), (40, 35), (700, 7)])
def test_nearest_is_exact_with_ties(n, k):
    at = np.round(placed(n, 1), 1) if n else np.zeros((0, 2))
    names, x = np.arange(n) * 2, np.round(placed(90, 2), 1)
    ids = np.arange(90)
    want = []
    for i, row in zip(ids, all_distances(x, at) if n else np.zeros((90, 0)), strict=True):
        near = sorted((d, name) for d, name in zip(row, names, strict=True) if name != i)[:k]
        want += [(i, name, round(d, 9)) for d, name in near]
    got = [(i, m, round(d, 9)) for a in Boxes(names, at).nearest(ids, x, k) for i, m, d in zip(*a, strict=True)]
    assert sorted(got) == sorted(want)


def test_nearest_looks_at_a_tenth():
    rng = np.random.default_rng(3)
    at, x = rng.random((20_000, 2)), rng.random((4_000, 2))
    boxes = Boxes(np.arange(20_000), at)
    got = {}
    for ids, _, d in boxes.nearest(-1 - np.arange(4_000), x, 35):
        for i in np.unique(ids):
            got[i] = d[ids == i].max()
    assert boxes.distances < len(x) * len(at) / 10
    assert np.allclose([got[-1 - i] for i in range(200)], np.sort(all_distances(x[:200], at), 1)[:, 34])


@pytest.mark.parametrize("bandwidth", [0.003, 0.05, 5.0])
def test_kernel_sums_within_their_error(bandwidth):
    rng = np.random.default_rng(4)
    at, x = rng.random((5_000, 2)), np.vstack([rng.random((300, 2)), [[40.0, -3.0]]])
    boxes = Boxes(np.arange(5_000), at)
    e = -(all_distances(x, at) ** 2) / (2 * bandwidth**2)
    want = e.max(1) + np.log(np.exp(e - e.max(1)[:, None]).sum(1))
    assert np.allclose(boxes.log_kernel_sum(x, bandwidth, 1e-10), want, atol=2e-10, rtol=1e-13)
    if bandwidth < 0.01:
        assert boxes.distances < x.shape[0] * len(at) / 10


def test_rows_and_landmarks_that_are_not_finite():
    at = np.array([[0.0, 0.0], [np.nan, 1.0], [np.inf, 1.0], [1.0, 1.0]])
    boxes = Boxes(np.arange(4), at)
    x = np.array([[0.0, np.nan], [0.0, 0.0]])
    (ids, names, d), = boxes.nearest(np.array([8, 9]), x, 3)
    assert list(ids) == [9, 9] and list(names) == [0, 3] and d[0] == 0
    density = boxes.log_kernel_sum(x, 1.0, 1e-10)
    assert np.isnan(density[0]) and np.isclose(density[1], np.log(1 + np.exp(-1)))
