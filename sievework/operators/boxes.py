"""Landmarks in boxes: a k-d tree over a stated set that every task gets, for exact neighbours and kernel sums."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Landmarks of a box, at most, and rows that are searched for together.
LEAF, TOGETHER = 32, 256


class Boxes:
    """A balanced k-d tree. All boxes are on one level; each is split at the median of its widest side.

    Rows of one box are searched for together: a box of landmarks is left out if its least distance from the box of the
    rows shows that it can't matter. `distances` counts the distances to landmarks that were computed. Landmarks with a
    coordinate that isn't finite are left out; a row with one has no neighbours and a density of NaN.
    """

    def __init__(self, names: np.ndarray, at: np.ndarray) -> None:
        finite = np.isfinite(at).all(1)
        self.names, self.at, self.distances = names[finite], at[finite], 0
        depth = max(0, math.ceil(math.log2(max(1, len(self.at)) / LEAF)))
        parts = [np.arange(len(self.at))]
        self.side, self.cut = [], []
        for _ in range(depth):
            halves = []
            for part in parts:
                side = int(np.argmax(np.ptp(self.at[part], 0)))
                half = len(part) // 2
                part = part[np.argpartition(self.at[part, side], half)]
                self.side.append(side)
                self.cut.append(self.at[part[half], side])
                halves += [part[:half], part[half:]]
            parts = halves
        self.parts, self.depth = parts, depth
        self.side, self.cut = np.array(self.side, int), np.array(self.cut, float)
        self.sizes = np.array([len(p) for p in parts])
        if len(self.at):
            self.low, self.high = (np.array([f(self.at[p], 0) for p in parts]) for f in (np.min, np.max))

    def together(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, least, most) of at most TOGETHER finite rows of x that fall in one box: squared bounds of their distance to
        each box of landmarks."""
        rows = np.flatnonzero(np.isfinite(x).all(1))
        node = np.zeros(len(rows), int)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.side[node]] >= self.cut[node])
        order = np.argsort(node, kind="stable")
        rows, node = rows[order], node[order]
        for group in np.split(rows, np.flatnonzero(np.diff(node)) + 1):
            for i in range(0, len(group), TOGETHER):
                some = group[i : i + TOGETHER]
                low, high = x[some].min(0), x[some].max(0)
                apart = np.maximum(0, np.maximum(self.low - high, low - self.high))
                across = np.maximum(self.high - low, high - self.low)
                yield some, (apart**2).sum(1), (across**2).sum(1)

    def squared(self, x: np.ndarray, points: np.ndarray) -> np.ndarray:
        self.distances += len(x) * len(points)
        return sum((x[:, None, k] - self.at[None, points, k]) ** 2 for k in range(x.shape[1]))

    def points(self, boxes: np.ndarray) -> np.ndarray:
        """The boxes' landmarks in the order in which they were given."""
        return np.sort(np.concatenate([self.parts[b] for b in boxes]))

    def nearest(self, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, names, distances): each row's k nearest landmarks of another name, the first given of equal distances."""
        if not len(self.at) or k < 1:
            return
        for some, least, _ in self.together(x):
            by_distance = np.argsort(least, kind="stable")
            enough = int(np.searchsorted(np.cumsum(self.sizes[by_distance]), k + 1)) + 1
            boxes, q = by_distance[:enough], x[some]
            points, d = self._others(ids[some], q, boxes)
            m = min(k, len(points))
            kth = np.partition(d, m - 1, 1)[:, m - 1].max()
            reach = np.flatnonzero(least <= kth * kth * (1 + 1e-9))
            more = np.setdiff1d(reach, boxes)
            if len(more):
                further, d2 = self._others(ids[some], q, more)
                points, d = np.concatenate([points, further]), np.concatenate([d, d2], 1)
                order = np.argsort(points)
                points, d = points[order], d[:, order]
                m = min(k, len(points))
            bound = np.partition(d, m - 1, 1)[:, m - 1 : m]
            rows, found = np.nonzero((d <= bound) & np.isfinite(d))
            order = np.lexsort((found, d[rows, found], rows))
            rows, found = rows[order], found[order]
            keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < m
            rows, found = rows[keep], found[keep]
            yield ids[some][rows], self.names[points[found]], d[rows, found]

    def _others(self, ids: np.ndarray, x: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        points = self.points(boxes)
        d = np.sqrt(self.squared(x, points))
        d[ids[:, None] == self.names[None, points]] = np.inf
        return points, d

    def log_kernel_sum(self, x: np.ndarray, bandwidth: float, error: float) -> np.ndarray:
        """ln of the sum of exp(-d^2 / 2 h^2) over the landmarks. The boxes that are left out hold at most `error` of it: their
        greatest possible sums, the smallest first, are held against the sum that all boxes have at least."""
        out = np.full(len(x), np.nan if len(self.at) else -np.inf)
        if not len(self.at):
            return out
        for some, least, most in self.together(x):
            scale = 2 * bandwidth * bandwidth
            up, down = np.log(self.sizes) - least / scale, np.log(self.sizes) - most / scale
            sure = down.max() + np.log(np.exp(down - down.max()).sum())
            rising = np.argsort(up)
            # a part that overflows is far above what may be left out
            may_go = np.cumsum(np.exp(np.minimum(up[rising] - sure, 50.0))) <= error
            e = -self.squared(x[some], self.points(rising[~may_go])) / scale
            top = e.max(1)
            out[some] = top + np.log(np.exp(e - top[:, None]).sum(1))
        return out
