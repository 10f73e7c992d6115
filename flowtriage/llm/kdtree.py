"""K-d trees over vectors of whole numbers, searched by L1 distance for many queries at once."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
from pyspark import cloudpickle

#: Beyond all values.
FAR = 1 << 40


class KdTree:
    """Points split at the median of their widest dimension, down to leaves of `leaf` points or of equal points.

    A node knows its dimension, the bounds of its region there, the largest value of its left and the smallest value of
    its right part. With `tight` these values are those of the points, so that all points, and no others, are inside;
    without, the regions cover all of space, for points that are not known yet.
    """

    def __init__(self, points: np.ndarray, leaf: int, tight: bool):
        self.order = np.arange(len(points))
        self.dim, self.low, self.high, self.left_top, self.right_bottom, self.child, self.span = [], [], [], [], [], [], []
        low, high = (points.min(axis=0), points.max(axis=0)) if tight and len(points) else (
            np.full(points.shape[1], -FAR), np.full(points.shape[1], FAR))
        self.box, self.leaves = (low.astype(np.int64), high.astype(np.int64)), 0
        waiting = [(0, len(points), *self.box, None)]
        while waiting:
            begin, end, low, high, parent = waiting.pop()
            if parent is not None:
                self.child[parent[0]][parent[1]] = len(self.dim)
            own = points[self.order[begin:end]]
            spread = own.max(axis=0) - own.min(axis=0) if end - begin > leaf else np.zeros(1, np.int64)
            node = len(self.dim)
            self.child.append([-1, -1])
            if not spread.any():
                self._add(-1, 0, 0, 0, 0, (begin, end, self.leaves))
                self.leaves += 1
                continue
            # among the widest dimensions the one whose median parts the points most evenly
            best = None
            for d in np.argsort(-spread, kind="stable")[:8]:
                values = own[:, d]
                cut = int(np.median(values))
                for c in (cut, cut - 1):
                    left = int((values <= c).sum())
                    if 0 < left < len(values) and (best is None or abs(2 * left - len(values)) < best[0]):
                        best = (abs(2 * left - len(values)), int(d), c)
            _, d, cut = best
            goes = own[:, d] <= cut
            top, bottom = (int(own[goes, d].max()), int(own[~goes, d].min())) if tight else (cut, cut + 1)
            self.order[begin:end] = np.concatenate([self.order[begin:end][goes], self.order[begin:end][~goes]])
            middle = begin + int(goes.sum())
            self._add(d, int(low[d]), int(high[d]), top, bottom, (begin, end, -1))
            left_high, right_low = high.copy(), low.copy()
            left_high[d], right_low[d] = top, bottom
            waiting.append((middle, end, right_low, high, (node, 1)))
            waiting.append((begin, middle, low, left_high, (node, 0)))

    def _add(self, *values) -> None:
        for name, value in zip(("dim", "low", "high", "left_top", "right_bottom", "span"), values):
            getattr(self, name).append(value)

    def near(self, queries: np.ndarray, radius: np.ndarray) -> Iterator[tuple[np.ndarray, tuple[int, int, int]]]:
        """For each leaf the queries whose distance to its region is within their radius, and its (start, end, number)."""
        low, high = self.box
        far = np.maximum(low - queries, 0).sum(axis=1) + np.maximum(queries - high, 0).sum(axis=1)
        waiting = [(0, np.flatnonzero(far <= radius), far[far <= radius])]
        while waiting:
            node, who, far = waiting.pop()
            if not len(who):
                continue
            d = self.dim[node]
            if d < 0:
                yield who, self.span[node]
                continue
            q = queries[who, d].astype(np.int64)
            # what the narrower region of a part adds to the distance along this dimension
            left = far + np.maximum(q - self.left_top[node], 0) - np.maximum(q - self.high[node], 0)
            right = far + np.maximum(self.right_bottom[node] - q, 0) - np.maximum(self.low[node] - q, 0)
            for part, at in ((left, 0), (right, 1)):
                stays = part <= radius[who]
                waiting.append((self.child[node][at], who[stays], part[stays]))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
