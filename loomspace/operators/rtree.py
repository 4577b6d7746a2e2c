"""Bulk-loaded R-tree over rectangles, probed in NumPy batches. It lives inside one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FANOUT = 16


class PackedRTree:
    """Sort-tile-recursive packing: sort by x into slices, by y within a slice, and pack runs of ``FANOUT``."""

    def __init__(self, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray):
        box = np.stack([x1, y1, x2, y2], axis=1).astype(np.float64)
        n = len(box)
        slices = max(1, int(np.ceil(np.sqrt(n / FANOUT))))
        by_x = np.argsort(box[:, 0] + box[:, 2], kind="stable")
        piece = np.empty(n, np.int64)
        piece[by_x] = np.arange(n) // max(1, -(-n // slices))
        self.order = np.lexsort((box[:, 1] + box[:, 3], piece))
        self.levels = [box[self.order]]
        while len(self.levels[-1]) > FANOUT:
            low = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append(np.concatenate([np.minimum.reduceat(low[:, :2], at), np.maximum.reduceat(low[:, 2:], at)], axis=1))

    def probe(self, qx1: np.ndarray, qy1: np.ndarray, qx2: np.ndarray, qy2: np.ndarray, batch: int = 2048, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, rectangle) whose closed rectangles touch, in batches of bounded size."""
        stack = [(i, min(i + batch, len(qx1))) for i in range(0, len(qx1), batch)][::-1]
        while stack:
            lo, hi = stack.pop()
            top = self.levels[-1]
            q = np.repeat(np.arange(lo, hi), len(top))
            node = np.tile(np.arange(len(top)), hi - lo)
            for level in range(len(self.levels) - 1, -1, -1):
                b = self.levels[level]
                ok = (b[node, 0] <= qx2[q]) & (b[node, 2] >= qx1[q]) & (b[node, 1] <= qy2[q]) & (b[node, 3] >= qy1[q])
                q, node = q[ok], node[ok]
                if not level:
                    break
                if len(q) * FANOUT > most and hi - lo > 1:  # too many at once: halve the batch
                    stack += [((lo + hi) // 2, hi), (lo, (lo + hi) // 2)]
                    q = q[:0]
                    break
                q = np.repeat(q, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                inside = node < len(self.levels[level - 1])
                q, node = q[inside], node[inside]
            if len(q):
                yield q, self.order[node]
