"""A bulk-loaded R-tree over boxes that answers many point probes at once."""

from __future__ import annotations

import numpy as np

FAN_OUT = 16
PROBES = 8192


class RTree:
    """Sort-tile-recursive packing: items in x-slices, each slice sorted by y, runs of ``FAN_OUT`` a node."""

    def __init__(self, boxes: np.ndarray) -> None:
        self.size = len(boxes)
        order = np.arange(self.size)
        if self.size:
            cx, cy = boxes[:, 0] + boxes[:, 2], boxes[:, 1] + boxes[:, 3]
            slices = max(1, int(np.ceil(np.sqrt(np.ceil(self.size / FAN_OUT)))))
            per_slice = int(np.ceil(self.size / slices))
            by_x = np.argsort(cx, kind="stable")
            rank = np.empty(self.size, dtype=np.int64)
            rank[by_x] = np.arange(self.size) // per_slice
            order = np.lexsort((cy, rank))
        self.order = order
        self.levels = [boxes[order]]
        while len(self.levels[-1]) > FAN_OUT:
            below = self.levels[-1]
            starts = np.arange(0, len(below), FAN_OUT)
            low = np.minimum.reduceat(below[:, :2], starts, axis=0)
            high = np.maximum.reduceat(below[:, 2:], starts, axis=0)
            self.levels.append(np.hstack([low, high]))

    def probe(self, x: np.ndarray, y: np.ndarray):
        """Yield (point index, item index) arrays of the items whose box holds a point, block by block."""
        if not self.size:
            return
        for at in range(0, len(x), PROBES):
            stop = min(at + PROBES, len(x))
            top = self.levels[-1]
            point = np.repeat(np.arange(at, stop), len(top))
            node = np.tile(np.arange(len(top)), stop - at)
            for depth in range(len(self.levels) - 1, -1, -1):
                b, px, py = self.levels[depth][node], x[point], y[point]
                hit = (b[:, 0] <= px) & (px <= b[:, 2]) & (b[:, 1] <= py) & (py <= b[:, 3])
                point, node = point[hit], node[hit]
                if depth:
                    point = np.repeat(point, FAN_OUT)
                    node = (node[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
                    inside = node < len(self.levels[depth - 1])
                    point, node = point[inside], node[inside]
            yield point, self.order[node]
