"""A point-region quadtree fitted to a bounded sample; its leaves are the partitions of a spatial join."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MAX_DEPTH = 24


@dataclass(frozen=True)
class QuadTree:
    """Nodes as arrays: child index of each quarter (-1 in a leaf), box, and leaf number (-1 inside).

    A leaf is a half-open box [x0, x1) x [y0, y1) that also owns the domain's upper border, so every point
    of the domain lies in exactly one leaf.
    """

    boxes: np.ndarray  # (nodes, 4) x0, y0, x1, y1
    children: np.ndarray  # (nodes, 4)
    leaf: np.ndarray  # (nodes,)
    leaf_boxes: np.ndarray  # (leaves, 4)

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, capacity: int, domain: tuple[float, float, float, float], max_depth: int = MAX_DEPTH) -> QuadTree:
        """Split every box that holds more than ``capacity`` sample points, down to ``max_depth``."""
        boxes, children, leaf, leaf_boxes = [domain], [[-1] * 4], [-1], []
        todo = [(0, np.arange(len(x)), 0)]
        while todo:
            node, own, depth = todo.pop()
            x0, y0, x1, y1 = boxes[node]
            one_spot = len(own) > 0 and np.ptp(x[own]) == 0 and np.ptp(y[own]) == 0
            if len(own) <= capacity or depth == max_depth or one_spot:
                leaf[node] = len(leaf_boxes)
                leaf_boxes.append(boxes[node])
                continue
            xm, ym = (x0 + x1) / 2, (y0 + y1) / 2
            right, up = x[own] >= xm, y[own] >= ym
            for quarter, box in enumerate(((x0, y0, xm, ym), (xm, y0, x1, ym), (x0, ym, xm, y1), (xm, ym, x1, y1))):
                child = len(boxes)
                children[node][quarter] = child
                boxes.append(box)
                children.append([-1] * 4)
                leaf.append(-1)
                todo.append((child, own[(right == bool(quarter & 1)) & (up == bool(quarter & 2))], depth + 1))
        return QuadTree(np.array(boxes), np.array(children), np.array(leaf), np.array(leaf_boxes))

    def locate(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        node = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = self.leaf[node] < 0
            if not inner.any():
                return self.leaf[node]
            at = node[inner]
            b = self.boxes[at]
            quarter = (x[inner] >= (b[:, 0] + b[:, 2]) / 2) + 2 * (y[inner] >= (b[:, 1] + b[:, 3]) / 2)
            node[inner] = self.children[at, quarter]

    def overlapping(self, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(box index, leaf) of every leaf that a closed box touches: the replication list."""
        item = np.arange(len(boxes))
        node = np.zeros(len(boxes), dtype=np.int64)
        items, leaves = [], []
        while len(item):
            b, n = boxes[item], self.boxes[node]
            hit = (b[:, 0] <= n[:, 2]) & (b[:, 2] >= n[:, 0]) & (b[:, 1] <= n[:, 3]) & (b[:, 3] >= n[:, 1])
            item, node = item[hit], node[hit]
            done = self.leaf[node] >= 0
            items.append(item[done])
            leaves.append(self.leaf[node[done]])
            item, node = np.repeat(item[~done], 4), self.children[node[~done]].ravel()
        return np.concatenate([*items, np.empty(0, np.int64)]), np.concatenate([*leaves, np.empty(0, np.int64)])
