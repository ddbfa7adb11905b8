"""A small-world graph over document sketches, built and searched in vectorised blocks.

Two layers. The upper one holds the pivots, a seeded random sample of about PIVOTS * sqrt(n) nodes; a node hangs
on its HOMES nearest pivots, by short vectors of votes, and the nodes of a pivot lie side by side in memory (its
cell). The lower layer links each node with its nearest nodes, by sketches of many bits, and with a few random
ones, which make the graph navigable from anywhere.

A search compares the query with all pivots in one matrix product, opens the cells of the nearest ``beam`` ones, and
walks on from the nearest nodes met there over the links of the lower layer until no nearer node turns up. Everything
met whose sketch differs in at most ``radius`` bits is a candidate. Cells are opened for many queries at once, so
that most comparisons run over contiguous memory. The beam is widened until a search finds what an exhaustive
one finds.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

NEAR = 8  # near links of a node
RANDOM = 2  # random links of a node
PIVOTS = 8
LEAST_PIVOTS = 64
HOMES = 2
#: Cells of so many times the mean size have the ties of their nodes drawn by lot.
CROWD = 16
BLOCK = 2048
#: Nodes from which a walk goes on at the same time.
WALK = 4
#: Comparisons done at once, which bounds the memory of a search.
AT_ONCE = 4_000_000
#: Beams tried by tuning grow by these steps to the number of pivots.
FIRST_BEAM, GROWTH = 4, 1.5


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of sketches along the last axis."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.uint16)


def hamming_table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(len(a), len(b)) differing bits of each sketch of ``a`` with each of ``b``, word by word."""
    total = np.zeros((len(a), len(b)), dtype=np.uint16)
    for word in range(a.shape[1]):
        total += np.bitwise_count(a[:, word, None] ^ b[None, :, word])
    return total


def pivot_count(n: int) -> int:
    return min(n, max(LEAST_PIVOTS, int(PIVOTS * np.sqrt(n))))


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` greatest scores of each row, in no order."""
    return np.argpartition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k :] if k < scores.shape[1] else np.broadcast_to(np.arange(scores.shape[1]), scores.shape)


@dataclass
class Graph:
    vectors: np.ndarray  # (pivots, dims) float32, unit length
    sketches: np.ndarray  # (n, words) uint64
    links: np.ndarray  # (n, NEAR + RANDOM) int32, -1 where none
    starts: np.ndarray  # (pivots + 1,) where the cells begin in ``members``
    members: np.ndarray  # nodes by cell
    beam: int = FIRST_BEAM

    def __post_init__(self) -> None:
        self.cells = np.ascontiguousarray(self.sketches[self.members])

    @staticmethod
    def build(vectors: np.ndarray, sketches: np.ndarray, seed: int = 7) -> Graph:
        """The graph of unit ``vectors`` (n, dims) and ``sketches`` (n, words)."""
        n = len(vectors)
        rng = np.random.default_rng(seed)
        pivots = np.sort(rng.permutation(n)[: pivot_count(n)])
        homes = min(HOMES, len(pivots))
        home = np.concatenate([_best(vectors[at : at + BLOCK] @ vectors[pivots].T, homes) for at in range(0, n, BLOCK)])
        # Of many equal vectors, equally near to many pivots, all would hang on the same ones: their ties are drawn by lot.
        crowd = np.flatnonzero((np.bincount(home.ravel(), minlength=len(pivots)) * len(pivots) > CROWD * homes * n)[home].any(axis=1))
        for at in range(0, len(crowd), BLOCK):
            own = crowd[at : at + BLOCK]
            home[own] = _best(vectors[own] @ vectors[pivots].T + rng.random((len(own), len(pivots)), dtype=np.float32) * 1e-4, homes)
        home = home.ravel()
        order = np.argsort(home, kind="stable")
        starts = np.searchsorted(home[order], np.arange(len(pivots) + 1))
        g = Graph(vectors[pivots], sketches, np.full((n, NEAR + RANDOM), -1, np.int32), starts, (order // homes).astype(np.int32))
        g._link_cells()
        g.links[:, NEAR:] = rng.integers(0, n, size=(n, RANDOM))
        return g

    def _link_cells(self) -> None:
        """Link each node with the nearest ones of its cells."""
        own, other, gap = [], [], []
        step = int(np.sqrt(AT_ONCE))
        for cell in range(len(self.starts) - 1):
            lo, hi = self.starts[cell], self.starts[cell + 1]
            for at in range(lo, hi, step):
                stop = min(hi, at + step)
                best_other, best_gap = np.empty((stop - at, 0), np.int32), np.empty((stop - at, 0), np.uint16)
                for to in range(lo, hi, step):  # the nearest of the cell, block by block
                    end = min(hi, to + step)
                    d = hamming_table(self.cells[at:stop], self.cells[to:end])
                    both = np.hstack([best_gap, d])
                    nodes = np.hstack([best_other, np.broadcast_to(self.members[to:end], d.shape)])
                    k = min(NEAR + 1, both.shape[1])
                    near = np.argpartition(both, k - 1, axis=1)[:, :k]
                    best_gap, best_other = np.take_along_axis(both, near, 1), np.take_along_axis(nodes, near, 1)
                own.append(np.repeat(self.members[at:stop], best_gap.shape[1]))
                other.append(best_other.ravel())
                gap.append(best_gap.ravel())
        own, other, gap = np.concatenate(own), np.concatenate(other), np.concatenate(gap)
        keep = own != other
        own, other, gap = own[keep], other[keep], gap[keep]
        by = np.lexsort((other, gap, own))
        own, other = own[by], other[by]
        fresh = np.ones(len(own), dtype=bool)  # a pair of nodes that share both cells was met twice, side by side
        fresh[1:] = (own[1:] != own[:-1]) | (other[1:] != other[:-1])
        own, other = own[fresh], other[fresh]
        rank = np.arange(len(own)) - np.searchsorted(own, np.arange(len(self.sketches)))[own]
        keep = rank < NEAR
        self.links[own[keep], rank[keep]] = other[keep]

    def _open_cells(self, sketches: np.ndarray, pivots: np.ndarray, radius: int):
        """(query, node) met within ``radius``, and of each query the WALK nearest nodes of the cells opened."""
        q, width = pivots.shape
        asker = np.repeat(np.arange(q), width)
        by = np.argsort(pivots.ravel(), kind="stable")
        asker, bounds = asker[by], np.searchsorted(pivots.ravel()[by], np.arange(len(self.starts)))
        met_query, met_node = [], []
        nearest = np.full(q * width, np.iinfo(np.int64).max)  # of each opened cell: gap << 32 | node
        for cell in np.flatnonzero(bounds[1:] > bounds[:-1]):
            lo, hi = self.starts[cell], self.starts[cell + 1]
            if lo == hi:
                continue
            step = max(1, AT_ONCE // (hi - lo))
            for at in range(bounds[cell], bounds[cell + 1], step):
                who = asker[at : min(at + step, bounds[cell + 1])]
                d = hamming_table(sketches[who], self.cells[lo:hi])
                row, column = np.nonzero(d <= radius)
                if len(row):
                    met_query.append(who[row])
                    met_node.append(self.members[lo + column])
                best = d.argmin(axis=1)
                nearest[at : at + len(who)] = (d[np.arange(len(who)), best].astype(np.int64) << 32) | self.members[lo + best]
        table = np.empty(q * width, np.int64)
        table[by] = nearest
        table = np.sort(table.reshape(q, width), axis=1)
        return met_query, met_node, table

    def _walk(self, sketches: np.ndarray, table: np.ndarray, radius: int):
        """Candidates met by walking from the nearest nodes over links, as long as a nearer node turns up."""
        met_query, met_node = [], []
        none = np.iinfo(np.int64).max
        beam = np.full((len(sketches), WALK), none)
        for slot in range(WALK):  # the nearest different nodes of the cells
            column = np.argmax(table > (beam[:, slot - 1, None] if slot else -1), axis=1)
            value = table[np.arange(len(table)), column]
            beam[:, slot] = np.where(value > (beam[:, slot - 1] if slot else -1), value, none)
        live = np.arange(len(sketches))
        new = beam.copy()
        while len(live):
            row, slot = np.nonzero(new != none)
            to = self.links[new[row, slot] & 0xFFFFFFFF]
            asker, node = np.repeat(live[row], to.shape[1]), to.ravel()
            asker, node = asker[node >= 0], node[node >= 0]
            gap = hamming(sketches[asker], self.sketches[node])
            hit = gap <= radius
            met_query.append(asker[hit])
            met_node.append(node[hit])
            key = (gap.astype(np.int64) << 32) | node
            closer = key < beam[asker, -1]
            asker, key = asker[closer], key[closer]
            if not len(asker):
                break
            by = np.lexsort((key, asker))
            asker, key = asker[by], key[by]
            fresh = np.ones(len(asker), dtype=bool)
            fresh[1:] = (asker[1:] != asker[:-1]) | (key[1:] != key[:-1])
            asker, key = asker[fresh], key[fresh]
            live, first = np.unique(asker, return_index=True)
            rank = np.arange(len(asker)) - np.repeat(first, np.diff([*first, len(asker)]))
            keep = rank < WALK
            added = np.full((len(live), WALK), none)
            added[np.searchsorted(live, asker[keep]), rank[keep]] = key[keep]
            known = (added[:, :, None] == beam[live][:, None, :]).any(axis=2)
            added[known] = none
            merged = np.sort(np.hstack([beam[live], added]), axis=1)[:, :WALK]
            beam[live] = merged
            added[added > merged[:, -1:]] = none  # only what entered the beam goes on
            going = (added != none).any(axis=1)
            live, new = live[going], added[going]
        return met_query, met_node

    def search(self, vectors: np.ndarray, sketches: np.ndarray, radius: int, beam: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs met whose sketches differ in at most ``radius`` bits, none twice.

        A query that met more such nodes than half the nodes of its cells may be in the middle of a crowd; it is
        searched again with twice the beam until that no longer holds or all cells are open: no number of partners
        is too large.
        """
        n, pivots = len(self.sketches), len(self.starts) - 1
        beam = min(beam or self.beam, pivots)
        sizes = np.diff(self.starts)
        asked, found, opened = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at in range(0, len(vectors), BLOCK):
            own = sketches[at : at + BLOCK]
            near = _best(vectors[at : at + BLOCK] @ self.vectors.T, beam)
            query, node, table = self._open_cells(own, near, radius)
            walked_query, walked_node = self._walk(own, table, radius)
            asked += [q + at for q in query + walked_query]
            found += node + walked_node
            opened.append(sizes[near].sum(axis=1))
        pairs = np.unique(np.concatenate(asked) * n + np.concatenate(found))
        a, b = pairs // n, pairs % n
        crowded = np.flatnonzero(np.bincount(a, minlength=len(vectors)) * 2 * HOMES > np.concatenate(opened))
        if len(crowded) and beam < pivots:
            more_a, more_b = self.search(vectors[crowded], sketches[crowded], radius, beam * 2)
            pairs = np.union1d(pairs, crowded[more_a] * n + more_b)
            a, b = pairs // n, pairs % n
        return a, b

    def tune(self, probes: tuple[np.ndarray, np.ndarray], radius: int, goal: float = 0.99) -> float:
        """Widen ``beam`` until searches find ``goal`` of what exhaustive search finds within ``radius``.

        Where no narrower beam does, all cells are opened. Returns the recall reached.
        """
        vectors, sketches = probes
        query, node = np.nonzero(hamming_table(sketches, self.sketches) <= radius)
        truth = query * len(self.sketches) + node
        pivots, recall, beam = len(self.starts) - 1, 1.0, FIRST_BEAM
        while True:
            self.beam = min(int(beam), pivots)
            got = self.search(vectors, sketches, radius)
            recall = np.isin(truth, got[0] * len(self.sketches) + got[1]).mean() if len(truth) else 1.0
            if recall >= goal or self.beam == pivots:
                return float(recall)
            beam *= GROWTH

    def to_bytes(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, vectors=self.vectors, sketches=self.sketches, links=self.links, starts=self.starts, members=self.members, beam=self.beam)
        return held.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Graph:
        with np.load(io.BytesIO(data)) as z:
            return Graph(z["vectors"], z["sketches"], z["links"], z["starts"], z["members"], int(z["beam"]))
