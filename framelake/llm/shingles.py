"""Word shingles, their hashes, and binary sketches of shingle sets."""

from __future__ import annotations

import re

import numpy as np
import xxhash

SKETCH_WORDS = 4  # 64-bit words of a sketch
SKETCH_BITS = 64 * SKETCH_WORDS
VECTOR_DIMS = 48

_WORD = re.compile(r"[^\W_]+")
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_S = [np.uint64(x) for x in (30, 27, 31)]


def words(text: str | None) -> list[str]:
    """Runs of letters and digits of the lower-cased text."""
    return _WORD.findall(text.lower()) if text else []


class _WordHashes(dict):
    """Hashes of the words met so far; emptied when it gets large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hash_of = _WordHashes().__getitem__


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S[0])) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _S[1])) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> _S[2])


def shingle_sets(texts: list[str | None], width: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each text the sorted distinct hashes of its word sequences of ``width``, and of its words."""
    found = [words(t) for t in texts]
    ends = np.cumsum([len(f) for f in found])
    h = np.fromiter((_hash_of(w) for f in found for w in f), dtype=np.uint64, count=int(ends[-1]) if len(ends) else 0)
    rolled = np.zeros(max(0, len(h) - width + 1), dtype=np.uint64)
    for i in range(width):  # over all texts at once; sequences across a border are not read below
        rolled = _mix(rolled * _M1 + h[i : len(h) - width + 1 + i] * _M2 + _M3) if len(rolled) else rolled
    grams, singles, start = [], [], 0
    for end in ends.tolist():
        singles.append(np.unique(h[start:end]))
        grams.append(np.unique(rolled[start : end - width + 1]) if end - start >= width else np.empty(0, np.uint64))
        start = end
    return grams, singles


_SEEDS = np.arange(1, SKETCH_WORDS + 1, dtype=np.uint64) * _M1


def _bit_counts(rows: np.ndarray) -> np.ndarray:
    """How many rows of bytes have each bit set; summed in short runs, so that small integers are enough."""
    total = np.zeros(rows.shape[1] * 8, dtype=np.int64)
    for at in range(0, len(rows), 65_535):
        total += np.unpackbits(rows[at : at + 65_535], axis=1).sum(axis=0, dtype=np.uint16)
    return total


def sketches(grams: list[np.ndarray], singles: list[np.ndarray], dims: int = VECTOR_DIMS) -> tuple[np.ndarray, np.ndarray]:
    """Of each text a unit vector (rows, dims) float32 and a sign sketch (rows, SKETCH_WORDS) uint64.

    Both come from the votes of the text's shingles and words on random directions: the sketch has the sign
    of each vote, so two texts whose sets have the cosine c differ in an expected share acos(c)/pi of the
    bits; the vector has the first votes themselves. An empty text has zeros.
    """
    rows = len(grams)
    bits_out = np.zeros((rows, SKETCH_WORDS), dtype=np.uint64)
    vectors = np.zeros((rows, dims), dtype=np.float32)
    for row in range(rows):
        own = np.concatenate([grams[row], singles[row]])
        if not len(own):
            continue
        directions = _mix(own[:, None] + _SEEDS)
        votes = _bit_counts(directions.view(np.uint8)) - len(own) / 2
        bits_out[row] = np.packbits(votes > 0).view(np.uint64)
        length = np.linalg.norm(votes[:dims])
        vectors[row] = votes[:dims] / length if length else 0
    return vectors, bits_out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted distinct hash arrays; 0 where either is empty."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)
