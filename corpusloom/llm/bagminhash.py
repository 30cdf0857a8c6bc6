"""BagMinHash signatures of weighted word sets (unbiased for weighted Jaccard similarity).

Every (word, component) pair owns a Poisson process over time and weight. The weight axis is cut into ``2**DEPTH``
equal levels. The first point of the whole axis comes at an exponential time of rate 1; going down the tree of
dyadic weight intervals, one fair bit says which half holds that point, and the other half's first point comes an
exponential time of its own rate later (the process has no memory). Thus every word of weight ``w`` reads the first
point below ``w`` off at most ``DEPTH`` nodes, and equal words with different weights stay consistent: a component
agrees for two texts with probability sum(min weights) / sum(max weights). A text's component is the earliest point
over its words.

Weights are whole numbers of levels, 1 to ``2**DEPTH``.
"""

from __future__ import annotations

import numpy as np

from .words import mixed

DEPTH = 6
CACHE_WORDS = 40_000
LONG_TEXT = 512


def _uniform(seed: np.ndarray) -> np.ndarray:
    """In (0, 1), from 64 random bits."""
    return ((mixed(seed) >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / 9007199254740992.0)


def first_points(words: np.ndarray, levels: np.ndarray, components: int, first: int = 0) -> np.ndarray:
    """The time of the first point below ``levels`` of each word's processes: words x components, float32; ``first`` is
    the number of the first component."""
    n = len(words)
    seed = mixed(words[:, None] + np.arange(first + 1, first + components + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
    at = -np.log(_uniform(seed))  # of the whole axis, rate 1
    if (levels >= 1 << DEPTH).all():
        return at.astype(np.float32)
    best = np.full((n, components), np.inf)
    best[levels >= 1 << DEPTH] = at[levels >= 1 << DEPTH]
    path = np.zeros(n, np.int64)  # the level where the current node begins
    for depth in range(1, DEPTH + 1):
        half = (1 << DEPTH) >> depth
        step = mixed(seed ^ (path[:, None].astype(np.uint64) * np.uint64(64) + np.uint64(depth)) * np.uint64(0xC2B2AE3D27D4EB4F))
        low = (step & np.uint64(1)).astype(bool)  # the point lies in the lower half
        later = at - np.log(_uniform(step)) / (half / (1 << DEPTH))
        lower, upper = np.where(low, at, later), np.where(low, later, at)
        right = (levels >= path + half) & (levels < 1 << DEPTH)  # the lower half lies wholly below the weight
        best[right] = np.minimum(best[right], lower[right])
        at = np.where(right[:, None], upper, lower)
        path = np.where(right, path + half, path)
    return best.astype(np.float32)


def weighted(words: np.ndarray, levels: np.ndarray | int = 1 << DEPTH) -> np.ndarray:
    """Words (52 bits) and their levels in one uint64 each."""
    return (words << np.uint64(DEPTH + 1)) | np.asarray(levels, np.uint64)


class Signer:
    """Signatures of texts given as weighted words, ``components`` of them from number ``first`` on; holds the processes
    of the words seen last."""

    def __init__(self, components: int, first: int = 0):
        self.components, self.first = components, first
        self.words = np.zeros(0, np.uint64)
        self.points = np.zeros((0, components), np.float32)

    def _learn(self, words: np.ndarray) -> None:
        """``words``: distinct, ascending."""
        new = np.setdiff1d(words, self.words, assume_unique=True)
        if len(new):
            if len(self.words) + len(new) > CACHE_WORDS * 256 // max(256, self.components) and len(self.words):
                self.words, self.points, new = self.words[:0], self.points[:0], words
            low = np.uint64((1 << (DEPTH + 1)) - 1)
            parts = (new[i : i + 512] for i in range(0, len(new), 512))
            points = np.concatenate([self.points, *(first_points(x >> np.uint64(DEPTH + 1), (x & low).astype(np.int64), self.components, self.first) for x in parts)])
            every = np.concatenate([self.words, new])
            order = np.argsort(every)
            self.words, self.points = every[order], points[order]

    def sign(self, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """float32 texts x components as their bits (uint32); texts without words get zeros. Weighted words of a text are distinct."""
        n = len(offsets) - 1
        out = np.zeros((n, self.components), np.uint32)
        for a, b in self._blocks(offsets):
            some = words[offsets[a] : offsets[b]]
            if not len(some):
                continue
            unique, inverse = np.unique(some, return_inverse=True)
            self._learn(unique)
            place = np.searchsorted(self.words, unique)[inverse]
            lengths = np.diff(offsets[a : b + 1])
            for i in np.flatnonzero(lengths > LONG_TEXT).tolist():
                first = offsets[a + i] - offsets[a]
                own = place[first : first + lengths[i]]
                out[a + i] = np.min([self.points[own[j : j + 4096]].min(axis=0) for j in range(0, len(own), 4096)], axis=0).view(np.uint32)
            order = np.argsort(-lengths, kind="stable")
            order = order[(lengths[order] <= LONG_TEXT) & (lengths[order] > 0)]
            for c in range(0, len(order), 512):  # word by word of so many texts at once, the longest first
                some = order[c : c + 512]
                first, much = offsets[a + some] - offsets[a], lengths[some]
                least = self.points[place[first]]
                for k in range(1, int(much[0])):
                    n = int(np.searchsorted(-much, -k, "left"))  # texts with more than k words
                    np.minimum(least[:n], self.points[place[first[:n] + k]], out=least[:n])
                out[a + some] = least.view(np.uint32)
        return out

    @staticmethod
    def _blocks(offsets: np.ndarray) -> list[tuple[int, int]]:
        """Texts in blocks of about 100,000 words."""
        out, a, n = [], 0, len(offsets) - 1
        while a < n:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + 100_000, "right")) - 1)
            out.append((a, b))
            a = b
        return out


def bands(signatures: np.ndarray, rows: int, count: int, first: int = 0) -> np.ndarray:
    """int64 texts x count: a key of ``rows`` components each; keys of different bands differ. ``first`` is the number of
    the first band."""
    out = np.empty((len(signatures), count), np.uint64)
    for i in range(count):
        key = mixed(np.full(len(signatures), first + i + 1, np.uint64))
        for j in range(i * rows, (i + 1) * rows):
            key = mixed(key ^ signatures[:, j])
        out[:, i] = key
    return out.view(np.int64)
