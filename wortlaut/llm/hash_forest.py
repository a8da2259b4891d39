"""A forest of sorted hash strings over a block of vectors."""

from __future__ import annotations

import numpy as np


class HashFamily:
    """Random planes, and for every tree the planes whose sides make up its hash string.

    All blocks use the same family, so a prefix means the same everywhere.  A tree takes ``bits`` planes of a pool at
    random: two vectors at angle a agree in the first x bits of a tree with probability (1 - a / pi) ** x.
    """

    def __init__(self, dim: int, trees: int, bits: int, pool: int, seed: int):
        if not 1 <= bits <= min(63, pool):
            raise ValueError("1 to 63 bits, not more than planes in the pool")
        rng = np.random.default_rng((seed, dim))
        self.dim, self.trees, self.bits = dim, trees, bits
        self.planes = rng.standard_normal((dim + 1, pool))
        self.picks = [rng.choice(pool, bits, replace=False) for _ in range(trees)]

    def strings(self, vectors: np.ndarray, lift: np.ndarray | None = None) -> np.ndarray:
        """One hash string per tree and vector.  ``lift`` is a further component, which queries do not have."""
        sides = vectors @ self.planes[: self.dim]
        if lift is not None:
            sides += np.outer(lift, self.planes[self.dim])
        above = sides > 0
        found = np.zeros((self.trees, len(vectors), 8), np.uint8)
        for tree, pick in enumerate(self.picks):
            packed = np.packbits(above[:, pick], axis=1)
            found[tree, :, : packed.shape[1]] = packed
        return found.view(">u8")[..., 0].astype(np.uint64) >> np.uint64(64 - self.bits)


class HashForest:
    """Per tree the hash strings of a block's vectors, sorted; a prefix of any length is a range of such an array.

    Nearness is the inner product: vectors are divided by the length of the longest and lifted by one component to
    length 1, which leaves the order of inner products with a query as the order of angles.
    """

    def __init__(self, vectors: np.ndarray, family: HashFamily):
        lengths = np.linalg.norm(vectors, axis=1)
        self.vectors, self.family, self.longest = vectors, family, lengths.max()
        lift = np.sqrt(np.maximum(0.0, 1.0 - (lengths / self.longest) ** 2))
        strings = family.strings(vectors / self.longest, lift)
        self.order = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(strings, self.order, axis=1)

    def _ranges(self, tree: int, strings: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the vectors lie that agree with each string in its first ``level`` bits."""
        rest = (self.family.bits - level).astype(np.uint64)
        first = (strings >> rest) << rest
        array = self.sorted[tree]
        return np.searchsorted(array, first), np.searchsorted(array, first + (np.uint64(1) << rest))

    def _reached(self, strings: np.ndarray, levels: np.ndarray) -> np.ndarray:
        """Marks, per query, the vectors that agree with it up to ``levels`` (tree, query) in any tree."""
        marks = np.zeros((strings.shape[1], len(self.vectors)), bool)
        queries = np.arange(strings.shape[1])
        for tree in range(self.family.trees):
            start, stop = self._ranges(tree, strings[tree], levels[tree])
            size = stop - start
            skipped = np.cumsum(size) - size
            places = np.arange(size.sum()) + np.repeat(start - skipped, size)
            marks[np.repeat(queries, size), self.order[tree][places]] = True
        return marks

    def descend(self, strings: np.ndarray, least: int, distinct: int) -> np.ndarray:
        """Candidates at the longest matching prefixes: all trees ascend together, a level at a time, until they show
        ``least`` entries and ``distinct`` different vectors (or everything)."""
        trees, count = strings.shape
        low, high = np.zeros(count, np.int64), np.full(count, self.family.bits + 1)
        while (high - low > 1).any():  # the entries only grow on the way up, so the level is found by halving
            middle = (low + high) // 2
            entries = np.zeros(count, np.int64)
            for tree in range(trees):
                start, stop = self._ranges(tree, strings[tree], middle)
                entries += stop - start
            enough = entries >= least
            low, high = np.where(enough, middle, low), np.where(enough, high, middle)
        marks = self._reached(strings, np.broadcast_to(low, (trees, count)))
        while (few := np.flatnonzero((marks.sum(axis=1) < distinct) & (low > 0))).size:
            low[few] -= 1
            marks[few] = self._reached(strings[:, few], np.broadcast_to(low[few], (trees, few.size)))
        return marks

    def ascend(self, strings: np.ndarray, lengths: np.ndarray, floor: np.ndarray, confidence: float) -> np.ndarray:
        """Candidates such that a vector with an inner product of ``floor`` is among them with that confidence.

        The angle that belongs to the floor gives the chance that one tree agrees in x bits, hence the chance that all
        trees miss at this level.  The trees ascend together to the lowest level that misses rarely enough, some of
        them, tree by tree, one level less.  Without a floor (NaN) everything is a candidate.
        """
        trees, bits = self.family.trees, self.family.bits
        cosine = np.clip(floor / (lengths * self.longest), -1.0, 1.0)
        same_side = 1.0 - np.arccos(np.where(np.isnan(cosine), -1.0, cosine)) / np.pi
        missed = np.log1p(-np.minimum(same_side[:, None] ** np.arange(bits + 2), 1 - 1e-12))  # of one tree, per level
        allowed = np.log(1.0 - confidence)
        level = np.maximum(((trees * missed <= allowed).cumprod(axis=1)).sum(axis=1) - 1, 0)
        level = np.where(np.isnan(cosine), 0, np.minimum(level, bits))
        queries = np.arange(len(level))
        here, deeper = missed[queries, level], missed[queries, level + 1]
        part = (allowed - trees * deeper) / np.minimum(here - deeper, -1e-15)  # trees that must be at this level
        at_level = np.where(np.isnan(cosine), trees, np.ceil(np.clip(part, 0, trees)))
        levels = np.minimum(level + (np.arange(trees)[:, None] >= at_level), bits)
        return self._reached(strings, levels)
