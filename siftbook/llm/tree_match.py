"""Simple tree matching of ordered trees: children are paired in order so that most nodes are paired.

Equal subtrees are told by number, so a pair of subtrees is compared once a page, and equal ones not at all. Rows of
the table are whole arrays. To read the pairs back, some rows are kept and those between them made again, which needs
memory for about the square root of the rows. Of several best pairings the one furthest to the left is taken.
"""

from __future__ import annotations

from math import isqrt

import numpy as np


class Shapes:
    """Numbers of subtrees by label and children, with what was found about pairs of them."""

    def __init__(self):
        self._ids: dict[tuple, int] = {}
        self._label: list[str] = []
        self._below: list[tuple[int, ...]] = []
        self._nodes: list[int] = []
        self._known: dict[tuple[int, int], int] = {}

    def add(self, label: str, below: tuple[int, ...]) -> int:
        found = self._ids.setdefault((label, below), len(self._label))
        if found == len(self._label):
            self._label.append(label)
            self._below.append(below)
            self._nodes.append(1 + sum(self._nodes[b] for b in below))
        return found

    def below(self, shape: int) -> tuple[int, ...]:
        return self._below[shape]

    def weight(self, a: int, b: int) -> int:
        """Nodes paired if two subtrees are, 0 if their labels differ."""
        if a == b:
            return self._nodes[a]
        if self._label[a] != self._label[b]:
            return 0
        key = (a, b)
        if key not in self._known:
            self._known[key] = 1 + self._most(self._below[a], self._below[b])
        return self._known[key]

    def _most(self, ours: tuple[int, ...], theirs: tuple[int, ...]) -> int:
        """Nodes paired of two lists of subtrees; equal ones at both ends belong together in some best pairing."""
        n = min(len(ours), len(theirs))
        head = 0
        while head < n and ours[head] == theirs[head]:
            head += 1
        tail = 0
        while tail < n - head and ours[-1 - tail] == theirs[-1 - tail]:
            tail += 1
        equal = sum(self._nodes[x] for x in ours[:head]) + sum(self._nodes[x] for x in ours[len(ours) - tail :])
        ours, theirs = ours[head : len(ours) - tail], theirs[head : len(theirs) - tail]
        if not ours or not theirs:
            return equal
        if len(ours) == 1 or len(theirs) == 1:
            return equal + max(self.weight(a, b) for a in ours for b in theirs)
        row = np.zeros(len(theirs) + 1, np.int32)
        weights = self._weights(theirs)
        for x in ours:
            row = _next(row, weights(x))
        return equal + int(row[-1])

    def _weights(self, theirs: tuple[int, ...]):
        different, place = np.unique(np.array(theirs), return_inverse=True)
        different = different.tolist()
        return lambda x: np.array([self.weight(x, y) for y in different], np.int32)[place]

    def pairs(self, ours: tuple[int, ...], theirs: tuple[int, ...]) -> dict[int, int]:
        """Place among ``theirs`` of each subtree of ``ours`` that has a partner."""
        head, n = 0, min(len(ours), len(theirs))
        while head < n and ours[head] == theirs[head]:
            head += 1
        found = {i: i for i in range(head)}
        ours, theirs = ours[head:], theirs[head:]
        if not ours or not theirs:
            return found
        weights = self._weights(theirs)
        every = isqrt(len(ours)) + 1
        kept, row = [], np.zeros(len(theirs) + 1, np.int32)
        for i, x in enumerate(ours):
            if i % every == 0:
                kept.append(row)
            row = _next(row, weights(x))
        j = len(theirs)
        for start in range(len(kept) * every - every, -1, -every):
            rows = [kept.pop()]
            for x in ours[start : start + every]:
                rows.append(_next(rows[-1], weights(x)))
            i = len(rows) - 1
            while i and j:
                if rows[i][j] == rows[i - 1][j]:
                    i -= 1
                elif rows[i][j] == rows[i][j - 1]:
                    j = int(np.searchsorted(rows[i][: j + 1], rows[i][j]))
                else:
                    i, j = i - 1, j - 1
                    found[head + start + i] = head + j
        return found


def _next(above: np.ndarray, weights: np.ndarray) -> np.ndarray:
    row = above.copy()
    np.maximum(above[1:], above[:-1] + weights, out=row[1:])
    return np.maximum.accumulate(row)
