"""The best rows of many groups, kept while rows stream by."""

from __future__ import annotations

import numpy as np


class Best:
    """The ``k`` best (score, id) of each group: higher scores first, equal ones by the lower id.

    ``floor`` stands for missing rows and is below every score that is added. With ``distinct`` a row that
    comes again with its score and id counts once.
    """

    def __init__(self, groups: int, k: int, floor: int, distinct: bool = False):
        self.k, self.floor, self.distinct = k, floor, distinct
        self.scores = np.full((groups, k), floor, np.int64)
        self.ids = np.zeros((groups, k), np.int64)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        touched = np.unique(group)
        group = np.concatenate([np.repeat(touched, self.k), group])
        score = np.concatenate([self.scores[touched].ravel(), score])
        ids = np.concatenate([self.ids[touched].ravel(), ids])
        by = np.lexsort((ids, ~score, group))
        group, score, ids = group[by], score[by], ids[by]
        if self.distinct:
            new = np.ones(len(group), bool)
            new[1:] = (group[1:] != group[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1]) | (score[1:] == self.floor)
            group, score, ids = group[new], score[new], ids[new]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        first = place < self.k
        self.scores[group[first], place[first]] = score[first]
        self.ids[group[first], place[first]] = ids[first]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, score, id) of all rows that are held."""
        group, place = np.nonzero(self.scores > self.floor)
        return group, self.scores[group, place], self.ids[group, place]
