"""Words of whole texts as byte strings and as numbers."""

from __future__ import annotations

import numpy as np
import xxhash

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_TERMS = bytes(_LOWER[c] if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def spaced_words(text: str | None) -> list[bytes]:
    """Lower-case A-Z, split at space and ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def term_words(text: str | None) -> list[bytes]:
    """Lower-case A-Z, keep runs of digits, letters and non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERMS).split()


class Hashes(dict):
    """64-bit hashes of words, remembered for frequent words."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 40:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Numbers(dict):
    """Dense numbers from 1 in order of arrival."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))
