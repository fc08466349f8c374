"""Words of many texts at once as places and 64-bit hashes, and hashes of runs of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Odd bases of the running sums; a byte counts as a fixed random number.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_BYTES = np.random.default_rng(13).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64."""
    if base not in _tables or len(_tables[base][0]) < n:
        up, down = np.full(n + (n >> 1), base, np.uint64), np.full(n + (n >> 1), pow(base, -1, 1 << 64), np.uint64)
        up[:1] = down[:1] = 1
        _tables[base] = np.cumprod(up), np.cumprod(down)
    up, down = _tables[base]
    return up[:n], down[:n]


class Sums:
    """Running sums of values times falling powers: the hash of any stretch, wherever it stands."""

    def __init__(self, values: np.ndarray, base: int):
        self.up, down = _powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * down[:-1], out=self.sums[1:])

    def of(self, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        h = (self.sums[stop] - self.sums[begin]) * self.up[begin]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


class Words:
    """The words between white space of an Arrow array of texts.

    ``data[begin[i]:stop[i]]`` are the bytes of word i, ``row[i]`` its text; ``first`` has the number of
    the first word of each text and, at the end, of all words.
    """

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        gap = np.ones(len(self.data) + 2, bool)
        gap[1:-1] = _SPACE[self.data]
        inside = ~gap[1:-1]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[offsets] = True
        self.begin = np.flatnonzero(inside & (gap[:-2] | edge[:-1]))
        self.stop = np.flatnonzero(inside & (gap[2:] | edge[1:])) + 1
        self.first = np.searchsorted(self.begin, offsets)
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        return Sums(_BYTES[self.data], _BASES[0]).of(self.begin, self.stop)


class Runs:
    """Two independent hashes of any run of words."""

    def __init__(self, hashes: np.ndarray):
        self.sums = Sums(hashes, _BASES[1]), Sums(hashes ^ (hashes >> np.uint64(31)) * np.uint64(_BASES[0]), _BASES[2])

    def of(self, begin: np.ndarray, stop: np.ndarray, which: int) -> np.ndarray:
        return self.sums[which].of(begin, stop)


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Lowest of each ``width`` neighbours."""
    held, have = values, 1
    while 2 * have <= width:
        held, have = np.minimum(held[: len(held) - have], held[have:]), 2 * have
    rest = width - have
    return np.minimum(held[: len(held) - rest], held[rest:]) if rest else held
