"""A compressed full-text index over word numbers: suffix order, wavelet matrix, backward search."""

from __future__ import annotations

import numpy as np

#: Words and ends of an index; three ranks of 21 bits fit one sort key.
INDEX_WORDS = 1 << 20
#: Windows that one query goes through; longer texts are several queries.
LONGEST = 40


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Places of the suffixes in sorted order; every 0 ends a text, and earlier ends sort first."""
    n, ends = len(symbols), symbols == 0
    n_ends = int(ends.sum())
    rank = np.where(ends, np.cumsum(ends), symbols + n_ends)
    ahead = np.concatenate([rank, np.zeros(2, np.int64)])
    keys = (ahead[:n] << 42) | (ahead[1 : n + 1] << 21) | ahead[2:]
    open_, rank, covered = np.arange(n), np.zeros(n, np.int64), 3
    while len(open_):
        # the suffixes that still share a rank, which is the lowest place of their group
        by = np.lexsort((keys, rank[open_])) if covered > 3 else np.argsort(keys)
        open_, keys = open_[by], keys[by]
        group = rank[open_]
        new_group, new_key = np.ones(len(open_), bool), np.ones(len(open_), bool)
        new_group[1:] = group[1:] != group[:-1]
        new_key[1:] = new_group[1:] | (keys[1:] != keys[:-1])
        place = np.arange(len(open_))
        lead = np.maximum.accumulate(np.where(new_key, place, 0))
        rank[open_] = group + lead - np.maximum.accumulate(np.where(new_group, place, 0))
        alone = new_key & np.append(new_key[1:], True)
        open_ = open_[~alone]
        keys, covered = rank[np.minimum(open_ + covered, n - 1)], 2 * covered
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


class WaveletMatrix:
    """A sequence as one bit row for each binary digit, most significant first, with counts for ranks."""

    def __init__(self, symbols: np.ndarray):
        self.size, self.levels = len(symbols), max(int(symbols.max(initial=0)).bit_length(), 1)
        self.bits, self.counts, self.zeros = [], [], []
        for level in range(self.levels):
            bit = ((symbols >> (self.levels - 1 - level)) & 1).astype(bool)
            packed = np.zeros((self.size >> 6) + 1 << 3, np.uint8)
            packed[: (self.size + 7) >> 3] = np.packbits(bit, bitorder="little")
            words = packed.view(np.uint64)
            ones = np.cumsum(np.bitwise_count(words), dtype=np.int32)
            self.bits.append(words)
            self.counts.append(np.concatenate([np.zeros(1, np.int32), ones[:-1]]))
            self.zeros.append(self.size - int(bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.sorted = symbols  # by reversed digits

    def follow(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the first symbol of its kind at or after ``at`` stands in the last row."""
        for level in range(self.levels):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[level][word] + np.bitwise_count(self.bits[level][word] & below)
            one = (symbols >> (self.levels - 1 - level)) & 1 == 1
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return at


class FMIndex:
    """Backward search over texts of word numbers from 1, each followed by a 0.

    ``owner`` gives a number to each place; an interval of suffixes tells the lowest owner in it. The
    transformed text is kept as a wavelet matrix, the suffix array is not kept.
    """

    def __init__(self, symbols: np.ndarray, owner: np.ndarray):
        order = suffix_order(symbols)
        self.size = len(symbols)
        self.wavelet = WaveletMatrix(symbols[order - 1])
        first = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(symbols, minlength=1))])
        last_row = self.wavelet.sorted
        starts = np.zeros(len(first), np.int64)
        new = np.flatnonzero(np.concatenate([np.ones(min(1, self.size), bool), last_row[1:] != last_row[:-1]]))
        starts[last_row[new]] = new
        self.shift = first - starts
        self.lowest = [owner[order].astype(np.int32)]
        width = 1
        while 2 * width <= self.size:
            row = self.lowest[-1]
            self.lowest.append(np.minimum(row[: len(row) - width], row[width:]))
            width *= 2

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that start with the symbol and go on as those in [low, high)."""
        both = self.wavelet.follow(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        return both[: len(low)] + self.shift[symbols], both[len(low) :] + self.shift[symbols]

    def lowest_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Lowest owner of each interval; empty ones give the largest number there is."""
        found = np.full(len(low), np.iinfo(np.int32).max, np.int32)
        level = np.frexp(np.maximum(high - low, 1).astype(np.float64))[1] - 1
        for k in np.unique(level[high > low]):
            at = np.flatnonzero((level == k) & (high > low))
            row = self.lowest[k]
            found[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(k))])
        return found


def earlier_matches(index: FMIndex, symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, owner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, from, to) of the stretches that a text with a lower owner holds as well, in matches of at least ``least`` words.

    Query i is ``symbols[begin[i]:end[i]]``. All queries move together, one backward step at a time, from
    the end of a stretch to its begin. Where the whole rest of a query breaks off, what matched behind the
    break is settled, and other windows that begin before it end before the rest does. Where a single
    window breaks off at some word, no window with that word and all that follow up to the window's end
    matches, so the next one begins behind it. After a match the next stretch is longer, else shorter.
    """
    pieces = np.maximum(-(-(end - begin - least + 1) // LONGEST), 0)
    query = np.repeat(np.arange(len(begin)), pieces)
    p = begin[query] + LONGEST * (np.arange(len(query)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    end, own = np.minimum(end[query], p + LONGEST - 1 + least), owner[query]
    more = end - p - least  # words beyond the window that are tried with it
    whole = np.ones(len(query), bool)
    at = end.copy()
    low, high = np.zeros(len(query), np.int64), np.full(len(query), index.size, np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(query):
        low, high = index.extend(symbols[at - 1], low, high)
        holds = index.lowest_owner(low, high) < own
        at = at - holds
        fresh = ~holds | (at == p)
        if not fresh.any():
            continue
        done, stop = fresh & holds, p + least + more
        tail = fresh & ~holds & whole & (stop - at >= least)
        settled = done | tail
        if settled.any():
            out.append((query[settled], at[settled], stop[settled]))
        bare = fresh & ~holds & (more == 0)
        end = np.where(tail, np.minimum(stop - 1, at - 1 + least), end)
        p = np.where(done, p + more + 1, np.where(bare, at, p))
        rest = end - p - least
        more = np.where(done, np.where(whole, 0, 2 * more + 1), np.where(fresh, np.where(tail, rest, np.where(whole, 0, more // 2)), more))
        more = np.minimum(more, rest)
        whole = tail | (whole & ~fresh)
        at = np.where(fresh, p + least + more, at)
        low, high = np.where(fresh, 0, low), np.where(fresh, index.size, high)
        going = rest >= 0
        if not going.all():
            query, end, own, p, more, whole, at, low, high = (x[going] for x in (query, end, own, p, more, whole, at, low, high))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))
