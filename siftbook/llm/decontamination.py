"""Benchmark passages in documents, found by suffix arrays over shards of the documents."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftbook.llm.batches import mapped
from siftbook.llm.words import Numbers, term_words

#: Words of a shard; its word numbers and ranks fit the packed sort keys (21 and 31 bits).
SHARD_WORDS = 1 << 20


class SuffixArray:
    """Suffixes of a sequence of word numbers, sorted by their first ``depth`` words at least.

    Number 0 ends a document. Rounds of sorting pack 3, 6, 12, ... words in one key.
    """

    def __init__(self, words: np.ndarray, depth: int = 12):
        self.words = np.concatenate([words, np.zeros(max(depth, 2), np.int64)])
        n = len(words)
        w = self.words
        rank = self._ranks((w[:n] << 42) | (w[1 : n + 1] << 21) | w[2 : n + 2])
        covered = 3
        while 2 * covered < depth:
            rank, covered = self._ranks(self._joined(rank, covered)), 2 * covered
        self.order = np.argsort(self._joined(rank, covered))

    @staticmethod
    def _ranks(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)
        ordered = keys[order]
        new = np.empty(len(keys), np.int64)
        new[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]])[: len(keys)])
        return new

    @staticmethod
    def _joined(rank: np.ndarray, step: int) -> np.ndarray:
        later = np.zeros_like(rank)
        later[:-step] = rank[step:]
        return (rank << 31) | later

    def find(self, queries: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range in ``order`` of the suffixes that start with the first ``depth`` words of each query row."""
        used = np.arange(queries.shape[1]) < depth[:, None]
        bounds = []
        for upper in (False, True):
            low, high = np.zeros(len(queries), np.int64), np.full(len(queries), len(self.order), np.int64)
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) // 2
                there = self.words[self.order[mid][:, None] + np.arange(queries.shape[1])]
                differs = (there != queries[open_]) & used[open_]
                at = differs.argmax(1)
                rows = np.arange(len(open_))
                less = np.where(differs[rows, at], there[rows, at] < queries[open_, at], upper)
                low[open_[less]], high[open_[~less]] = mid[less] + 1, mid[~less]
            bounds.append(low)
        return bounds[0], bounds[1]


class Tests:
    """Windows of benchmark items as rows of word numbers; equal windows are one row with several places."""

    #: Number of every document word that no item has.
    OTHER = (1 << 21) - 1

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window, self.numbers = window, Numbers()
        parts = [(name, self.numbers.of(term_words(text))) for name, text in items]
        parts = [(name, words) for name, words in parts if len(words)]
        self.names, self.items = [name for name, _ in parts], [words for _, words in parts]
        rows, places = [np.zeros((0, window), np.int64)], [np.zeros((0, 2), np.int64)]
        for item, words in enumerate(self.items):
            size = min(window, len(words))
            own = np.zeros((len(words) - size + 1, window), np.int64)
            own[:, :size] = np.lib.stride_tricks.sliding_window_view(words, size)
            rows.append(own)
            places.append(np.stack([np.full(len(own), item), np.arange(len(own))], 1))
        self.rows, inverse = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.depth = (self.rows > 0).sum(1)
        order = np.argsort(inverse.ravel(), kind="stable")
        self.places = np.concatenate(places)[order]
        self.place_from = np.searchsorted(inverse.ravel()[order], np.arange(len(self.rows) + 1))

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.numbers.get, words, itertools.repeat(self.OTHER)), np.int64, len(words))


def _stretches(texts: list[np.ndarray], overlap: int):
    """Shards of (row, first word, words): many short documents, or a part of a long one."""
    shard, held = [], 0
    for row, words in enumerate(texts):
        for start in range(0, max(len(words) - overlap, 1), SHARD_WORDS - overlap):
            part = words if len(words) <= SHARD_WORDS else words[start : start + SHARD_WORDS]
            if shard and held + len(part) > SHARD_WORDS:
                yield shard
                shard, held = [], 0
            shard.append((row, start, part))
            held += len(part) + 1
            if part is words:
                break
    if shard:
        yield shard


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Words that two sequences share from their starts on."""
    n = min(len(a), len(b))
    differs = np.flatnonzero(a[:n] != b[:n])
    return int(differs[0]) if len(differs) else n


def search(texts: list[list[bytes]], tests: Tests) -> tuple[list[np.ndarray], list[set[str]], list[list[tuple[str, int, int, int]]]]:
    """Per text: which words are hit, the items found, and (item, place in item, place in text, words) of longest matches."""
    numbers = [tests.of(words) for words in texts]
    hit = [np.zeros(len(words), bool) for words in numbers]
    found: list[set[str]] = [set() for _ in numbers]
    matches: list[list[tuple[str, int, int, int]]] = [[] for _ in numbers]
    for shard in _stretches(numbers, tests.window - 1) if len(tests.rows) else ():
        sizes = np.array([len(part) + 1 for _, _, part in shard])
        begins = np.cumsum(sizes) - sizes
        joined = np.zeros(int(sizes.sum()), np.int64)
        for begin, (_, _, part) in zip(begins, shard, strict=True):
            joined[begin : begin + len(part)] = part
        array = SuffixArray(joined, tests.window)
        low, high = array.find(tests.rows, tests.depth)
        for q in np.flatnonzero(low < high):
            at = np.sort(array.order[low[q] : high[q]])
            owner = np.searchsorted(begins, at, "right") - 1
            places = [(item, start) for item, start in tests.places[tests.place_from[q] : tests.place_from[q + 1]].tolist()]
            names = {tests.names[item] for item, _ in places}
            for k, p in zip(owner.tolist(), (at - begins[owner]).tolist(), strict=True):
                row, first, _ = shard[k]
                p += first
                hit[row][p : p + tests.depth[q]] = True
                found[row] |= names
                for item, start in places:
                    own, text = tests.items[item], numbers[row]
                    # a match is reported from its first word on
                    if start == 0 or p == 0 or own[start - 1] != text[p - 1]:
                        matches[row].append((tests.names[item], start, p, _shared(own[start:], text[p : p + len(own)])))
    return hit, found, matches


#: Columns that :func:`find_passages` adds.
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hit_words", T.BinaryType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("matches", T.ArrayType(T.StructType([
        T.StructField("item", T.StringType()), T.StructField("item_start", T.LongType()),
        T.StructField("doc_start", T.LongType()), T.StructField("n_words", T.LongType()),
    ]))),
])


def find_passages(docs: DataFrame, tests: DataFrame, keep: list[str] | None = None, window: int = 10, block_chars: int = 4 << 20) -> DataFrame:
    """Occurrences of benchmark passages (``item_id``, ``text``) in the whole texts of ``docs``.

    A passage is ``window`` consecutive words of an item, or all words of a shorter one. Added are the
    number of words, the hit words as bits, the items found and the longest verbatim matches. Null
    texts have no words; an item without words is never found; a null item id is named ''. Rows that
    repeat are searched one by one, and nothing is shuffled: each task sorts the suffixes of its own
    documents, a million words at a time. The tests go to the tasks in blocks of about
    ``block_chars`` characters, one pass over the documents for each block, so what is broadcast
    is bounded and no test is left out.
    """
    spark = docs.sparkSession
    tests = tests.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    chars = tests.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = -(-chars // block_chars) or 1
    keep = docs.columns if keep is None else keep
    names = [f.name for f in FOUND.fields]
    out = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"]) if c not in names])
    for name in names:
        out = out.withColumn(name, F.lit(None).cast(FOUND[name].dataType))
    for block in range(blocks):
        own = tests.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        sent = spark.sparkContext.broadcast([tuple(r) for r in own.collect()])
        out = mapped(out, "text", FOUND.fields, _pass(sent, window), keep=[c for c in keep if c not in names] + ["text"] * (block < blocks - 1), extra=names)
    return out


def _pass(sent, window: int):
    ready: list[Tests] = []

    def fn(piece: pa.RecordBatch) -> dict[str, list]:
        if not ready:
            ready.append(Tests(sent.value, window))
        texts = [term_words(t) for t in piece.column("text").to_pylist()]
        hit, found, matches = search(texts, ready[0])
        for i, (bits, items, more) in enumerate(zip(*(piece.column(c).to_pylist() for c in ("hit_words", "items", "matches")), strict=True)):
            if bits is not None:
                hit[i] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=len(hit[i])).astype(bool)
                found[i] |= set(items)
                matches[i] += [tuple(m.values()) for m in more]
        return {
            "n_words": [len(w) for w in texts],
            "n_hit": [int(h.sum()) for h in hit],
            "hit_words": [np.packbits(h).tobytes() for h in hit],
            "items": [sorted(f) for f in found],
            "matches": [[dict(zip(("item", "item_start", "doc_start", "n_words"), m, strict=True)) for m in rows] for rows in matches],
        }

    return fn
