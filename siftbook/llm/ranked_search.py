"""The best documents of each item by a weighted sum over shared terms, found by a dual tree.

Documents and items stand in hierarchies. A node of documents holds the highest value any of its
documents has for a term, a node of items the weight of each term any of its items has. The sum of their
products bounds the score of every pair below, so a pair of nodes is left out when it is lower than the
weakest k-th score among the items below. The bounds are exact, nothing that could be returned is lost.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftbook.llm.batches import arrow_type, pieces
from siftbook.llm.best import Best
from siftbook.llm.words import term_words
from siftbook.operators.ranking import top_per_group
from siftbook.session import stage

FAN = 8
TREE_DOCS = 4096


class Nodes:
    """Sparse rows of one level of a hierarchy: ``terms`` and ``values`` from ``first[i]`` to ``first[i + 1]``."""

    def __init__(self, row: np.ndarray, terms: np.ndarray, values: np.ndarray, n: int):
        """Rows may name a term several times; the highest value stays."""
        by = np.lexsort((terms, row))
        row, terms, values = row[by], terms[by], values[by]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (terms[1:] != terms[:-1])
        at = np.flatnonzero(new)
        self.row, self.terms, self.n = row[at], terms[at], n
        self.values = np.maximum.reduceat(values, at) if len(at) else values
        self.first = np.searchsorted(self.row, np.arange(n + 1))

    def parents(self) -> Nodes:
        return Nodes(self.row // FAN, self.terms, self.values, -(-self.n // FAN))

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the entries of some rows, and where each row's begin among them."""
        sizes = self.first[rows + 1] - self.first[rows]
        begin = np.cumsum(sizes) - sizes
        return np.repeat(self.first[rows] - begin, sizes) + np.arange(int(sizes.sum())), begin


def hierarchy(leaves: Nodes) -> list[Nodes]:
    """Levels from the leaves up to at most ``FAN`` nodes."""
    levels = [leaves]
    while levels[-1].n > FAN:
        levels.append(levels[-1].parents())
    return levels


def by_heaviest(row: np.ndarray, terms: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """New numbers of rows, so that rows with the same heaviest term are neighbours, heavy ones first."""
    by = np.lexsort((~values, row))
    first = by[np.flatnonzero(np.append(True, np.diff(row[by]) > 0))] if len(by) else by
    heaviest, most = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    heaviest[row[first]], most[row[first]] = terms[first], values[first]
    number = np.empty(n, np.int64)
    number[np.lexsort((~most, heaviest))] = np.arange(n)
    return number


class Items:
    """Items as a hierarchy over numbered terms; every item has at least one term."""

    def __init__(self, texts: list[list[bytes]]):
        self.numbers: dict[bytes, int] = {}
        row = np.repeat(np.arange(len(texts)), [len(set(t)) for t in texts])
        terms = np.array([self.numbers.setdefault(w, len(self.numbers)) for t in texts for w in dict.fromkeys(t)], np.int64)
        self.n, self.row, self.terms = len(texts), row, terms

    def weigh(self, weights: np.ndarray) -> None:
        """Lay the hierarchy out; ``weights`` has one weight for each term."""
        number = by_heaviest(self.row, self.terms, weights[self.terms], self.n)
        self.place = np.argsort(number)  # item of each leaf
        self.levels = hierarchy(Nodes(number[self.row], self.terms, weights[self.terms], self.n))


class DualTree:
    """Search of document batches for the best of each item."""

    def __init__(self, items: Items, weights: np.ndarray, k: int, least: np.ndarray):
        self.items, self.weights = items, weights
        self.best = Best(items.n, k, 0)
        self.least = np.maximum(least, 1)  # lower scores are known to be too low
        self.dense = np.zeros((FAN, len(weights)), np.int64)
        self.pairs = 0  # pairs of a document and an item that are scored

    def add(self, ids: np.ndarray, row: np.ndarray, terms: np.ndarray, values: np.ndarray) -> None:
        """Documents by (row, term, value); rows are numbered from 0."""
        number = by_heaviest(row, terms, values * self.weights[terms], len(ids))
        self.ids = ids[np.argsort(number)]
        self.levels = hierarchy(Nodes(number[row], terms, values, len(ids)))
        self._refresh()
        roots, tops = np.arange(self.levels[-1].n), np.arange(self.items.levels[-1].n)
        self._descend(len(self.levels) - 1, roots, len(self.items.levels) - 1, tops)

    def _refresh(self) -> None:
        """Weakest k-th score of each node of items."""
        weakest = np.maximum(self.best.scores[:, -1], self.least)[self.items.place]
        self.weakest = [weakest]
        for level in self.items.levels[1:]:
            self.weakest.append(np.minimum.reduceat(self.weakest[-1], np.arange(0, FAN * level.n, FAN)))

    def _descend(self, level: int, nodes: np.ndarray, height: int, tops: np.ndarray) -> None:
        """All pairs of some sibling nodes of documents with some nodes of items."""
        docs, items = self.levels[level], self.items.levels[height]
        at, _ = docs.entries(nodes)
        line = docs.row[at] - nodes[0]
        self.dense[line, docs.terms[at]] = docs.values[at]
        own, begin = items.entries(tops)
        bounds = np.add.reduceat(self.dense[: len(nodes), items.terms[own]] * items.values[own], begin, axis=1)
        self.dense[line, docs.terms[at]] = 0
        open_ = bounds >= self.weakest[height][tops]
        if level == 0 and height == 0:
            node, item = np.nonzero(open_)
            self.pairs += open_.size
            self.best.add(self.items.place[tops[item]], bounds[node, item], self.ids[nodes[node]])
            return
        for i in np.argsort(-bounds.max(axis=1), kind="stable"):
            left = tops[open_[i]]
            if not len(left):
                continue
            if height:
                left = (left[:, None] * FAN + np.arange(FAN)).ravel()
                left = left[left < self.items.levels[height - 1].n]
            if level:
                children = np.arange(nodes[i] * FAN, min(nodes[i] * FAN + FAN, self.levels[level - 1].n))
            else:
                children = nodes[i : i + 1]
            self._descend(max(level - 1, 0), children, max(height - 1, 0), left)
            if level == 2:
                self._refresh()


def _counted(docs: DataFrame, sent) -> DataFrame:
    """(doc_id, n, terms, tfs): terms of a document, and how often it has each of the items' terms."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("terms", "tfs"))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = sent.value.numbers
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = [term_words(t) for t in piece.column("text").to_pylist()]
                n = np.array([len(w) for w in words], np.int64)
                found = np.fromiter(map(numbers.get, itertools.chain.from_iterable(words), itertools.repeat(-1)), np.int64, int(n.sum()))
                row = np.repeat(np.arange(len(words)), n)[found >= 0]
                keys, tfs = np.unique(row * len(numbers) + found[found >= 0], return_counts=True)
                offsets = pa.array(np.searchsorted(keys, np.arange(len(words) + 1) * len(numbers)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (keys % max(len(numbers), 1), tfs)]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n), *lists], schema.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, schema)


def _searched(counted: DataFrame, sent, ids, id_type: T.DataType, k: int) -> DataFrame:
    """(item_id, item, doc_id, score): the best documents of each item among those of a task."""
    kind = arrow_type(id_type)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, total, length, least = sent.value
        tree = DualTree(items, weights, k, least)
        for batch in batches:
            for start in range(0, batch.num_rows, TREE_DOCS):
                part = batch.slice(start, TREE_DOCS)
                terms = part.column("terms")
                sizes = np.diff(terms.offsets.to_numpy())
                row = np.repeat(np.arange(part.num_rows), sizes)
                tf = part.column("tfs").flatten().to_numpy().astype(np.int64)
                m = np.array([10 + 90 * n * total // length for n in part.column("n").to_pylist()], np.int64)
                tree.add(part.column("doc_id").to_numpy(), row, terms.flatten().to_numpy().astype(np.int64), 10**9 * tf // (1000 * tf + 8 * m[row]))
        item, score, doc = tree.best.rows()
        yield pa.RecordBatch.from_arrays([pa.array([ids.value[i] for i in item.tolist()], kind), pa.array(item), pa.array(doc), pa.array(score)], ["item_id", "item", "doc_id", "score"])

    schema = T.StructType([T.StructField("item_id", id_type), *(T.StructField(c, T.LongType()) for c in ("item", "doc_id", "score"))])
    return counted.mapInArrow(task, schema)


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_chars: int = 4 << 20, seeds: int = 64) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, scores above 0.

    Terms are runs of digits, letters and non-ASCII characters of whole texts, A-Z lower-cased. With N
    documents that have terms, L terms in all of them, n in one, df documents with a term and tf places
    of it in one, a term weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))) and adds
    w * (10^9 tf // (1000 tf + 8 m)) with m = 10 + 90 n N // L; an item's terms count once each. Equal
    scores go by ascending doc_id.

    Null and empty texts have no terms. A document without an id counts in N, L and df and is not
    returned; rows that repeat an id are documents of their own. Rows that repeat an item's id and text
    are one item; an item without terms finds nothing. Items go to the tasks in blocks of about
    ``block_chars`` characters, with one pass for each block. The documents' counts are written once for a
    block. One of ``seeds`` documents is searched first, which only gives the k-th scores to start from.
    """
    spark = docs.sparkSession
    items = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    id_type = items.schema["item_id"].dataType
    blocks = -(-(items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0) // block_chars) or 1
    parts = []
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        worded = [(r["item_id"], words) for r in own if (words := term_words(r["text"]))]
        if not worded:
            continue
        table = Items([words for _, words in worded])
        ids = spark.sparkContext.broadcast([i for i, _ in worded])
        counted = stage(_counted(docs, spark.sparkContext.broadcast(table)), "term-counts")
        total = counted.agg(F.count_if(F.col("n") > 0).alias("n"), F.sum("n").alias("l")).first()
        if not total["l"]:
            break
        df = np.zeros(len(table.numbers), np.int64)
        for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the block's terms
            df[r["t"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * total["n"] + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        table.weigh(weights)
        able = counted.filter(F.col("doc_id").isNotNull() & (F.size("terms") > 0))
        least = np.zeros(table.n, np.int64)

        def best(rows: DataFrame) -> DataFrame:
            sent = spark.sparkContext.broadcast((table, weights, total["n"], total["l"], least))  # noqa: B023
            return top_per_group(_searched(rows, sent, ids, id_type, k), ["item"], [F.col("score").desc(), F.col("doc_id")], F.lit(k), bound=k)  # noqa: B023

        for r in best(able.filter(F.pmod(F.xxhash64("doc_id"), F.lit(seeds)) == 0)).filter(F.col("pick") == k).select("item", "score").collect():
            least[r["item"]] = r["score"]
        parts.append(best(able).select("item_id", F.col("pick").cast("int").alias("rank"), "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", id_type), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
