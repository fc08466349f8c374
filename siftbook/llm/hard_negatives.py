"""Hard negatives of anchors, by a secondary sort over scored pairs.

Scores are made in blocks of anchors against all rows, and a task keeps of each anchor only what can be
returned. These pairs are packed into keys (anchor, falling score, kind, id), dealt out by anchor and
sorted inside their partition, so a stream over a partition meets an anchor's pairs from the best on: a
positive opens a window, the negatives behind it go to all windows that are open.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftbook.llm.best import Best
from siftbook.operators.ranking import top_per_group

LOWEST = np.iinfo(np.int64).min
ROWS, ANCHORS = 2048, 512  # of a block of scores
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class Vectors:
    """Rows that take part: ids, labels and whole numbers floor(scale * x), filled up with zeros."""

    def __init__(self, table: pa.RecordBatch | pa.Table, scale: int):
        ids, vectors, labels = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (table.column(n) for n in ("id", "v", "label")))
        known = pc.and_(pc.and_(ids.is_valid(), vectors.is_valid()), labels.is_valid())
        vectors = vectors.filter(known)
        sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.fill_null(vectors.flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(sizes)), sizes)
        whole = np.bincount(row[~np.isfinite(flat)], minlength=len(sizes)) == 0
        values = np.zeros((len(sizes), int(sizes.max(initial=0))))
        values[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(scale * flat)
        self.values = values[whole]
        self.ids = ids.filter(known).to_numpy(zero_copy_only=False).astype(np.int64)[whole]
        self.labels = labels.filter(known).to_numpy(zero_copy_only=False).astype(np.int64)[whole]

    def part(self, rows: np.ndarray | slice) -> Vectors:
        out = object.__new__(Vectors)
        out.ids, out.labels, out.values = self.ids[rows], self.labels[rows], self.values[rows]
        return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole inner products; exact in doubles while sums stay below 2 ** 53, else in longer numbers, held to 64 bits."""
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * n
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    if most < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(b).T, LOWEST + 1, np.iinfo(np.int64).max).astype(np.int64)


def _best_of(values: np.ndarray, able: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the able values of each row that are among its ``k`` highest, ties included."""
    held = np.where(able, values, LOWEST)
    n = min(k, held.shape[1])
    limit = np.partition(held, held.shape[1] - n, axis=1)[:, held.shape[1] - n]
    return np.nonzero(able & (held >= limit[:, None]))


def _scored(rows: DataFrame, sent, scale: int, k: int, share: int | None, columns: str) -> DataFrame:
    """The pairs of a task that can count: (anchor, score, id).

    Without ``share`` the ``k`` best rows of an anchor's label, else the ``k`` best of other labels in
    each of its windows.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, limits = sent.value  # limits: scores of the positives of each anchor, lowest number where there is none
        width = 1 if share is None else limits.shape[1]
        best = Best(len(anchors.ids) * width, k, LOWEST, distinct=True)
        for batch in batches:
            every = Vectors(batch, scale)
            for low in range(0, len(every.ids), ROWS):
                part = every.part(slice(low, low + ROWS))
                for first in range(0, len(anchors.ids), ANCHORS):
                    own = anchors.part(slice(first, first + ANCHORS))
                    s = scores(own.values, part.values)
                    same = own.labels[:, None] == part.labels
                    for j in range(width):
                        if share is None:
                            able = same & (own.ids[:, None] != part.ids)
                        else:
                            top = limits[first : first + ANCHORS, j, None]
                            # share * top <= 100 * score, without a product that leaves 64 bits
                            able = ~same & (top > LOWEST) & (s <= top) & (s >= -(-(top // 100 * share * 100 + top % 100 * share) // 100))
                        able &= s >= best.scores[first * width + j : (first + len(own.ids)) * width : width, -1, None]
                        row, at = _best_of(s, able, k)
                        best.add((first + row) * width + j, s[row, at], part.ids[at])
        group, score, ids = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(anchors.ids[group // width]), pa.array(score), pa.array(ids)], ["anchor", "score", "id"])

    return rows.mapInArrow(task, columns)


_KEY = struct.Struct(">QQBQ")
_HALF = 1 << 63


def packed(anchor: int, score: int, negative: bool, id_: int) -> bytes:
    """Key whose bytes sort by anchor, falling score, positives before negatives, id."""
    return _KEY.pack(anchor + _HALF, _HALF - 1 - score, negative, id_ + _HALF)


def unpacked(key: bytes) -> tuple[int, int, bool, int]:
    anchor, score, negative, id_ = _KEY.unpack(key)
    return anchor - _HALF, _HALF - 1 - score, bool(negative), id_ - _HALF


def windows(keys: Iterator[bytes], k: int, share: int) -> Iterator[tuple]:
    """Rows of the result from sorted keys; held are the open windows of one anchor."""
    anchor, open_, last = None, [], None
    for key in keys:
        if key == last:
            continue  # a row that repeats
        last = key
        own, score, negative, id_ = unpacked(key)
        if own != anchor:
            anchor, open_ = own, []
        if not negative:
            open_.append([id_, score, 0])
            continue
        # scores fall, so a window they have left stays closed
        open_ = [w for w in open_ if w[2] < k and share * w[1] <= 100 * score]
        for w in open_:
            w[2] += 1
            yield anchor, w[0], w[2], id_, w[1], score


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, share: int = 80, scale: int = 256, anchor_block: int = 4096) -> DataFrame:
    """Hard negatives of rows (vec_id, embedding, label): for each anchor and positive the best rows of other labels.

    A score is the inner product of floor(``scale`` * x); higher ones come first, ties by the lower vec_id.
    Positives are an anchor's first ``positives`` other rows of its label; the negatives of a positive the
    first ``negatives`` rows of other labels with share * positive score <= 100 * score <= 100 * positive
    score. Returns (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows with a null id, label or vector, or a null, NaN or infinite component take no part. A shorter
    vector counts as filled up with zeros. A row that repeats with its id and score counts once, and a row
    with the anchor's id is no other row. Of rows that repeat an anchor's id the one with the lowest
    label and vector is the anchor. Anchors go to the tasks in blocks of about ``anchor_block``, with two
    passes over the rows for each: one finds the positives, one the negatives in their windows.
    """
    spark = rows.sparkSession
    taken = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v"), F.col("label").cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("_anchor"))
    every, chosen = taken.drop("_anchor"), taken.filter("_anchor").drop("_anchor")
    blocks = -(-chosen.count() // anchor_block)
    keys, shuffles = spark.sparkContext.emptyRDD(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = "anchor long, score long, id long"
    for block in range(blocks):
        own = Vectors(chosen.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow(), scale)
        by = np.lexsort((*own.values.T[::-1], own.labels, own.ids))
        own = own.part(by[np.flatnonzero(np.append(True, np.diff(own.ids[by]) > 0))] if len(by) else by)
        number = {a: i for i, a in enumerate(own.ids.tolist())}
        limits = np.full((len(own.ids), positives), LOWEST, np.int64)
        found = _scored(every, spark.sparkContext.broadcast((own, limits)), scale, positives, None, columns).distinct()
        first = top_per_group(found, ["anchor"], [F.col("score").desc(), F.col("id")], F.lit(positives), bound=positives).collect()  # a block's positives
        for r in first:
            limits[number[r["anchor"]], r["pick"] - 1] = r["score"]
        against = _scored(every, spark.sparkContext.broadcast((own, limits)), scale, negatives, share, columns)
        opened = spark.sparkContext.parallelize([(packed(r["anchor"], r["score"], False, r["id"]), None) for r in first], 1)
        keys = keys.union(opened).union(against.rdd.map(lambda r: (packed(r[0], r[1], True, r[2]), None)))
    ordered = keys.repartitionAndSortWithinPartitions(shuffles, lambda key: zlib.crc32(key[:8]))
    return spark.createDataFrame(ordered.mapPartitions(lambda part: windows((key for key, _ in part), negatives, share)), T.StructType.fromDDL(RESULT), verifySchema=False)
