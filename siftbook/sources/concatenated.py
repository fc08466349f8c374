"""Files of JSON objects that follow each other without commas, read in splits of any size.

A file is cut at every closing brace, inside strings too, so a piece is short and its last byte is the only
place where an object can end. What a piece does to the state (inside a string or not, depth of braces)
depends only on whether it begins inside a string. Each split is run once for both cases; the few numbers of
its splits are added up along a file, which tells every split the state it really begins in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftbook.functions.text import strip

_NEVER = 1 << 60
_PLACE = "file string, block long"
_ROW = [f"{name}{p}" for p in (0, 1) for name in ("start", "end", "least", "times")]
_SUM = [f"{name}{p}" for p in (0, 1) for name in ("depth", "low", "count", "low_before", "count_before")]
_NUMBERS = ["at", "quote_start", "quote_end", *_ROW, "quotes", "size", "bytes", *_SUM]
_SCHEMA = f"{_PLACE}, kind string, text binary, " + ", ".join(f"{c} long" for c in _NUMBERS)


class Pieces:
    """What pieces do, each with its closing brace: quotes passed, and change of depth from outside and inside a string."""

    def __init__(self, values: list[bytes]):
        self.data = b"}".join(values) + b"}"
        self.stop = np.cumsum([len(v) + 1 for v in values])
        self.begin = self.stop - [len(v) + 1 for v in values]
        data = np.frombuffer(self.data, np.uint8)
        places = np.arange(len(data))
        slashes = data == 0x5C
        run = places - np.maximum.accumulate(np.where(slashes, -1, places))  # backslashes up to here
        escaped = np.append(False, run[:-1] % 2 == 1)
        inside = np.cumsum((data == 0x22) & ~escaped)
        before = np.append(0, inside[self.stop[:-1] - 1])
        self.quotes = inside[self.stop - 1] - before
        odd = (inside - np.repeat(before, self.stop - self.begin)) % 2
        opens = data == 0x7B
        closes_inside = self.quotes % 2
        counted = [np.add.reduceat((opens & (odd == p)).astype(np.int64), self.begin) for p in (0, 1)]
        self.change = [counted[0] - (closes_inside == 0), counted[1] - (closes_inside == 1)]


class Split:
    """Running state of one split for both beginnings, 0 outside and 1 inside a string."""

    def __init__(self, place: tuple):
        self.place, self.rows, self.held = place, 0, []
        self.quotes = self.bytes = 0
        self.depth, self.low, self.count = [0, 0], [_NEVER, _NEVER], [0, 0]
        self.start = self._state()

    def _state(self) -> tuple:
        return self.quotes % 2, *self.depth, *self.low, *self.count

    def run(self, values: list[bytes]) -> Iterator[dict]:
        """Rows of text that end where, for one of the beginnings, the depth is as low as never before or again."""
        if not values:
            return
        p = Pieces(values)
        passed = self.quotes + np.cumsum(p.quotes)
        begun = np.append(self.quotes, passed[:-1]) % 2
        depth, low, count = [], [], []
        for case in (0, 1):
            d = self.depth[case] + np.cumsum(np.where(begun == case, p.change[0], p.change[1]))
            able = np.where(passed % 2 == case, d, _NEVER)
            least = np.minimum(np.minimum.accumulate(able), self.low[case])
            hits = np.cumsum((able == least) & (able < _NEVER))
            fresh = least < np.append(self.low[case], least[:-1])
            since = np.maximum.accumulate(np.where(fresh, np.arange(len(d)), -1))
            times = hits - np.where(since >= 0, hits[since] - 1, 0) + np.where(since >= 0, 0, self.count[case])
            depth.append(d)
            low.append(least)
            count.append(times)
            hits = (able == least) & (able < _NEVER)
            ends = hits if case == 0 else ends | hits  # noqa: F821
        done = 0
        for i in np.flatnonzero(ends).tolist():
            self.held.append(p.data[done : p.stop[i]])
            done = int(p.stop[i])
            self._set(int(passed[i]), [int(x[i]) for x in (*depth, *low, *count)])
            yield self.row("part")
        if done < len(p.data):
            self.held.append(p.data[done:])
        self._set(int(passed[-1]), [int(x[-1]) for x in (*depth, *low, *count)])
        self.bytes += len(p.data)

    def _set(self, quotes: int, numbers: list[int]) -> None:
        self.quotes, self.depth, self.low, self.count = quotes, numbers[:2], numbers[2:4], numbers[4:]

    def row(self, kind: str) -> dict:
        """The text held since the last row, with the state in front of it and behind it."""
        quote, s0, s1, l0, l1, c0, c1 = self.start
        out = dict(zip(("file", "block"), self.place[:2], strict=True)) | {"kind": kind, "text": b"".join(self.held), "at": self.rows, "quote_start": quote, "quote_end": self.quotes % 2}
        out |= {"start0": s0, "start1": s1, "end0": self.depth[0], "end1": self.depth[1], "least0": l0, "least1": l1, "times0": c0, "times1": c1}
        self.held, self.start, self.rows = [], self._state(), self.rows + 1
        return out

    def close(self, last: bytes) -> Iterator[dict]:
        """The last piece as a row of its own, and the sums of the split with it and without."""
        if self.held:
            yield self.row("part")
        before = self.low, self.count
        for row in self.run([last]):
            yield row | {"kind": "last"}
        if self.held:
            yield self.row("last")
        out = {"file": self.place[0], "block": self.place[1], "kind": "split", "quotes": self.quotes, "size": self.place[2], "bytes": self.bytes}
        for p in (0, 1):
            out |= {f"depth{p}": self.depth[p], f"low{p}": self.low[p], f"count{p}": self.count[p], f"low_before{p}": before[0][p], f"count_before{p}": before[1][p]}
        yield out


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split, last = None, None
    types = [("file", pa.string()), ("block", pa.int64()), ("kind", pa.string()), ("text", pa.binary()), *((c, pa.int64()) for c in _NUMBERS)]

    def packed(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in types], [c for c, _ in types])

    for batch in batches:
        rows: list[dict] = []
        places = list(zip(*(batch.column(c).to_pylist() for c in ("file", "block", "size")), strict=True))
        values = batch.column("value").to_pylist()
        borders = [i for i in range(len(places)) if i == 0 or places[i] != places[i - 1]] + [len(places)]
        for a, b in zip(borders, borders[1:]):  # noqa: B905
            if split is None or split.place != places[a]:
                if split is not None:
                    rows += split.close(last)
                split, own = Split(places[a]), values[a:b]
            else:
                own = [last, *values[a:b]]
            last = own.pop()
            rows += split.run(own)
        if rows:
            yield packed(rows)
    if split is not None:
        yield packed(list(split.close(last)))


def record_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, record, record_text) of the objects in concatenated JSON files; what stands between them is white space.

    Quotes and braces inside strings, escapes, records of any size and on any number of lines or in one,
    and borders of splits inside a record, a string or an escape make no difference. Records inside one
    split are never shuffled; only those that a border cuts are put together. Text behind the last object
    of a file that is no object becomes a record of its own.
    """
    read = spark.read.option("lineSep", "}").text(path)
    pieces = read.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"))
    done = pieces.mapInArrow(_run, _SCHEMA)
    rows = done.filter("kind <> 'split'").select("file", "block", "kind", "text", "at", "quote_start", "quote_end", *_ROW)
    along = W.partitionBy("file").orderBy("block")
    earlier = along.rowsBetween(W.unboundedPreceding, -1)

    def case(name: str) -> Column:
        return F.when(F.col("inside") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))

    splits = done.filter("kind = 'split'").select("file", "block", "quotes", "size", "bytes", *_SUM)
    splits = splits.withColumn("inside", F.pmod(F.coalesce(F.sum("quotes").over(earlier), F.lit(0)), F.lit(2)))
    splits = splits.withColumn("depth", F.coalesce(F.sum(case("depth")).over(earlier), F.lit(0))).withColumn("final", F.lead("block").over(along).isNull())
    splits = splits.withColumn("low", F.when(F.col("final"), case("low_before")).otherwise(case("low"))).withColumn("times", F.when(F.col("final"), case("count_before")).otherwise(case("count")))
    ends = F.when(F.col("depth") + F.col("low") == 0, F.col("times")).otherwise(0)
    splits = splits.withColumn("before", F.coalesce(F.sum(ends).over(earlier), F.lit(0)))
    # the last piece of a file has its brace only if the bytes say so
    closed = F.sum("bytes").over(W.partitionBy("file")) <= F.col("size")
    splits = splits.select("file", "block", "inside", "depth", "low", "before", "final", closed.alias("closed"))
    placed = rows.join(splits, ["file", "block"])
    real = (F.col("depth") + F.col("low") == 0) & (case("least") == F.col("low"))
    outside = lambda c: (F.col(c) == F.col("inside"))
    begins = outside("quote_start") & (F.col("depth") + case("start") == 0)
    ending = F.col("final") & (F.col("kind") == "last")
    text = F.col("text").cast("string")
    text = F.when(ending & ~F.col("closed"), F.left(text, F.length(text) - 1)).otherwise(text)
    stops = ~ending & outside("quote_end") & (F.col("depth") + case("end") == 0)
    placed = placed.select(
        "file", (F.col("before") + F.when(real, case("times")).otherwise(0)).alias("record"), "block", "at", text.alias("text"),
        (begins & stops).alias("whole"), (ending & begins).alias("rest"),
    )
    placed = placed.filter(~(F.col("rest") & (strip(F.col("text")) == "")))
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "text")))
    joined = placed.filter(~F.col("whole")).groupBy("file", "record").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("record_text"))
    return placed.filter("whole").select("file", "record", F.col("text").alias("record_text")).unionByName(joined)


def read_concatenated(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    """Files of concatenated, possibly pretty-printed JSON objects as rows of ``schema``."""
    return record_texts(spark, path).select(F.from_json("record_text", schema).alias("r")).select("r.*")
