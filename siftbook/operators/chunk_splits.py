"""Greedy chunks of sorted rows, found in splits that any document may run through.

A chunk begins at every cut (another document, section or run, or a table) and where it would grow beyond the
limit. What a split does to the chunk that is open where it begins depends on one number, the characters that
chunk holds: they decide which of the rows before the first cut begins the next one. From every such row the
starts that follow are found by pointer doubling over prefix sums. So a split is summed up in a step function
of at most ``limit + 2`` steps, the functions are applied one after the other, and each split is then walked
as a stream that knows the chunk it begins in.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from siftbook.session import shared_folder, stage

HEAD = ["kind", "chapter", "section_title", "run"]
_SPLIT = "split long, first_kind string, first_chapter string, first_section_title string, first_run long, last_kind string, last_chapter string, last_section_title string, last_run long, " \
    "cut boolean, other boolean, upto array<long>, times array<long>, ends array<long>, total long, more long, used long"


class Entry(NamedTuple):
    """Where a split begins: chunks of the document so far, characters of the open one (None: the first row begins one)."""

    number: int
    used: int | None


def _follow(before: np.ndarray, stop: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For a chunk that begins at each row: chunks up to the last row, start of the last one.

    ``before`` are the characters before each row and behind all, ``stop`` is the next cut of each row.
    """
    n = len(stop)
    at = np.arange(n, dtype=np.int64)
    after = np.minimum(stop, np.maximum(at + 1, np.searchsorted(before, before[:-1] + limit, side="right") - 1))
    jump, times, last = np.append(after, n), np.append(np.ones(n, np.int64), 0), np.append(at, n)
    while (jump[:n] < n).any():
        last = np.where(jump < n, last[jump], last)
        times, jump = times + times[jump], jump[jump]
    return times[:n], last[:n]


def _before(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def steps(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What rows without a cut do to an open chunk, as arrays (upto, times, ends).

    With ``room`` characters left, the first step with ``upto > room`` holds: so many chunks begin, and the
    last one ends with so many characters. Without such a step all rows go into the open chunk. A chunk
    beyond the limit has negative room, which is always the first step.
    """
    n, before = len(sizes), _before(sizes)
    times, last = _follow(before, np.full(n, n), limit)
    grows = np.concatenate([[True], sizes[1:] > 0])
    first = np.flatnonzero(grows & (before[:-1] <= limit))
    upto, times, ends = before[first + 1], times[first], before[n] - before[last[first]]
    kept = np.append((times[1:] != times[:-1]) | (ends[1:] != ends[:-1]), True)
    return upto[kept], times[kept], ends[kept]


def cuts(document: list, heads: list[list]) -> np.ndarray:
    """True at each row but the first that begins a chunk whatever stands before it."""
    kinds, *names = heads
    rows = list(zip(document, *names, strict=True))
    return np.array([a != b or "table" in kind for a, b, *kind in zip(rows, rows[1:], kinds, kinds[1:], strict=False)], bool)


def _after_cut(sizes: np.ndarray, cut: np.ndarray, limit: int) -> tuple[int, int]:
    """Chunks that begin in rows whose first one is a cut, and characters of the last one."""
    n, before, at = len(sizes), _before(sizes), np.append(np.flatnonzero(cut), len(sizes))
    stop = at[np.searchsorted(at, np.arange(n), side="right")]
    times, last = _follow(before, stop, limit)
    return int(times[0]), int(before[n] - before[last[0]])


def _summary(split: int, document: list, heads: list[list], sizes: np.ndarray, limit: int) -> tuple:
    inner = np.append([False], cuts(document, heads))
    at = np.flatnonzero(inner)
    lead = int(at[0]) if len(at) else len(sizes)
    changes = [i for i in at.tolist() if document[i] != document[i - 1]]
    tail = changes[-1] if changes else lead
    upto, times, ends = steps(sizes[:lead], limit)
    more, used = _after_cut(sizes[tail:], inner[tail:], limit) if tail < len(sizes) else (0, 0)
    return (split, *(h[0] for h in heads), *(h[-1] for h in heads), bool(len(at)), bool(changes),
            upto.tolist(), times.tolist(), ends.tolist(), int(sizes[:lead].sum()), more, used)


def entries(splits: list, limit: int) -> dict[int, Entry]:
    """Where each split begins, from the sums of all splits in order."""
    found, document, head, number, used = {}, None, None, 0, 0
    for s in splits:
        first = [s[f"first_{h}"] for h in HEAD]
        goes_on = head is not None and document == s["first_document"]
        joined = goes_on and first[1:] == head[1:] and "table" not in (first[0], head[0])
        found[s["split"]] = Entry(number if goes_on else 0, used if joined else None)
        number = number if goes_on else 0
        step = 0 if not joined else next((i for i, u in enumerate(s["upto"]) if used > limit or u > limit - used), None)
        begun, ends = (0, used + s["total"]) if step is None else (s["times"][step], s["ends"][step])
        number = s["more"] if s["other"] else number + begun + s["more"]
        used = s["used"] if s["cut"] else ends
        document, head = s["last_document"], [s[f"last_{h}"] for h in HEAD]
    return found


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _summarise(limit: int, types: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, document, heads, sizes = None, [], [[] for _ in HEAD], []
        for batch in batches:
            if batch.num_rows:
                split = batch.column("split")[0].as_py()
                document += batch.column("d").to_pylist()
                sizes.append(batch.column("size").to_numpy(zero_copy_only=False))
                for held, name in zip(heads, HEAD, strict=True):
                    held += batch.column(name).to_pylist()
        if sizes:
            rows = [(*_summary(split, document, heads, np.concatenate(sizes).astype(np.int64), limit), document[0], document[-1])]
            yield _arrow(rows, types)

    return run


def _walk(limit: int, begin: dict[int, Entry], types: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, document, head, number, used, n, held, pages, done = None, None, None, 0, 0, 0, [], [], []
        unfinished = False

        def close(unfinished_: bool) -> None:
            if n:
                text = "\n\n".join(held) if held else None
                done.append((document, number, *head[:3], text, n, min(pages, default=None), max(pages, default=None), split, unfinished_))

        for batch in batches:
            for d, *head_, page, size, text, at in zip(*(batch.column(c).to_pylist() for c in ("d", *HEAD, "page", "size", "content", "split")), strict=True):
                if split is None:
                    split, document = at, d
                    number, open_ = begin[at]
                    if open_ is not None:
                        head, used, unfinished = head_, open_, True
                if head is None or d != document or "table" in (head[0], head_[0]) or head_[1:] != head[1:] or used + size > limit:
                    close(unfinished)
                    number = number + 1 if d == document else 1
                    document, head, used, n, held, pages, unfinished = d, head_, 0, 0, [], [], False
                if text is not None:
                    held.append(text)
                if page is not None:
                    pages.append(page)
                n, used = n + 1, used + size
            yield _arrow(done, types)
            done.clear()
        close(True)
        yield _arrow(done, types)

    return run


def pack(rows: DataFrame, limit: int) -> DataFrame:
    """Chunks (d, chunk, kind, chapter, section_title, text, n_elements, first_page, last_page).

    ``rows`` has d, o, kind, chapter, section_title, run, page, content. They are sorted by (d, o) over all
    tasks, so a long document lies in many splits. The driver gets one row for each split; a chunk that
    runs over the border of splits is put together from one part of each.
    """
    spark = rows.sparkSession
    shared_folder(spark)
    sized = rows.withColumn("size", F.coalesce(F.length("content"), F.lit(0)).cast("long"))
    placed = sized.sort("d", "o").checkpoint().withColumn("split", F.shiftrightunsigned(F.monotonically_increasing_id(), 33))
    kind = rows.schema["d"].dataType
    summed = StructType.fromDDL(_SPLIT).add("first_document", kind).add("last_document", kind)
    sums = placed.select("split", "d", *HEAD, "size").mapInArrow(_summarise(limit, to_arrow_schema(summed)), summed)
    begin = entries(sorted(sums.collect(), key=lambda s: s["split"]), limit)

    schema = rows.select("d").schema.add("chunk", "long")
    for name, type_ in (("kind", "string"), ("chapter", "string"), ("section_title", "string"), ("text", "string"), ("n_elements", "long"),
                        ("first_page", "long"), ("last_page", "long"), ("split", "long"), ("unfinished", "boolean")):
        schema = schema.add(name, type_)
    walked = stage(placed.select("split", "d", *HEAD, "page", "size", "content").mapInArrow(_walk(limit, begin, to_arrow_schema(schema)), schema), "chunks")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("split", "text"))), lambda p: p["text"])
    whole = walked.filter("NOT unfinished").drop("split", "unfinished").withColumn("text", F.coalesce("text", F.lit("")))
    joined = walked.filter("unfinished").groupBy("d", "chunk").agg(
        *[F.min_by(c, "split").alias(c) for c in ("kind", "chapter", "section_title")], F.array_join(parts, "\n\n").alias("text"),
        F.sum("n_elements").alias("n_elements"), F.min("first_page").alias("first_page"), F.max("last_page").alias("last_page"),
    )
    return whole.unionByName(joined)
