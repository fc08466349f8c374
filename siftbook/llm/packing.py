"""Token packing: documents become pieces, pieces are packed into sequences by hierarchical best fit."""

from __future__ import annotations

import functools
import itertools
import os
import re
import unicodedata
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftbook.llm.batches import pieces
from siftbook.session import stage

#: Words whose ids a task remembers at most, those that it leaves to the next one, and the longest such word.
CACHE_WORDS, KEPT_WORDS, CACHE_CHARS = 500_000, 200_000, 64

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: White space of the vocabulary's own splitter.
_SPACE = re.compile(r"[\t-\r \x85\xa0  -     　]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level vocabularies write a byte as itself if it is a visible character, the others from 256 on.
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: What str.split takes for white space besides.
_SEPARATORS = re.compile("[\x1c-\x1f]")


class WordIds:
    """Token ids of texts, looked up by word.

    The vocabularies this serves never join words over white space and split letters from other
    characters, so the ids of a text are the ids of its words, and those of a word before a full
    stop or comma are the word's and the mark's. Words of letters need only the merges of the model;
    all others go through the whole tokenizer. Frequent words are encoded once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        self.whole = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.whole.model).encode_batch_fast
        self.cache: dict[str, bytes] = {}
        self.marks = {m: self._packed(self.whole.encode(m, add_special_tokens=False)) for m in ".,"}

    @staticmethod
    def _packed(encoding) -> bytes:
        return np.array(encoding.ids, "<u4").tobytes()

    def trim(self) -> None:
        """Keep the words met first, which are the frequent ones."""
        if len(self.cache) > KEPT_WORDS:
            self.cache = dict(itertools.islice(self.cache.items(), KEPT_WORDS))

    @staticmethod
    def _plain(word: str) -> bool:
        """Letters that the tokenizer's normaliser leaves as they are; others may become letters and marks."""
        return word.isalpha() and (word.isascii() or word == word.lower() and unicodedata.is_normalized("NFC", word))

    def _learn(self, words: list[str]) -> None:
        letters = list(filter(self._plain, words))
        spelled = [w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_LETTERS) for w in letters]
        self.cache |= zip(letters, map(self._packed, self.merges(spelled, add_special_tokens=False)), strict=True)
        others = list(set(words).difference(letters))
        self.cache |= zip(others, map(self._packed, self.whole.encode_batch_fast(others, add_special_tokens=False)), strict=True)

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        cache, split, words = self.cache, [], set()
        for text in texts:
            low = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
            split.append(low.split() if not _SEPARATORS.search(low) else [w for w in _SPACE.split(low) if w])
            words.update(split[-1])
        if len(cache) > CACHE_WORDS:
            self.trim()
            cache = self.cache
        new = words.difference(cache)
        ended = [w for w in new if w[-1] in ".," and self._plain(w[:-1])]
        self._learn(list({w[:-1] for w in ended}.difference(cache) | new.difference(ended)))
        for w in ended:
            cache[w] = cache[w[:-1]] + self.marks[w[-1]]
        for own in split:
            yield b"".join(map(cache.__getitem__, own))
        for w in ended:
            del cache[w]
        for w in new:
            if len(w) > CACHE_CHARS:
                cache.pop(w, None)
                cache.pop(w[:-1], None)


@functools.cache
def word_ids(path: str) -> WordIds:
    """One for each Python worker, so that tasks that follow each other share what it remembers."""
    return WordIds(path)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Cut each document's ids, followed by ``end_id``, into pieces of ``capacity``.

    A null or empty text has the end id only. Rows with a null ``doc_id`` are pieces like others.
    ``with_ids`` adds the ids themselves, for writing sequences out.
    """
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(vocabulary)
        for batch in batches:
            for part in pieces(batch, "text"):
                out = [[] for _ in names]
                for doc, own in zip(part.column("doc_id").to_pylist(), ids(part.column("text").to_pylist()), strict=True):
                    data = memoryview(own + end)
                    for k, at in enumerate(range(0, len(data) // 4, capacity)):
                        cut = data[4 * at : 4 * (at + capacity)]
                        row = (doc, k, at, len(cut) // 4, crc32(cut)) + ((np.frombuffer(cut, "<u4").astype("i4"),) if with_ids else ())
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)
        ids.trim()

    return docs.select("doc_id", "text").mapInArrow(task, PIECE + (", ids array<int>" if with_ids else ""))


class BestFit:
    """Open bins by free room; each item goes where it leaves the least room."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.stacks = capacity, 0, [[] for _ in range(capacity + 1)]

    def put(self, size: int, members: list) -> None:
        fitting = self.rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            stack = self.stacks[room]
            held = stack.pop()
            if not stack:
                self.rooms ^= 1 << room
            held.extend(members)
        else:
            room, held = self.capacity, list(members)
        room -= size
        self.stacks[room].append(held)
        self.rooms |= 1 << room

    def bins(self) -> Iterator[tuple[int, list]]:
        for room, stack in enumerate(self.stacks):
            for members in stack:
                yield self.capacity - room, members


def pack(pieces_: DataFrame, capacity: int = 4096, slack: int = 8, fan_in: int = 8, task_rows: int = 50_000) -> DataFrame:
    """Pack pieces into few sequences of ``capacity`` tokens; adds ``sequence_id`` and ``offset``.

    Each task packs its pieces best-fit, longest first. Bins with at most ``slack`` tokens free are
    final. The others go on as items, merged over ``fan_in`` times fewer tasks, until one task has
    packed the rest. If more than ``task_rows`` bins for each task stay and a round joins less than
    a tenth of them, they are too full to share a sequence, and one more round ends the work. A bin
    carries one row for each member, at most ``capacity``, and no tokens. An empty input gives an
    empty result; repeated rows are packed one by one.
    """
    member = "struct<" + PIECE.replace(" ", ":").replace(",:", ",") + ">"
    fields = T._parse_datatype_string(f"size int, done boolean, members array<{member}>")
    keys = [f.strip().split(" ")[0] for f in PIECE.split(",")]

    def task_of(last: bool):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = [row for b in batches for row in zip(b.column("size").to_pylist(), b.column("members").to_pylist(), strict=True)]
            items.sort(key=lambda x: -x[0])
            best = BestFit(capacity)
            for size, members in items:
                best.put(size, members)
            items.clear()
            out: list = []
            for size, members in best.bins():
                out.append((size, last or size >= capacity - slack, members))
                if len(out) == 500:
                    yield _bins(out)
                    out = []
            yield _bins(out)

        return task

    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    arrow = pa.list_(pa.struct(list(zip(keys, kinds, strict=True))))

    def _bins(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], arrow)],
            ["size", "done", "members"],
        )

    pieces_ = stage(pieces_.select(*keys), "pieces")
    items = pieces_.select(F.col("length").cast("int").alias("size"), F.array(F.struct(*keys)).alias("members"))
    before = pieces_.count()
    tasks, last, finished = max(1, -(-before // task_rows)), False, []
    while True:
        last = last or tasks == 1
        packed = stage(items.repartition(tasks).mapInArrow(task_of(last), fields), "bins")
        finished.append(packed.filter("done"))
        if last:
            break
        items = packed.filter("NOT done").select("size", "members")
        left = items.count()
        last = left > 0.9 * before
        before, tasks = left, max(-(-left // task_rows), -(-tasks // fan_in))
    bins = finished[0]
    for more in finished[1:]:
        bins = bins.unionByName(more)
    # a bin gets a number once, in a table, before its members are spread
    bins = stage(bins.select(F.monotonically_increasing_id().alias("sequence_id"), "members"), "sequences")
    return bins.mapInArrow(_spread, ", ".join([PIECE, "sequence_id long", "offset long"]))


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each member of a bin, with its place in it."""
    for batch in batches:
        members, sequences = batch.column("members"), batch.column("sequence_id").to_numpy()
        parent, flat = pc.list_parent_indices(members).to_numpy(), members.flatten()
        ends = np.cumsum(flat.field("length").to_numpy())
        starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
        first = np.searchsorted(parent, parent)  # the parent's first member
        columns = [*flat.flatten(), pa.array(sequences[parent]), pa.array(starts - starts[first] if len(ends) else starts, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, [flat.type.field(i).name for i in range(flat.type.num_fields)] + ["sequence_id", "offset"])
