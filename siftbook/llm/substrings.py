"""Passages that an earlier document holds word by word, found by an FM-index for each shard of passages.

Two equal windows of words have the same lowest hash among their short word runs. Documents are cut into
fragments: neighbouring windows with one such hash, the key of the fragment. Keys that only one document
has are done. The other fragments, once each, are dealt out by key, so equal windows meet in one shard;
the shard's texts are indexed and all its fragments are streamed through the index backwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftbook.llm.batches import mapped, pieces
from siftbook.llm.fm_index import INDEX_WORDS, FMIndex, earlier_matches
from siftbook.llm.word_runs import Runs, Words, lowest
from siftbook.session import stage

_IDENTITY = ["doc_id", "th"]
PIECE_BYTES = 4 << 20


def _fragments(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, th, starts, n, key, mark) of all fragments; with a column ``spans`` only of windows inside them.

    Equal fragments of a document are one row with all their starts, so a text of few words over and
    over has few rows, however its windows are cut.
    """
    spanned = "spans" in docs.columns
    id_type = docs.schema["doc_id"].dataType
    kinds = {"th": T.LongType(), "starts": T.ArrayType(T.LongType()), "n": T.LongType(), "key": T.LongType(), "mark": T.LongType()}
    schema = T.StructType([T.StructField("doc_id", id_type), *(T.StructField(c, t) for c, t in kinds.items())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", size=PIECE_BYTES):
                words = Words(piece.column("text"))
                open_ = np.arange(len(words.row)) + window <= words.first[words.row + 1]
                if spanned:
                    inside = np.zeros(len(open_), bool)
                    for first, own in zip(words.first.tolist(), piece.column("spans").to_pylist()):  # noqa: B905
                        for span in own:
                            for start in span["starts"]:
                                inside[first + start : first + start + span["n"]] = True
                    open_ &= inside
                at = np.flatnonzero(open_)
                if not len(at):
                    continue
                runs, grams = Runs(words.hashes()), np.arange(len(open_) - gram + 1)
                least = lowest(runs.of(grams, grams + gram, 0), window - gram + 1)[at]
                new = np.ones(len(at), bool)
                new[1:] = (np.diff(at) > 1) | (least[1:] != least[:-1]) | (np.diff(words.row[at]) > 0)
                new = np.flatnonzero(new)
                size, first = np.diff(np.append(new, len(at))), at[new]
                row, key, mark = words.row[first], least[new].view(np.int64), runs.of(first, first + size + window - 1, 1).view(np.int64)
                by = np.lexsort((first, mark, key, row))
                row, key, mark, size, start = row[by], key[by], mark[by], size[by], (first - words.first[row])[by]
                kind = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(key) != 0) | (np.diff(mark) != 0)))
                taken = piece.select(_IDENTITY).take(pa.array(row[kind]))
                starts = pa.ListArray.from_arrays(pa.array(np.append(kind, len(row)), pa.int32()), pa.array(start))
                yield pa.RecordBatch.from_arrays([*taken.columns, starts, *(pa.array(x[kind]) for x in (size, key, mark))], schema.names)

    return docs.select("doc_id", "th", "text", *["spans"] * spanned).mapInArrow(task, schema)


def _texts(wanted: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """(key, mark, first_doc, text) of the wanted fragments (key, mark, rep), cut from whole documents."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = F.struct("rep.start", "rep.n", "key", "mark")
    lists = wanted.groupBy("rep.doc_id", "rep.th").agg(F.collect_set(cut).alias("cuts"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", size=PIECE_BYTES):
                words, cuts = Words(piece.column("text")), piece.column("cuts")
                row = np.repeat(np.arange(len(cuts)), pc.list_value_length(cuts).to_numpy())
                start, n, key, mark = (x for x in cuts.flatten().flatten())
                first = words.first[row] + start.to_numpy()
                low, high = words.begin[first], words.stop[first + n.to_numpy() + window - 2]
                data = words.data.tobytes()
                yield pa.RecordBatch.from_arrays([key, mark, piece.column("doc_id").take(pa.array(row)), pa.array([data[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)], pa.binary())], ["key", "mark", "first_doc", "text"])

    joined = docs.join(lists, _IDENTITY).select("doc_id", "text", "cuts")
    return joined.mapInArrow(task, f"key long, mark long, first_doc {kind}, text binary")


def _searched(texts: DataFrame, window: int, index_words: int) -> DataFrame:
    """(key, mark, first_doc, cuts): word stretches of each fragment that a lower document holds as well.

    A partition's fragments come in order of their key. Whole keys fill an index of up to
    ``index_words`` words; then its fragments are searched in it, and the next index begins.
    """
    kind = texts.schema["first_doc"].dataType.simpleString()
    spread = texts.repartition("key").sortWithinPartitions("key", "mark", "first_doc")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group: list[tuple] = []  # rows of the key that comes in
        n_held = n_group = 0
        for batch in batches:
            out_type = batch.schema.field("first_doc").type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[-1][:2] == row[:2]:
                    continue  # a repeated row of the table
                if group and group[-1][0] != row[0]:
                    if held and n_held + n_group > index_words:
                        yield _found(held, window, out_type)
                        held, n_held = [], 0
                    held.extend(group)
                    n_held, group, n_group = n_held + n_group, [], 0
                group.append(row)
                n_group += len(row[3]) // 2 + 2  # words have a byte and a space at least
        if held and n_held + n_group > index_words:
            yield _found(held, window, out_type)
            held = []
        if held or group:
            yield _found(held + group, window, out_type)

    return spread.select("key", "mark", "first_doc", "text").mapInArrow(task, f"key long, mark long, first_doc {kind}, cuts array<struct<start: bigint, stop: bigint>>")


def _found(rows: list[tuple], window: int, id_type: pa.DataType) -> pa.RecordBatch:
    """The fragments of one shard, indexed and searched."""
    order = {doc: i for i, doc in enumerate(sorted({r[2] for r in rows}))}
    words = Words(pa.array([r[3] for r in rows], pa.binary()))
    sizes = np.diff(words.first)
    begin = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.zeros(len(words.row) + len(rows), np.int64)
    symbols[np.arange(len(words.row)) + words.row] = np.unique(words.hashes(), return_inverse=True)[1] + 1
    owner = np.array([order[r[2]] for r in rows])
    index = FMIndex(symbols, np.repeat(owner, sizes + 1))
    query, low, high = earlier_matches(index, symbols, begin, begin + sizes, owner, window)
    by = np.lexsort((low, query))
    cuts: list[list[dict]] = [[] for _ in rows]
    for q, a, b in zip(query[by].tolist(), (low - begin[query])[by].tolist(), (high - begin[query])[by].tolist(), strict=True):
        if cuts[q] and cuts[q][-1]["stop"] >= a:
            cuts[q][-1]["stop"] = max(cuts[q][-1]["stop"], b)
        else:
            cuts[q].append({"start": a, "stop": b})
    kinds = (pa.int64(), pa.int64(), id_type, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], cuts], kinds, strict=True)], ["key", "mark", "first_doc", "cuts"])


def repeated_spans(docs: DataFrame, window: int = 50, gram: int = 12, crowd: int = 256, index_words: int = INDEX_WORDS) -> DataFrame:
    """(doc_id, th, spans): word stretches (start, stop) of a document that lie in windows an earlier document holds.

    ``th`` is the 64-bit hash of the text; a document that is listed has at least one stretch. A key
    with more than ``crowd`` different fragments is a common line in many places: its windows become
    fragments by themselves, keyed by their own hash, so they spread again and none is left out.
    """
    own = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    rough = stage(_fragments(own, window, gram), "fragments")
    fine = stage(_shared(rough), "shared-fragments")
    crowded = stage(fine.select("key", "mark").distinct().groupBy("key").count().filter(F.col("count") > crowd).select("key"), "crowds")
    if not crowded.isEmpty():
        wide = stage(fine.join(crowded, "key").groupBy(*_IDENTITY).agg(F.collect_set(F.struct("starts", "n")).alias("spans")), "crowded")
        windows = stage(_fragments(own.filter(_among(wide)).join(wide, _IDENTITY), window, window), "windows")
        fine = stage(fine.join(crowded, "key", "left_anti").unionByName(_shared(windows)), "shared-fragments")
    first = F.min(F.struct("doc_id", "th", F.get("starts", F.lit(0)).alias("start"), "n"))
    wanted = fine.groupBy("key", "mark").agg(first.alias("rep"))
    found = stage(_searched(_texts(wanted, own, window), window, index_words), "found")
    # the first document of a fragment keeps what no lower one has, the others lose all of it
    spot = fine.join(found, ["key", "mark"])
    all_of = F.transform("starts", lambda a: F.struct(a.alias("start"), (a + F.col("n") + window - 1).alias("stop")))
    moved = F.flatten(F.transform("starts", lambda a: F.transform("cuts", lambda c: F.struct((c["start"] + a).alias("start"), (c["stop"] + a).alias("stop")))))
    spans = F.when(F.col("doc_id") == F.col("first_doc"), moved).otherwise(all_of)
    listed = spot.select(*_IDENTITY, spans.alias("spans")).filter(F.size("spans") > 0)
    # a repeated row of the table lists its stretches again
    return listed.groupBy(*_IDENTITY).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def _among(rows: DataFrame, bits: int = 1 << 18) -> Column:
    """Condition that holds for all documents in ``rows`` and few others, so that a join moves fewer texts."""
    words = [0] * (bits // 64)
    for r in rows.select(F.pmod("th", F.lit(bits)).alias("bit")).distinct().collect():
        words[r["bit"] >> 6] |= 1 << (r["bit"] & 63)
    own = F.pmod("th", F.lit(bits))
    signed = [F.lit(w - (1 << 64) if w >> 63 else w).cast("long") for w in words]
    return F.getbit(F.get(F.array(*signed), (own / 64).cast("int")), (own % 64).cast("int")) == 1


def _shared(fragments: DataFrame) -> DataFrame:
    """The fragments whose key several documents have."""
    seen = fragments.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    return fragments.join(seen.filter("a < b").select("key"), "key")


ADDED = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))), T.StructField("kept_text", T.StringType())]


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, window: int = 50, gram: int = 12, crowd: int = 256, index_words: int = INDEX_WORDS) -> DataFrame:
    """Documents without the words that lie in a window whose words also stand, in a row, in a document of lower id.

    Words are what stands between white space, unchanged; a window is ``window`` of them. Adds n_words,
    n_removed, ``removed`` (stretches of word numbers) and ``kept_text``, the words that stay joined by
    one space. What repeats inside one document only, and what two rows of one id share, stays. Null
    and empty texts have no words. Rows without an id lose nothing and make no other row lose anything.
    A new column replaces one of the same name. Fragments of several documents count as equal if two
    64-bit hashes agree; whether windows are equal is decided on their words.
    """
    names = [f.name for f in ADDED]
    kept = [c for c in dict.fromkeys(docs.columns if keep is None else keep) if c not in names]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), "doc_id", "text", F.xxhash64("text").alias("th"))
    spans = repeated_spans(docs.select("doc_id", "text"), window, gram, crowd, index_words)
    joined = rows.join(spans, _IDENTITY, "left")
    return mapped(joined, "text", ADDED, _without, keep=["_row"], extra=["spans"]).select("_row.*", *names)


def _without(piece: pa.RecordBatch) -> dict[str, list]:
    out: dict[str, list] = {f.name: [] for f in ADDED}
    for text, spans in zip(piece.column("text").to_pylist(), piece.column("spans").to_pylist(), strict=True):
        words = (text or "").encode("utf-8", "surrogatepass").split()
        merged: list[list[int]] = []
        for span in spans or ():
            if merged and span["start"] <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], span["stop"])
            else:
                merged.append([span["start"], span["stop"]])
        stay, at = [], 0
        for a, b in merged:
            stay += words[at:a]
            at = b
        stay += words[at:]
        out["n_words"].append(len(words))
        out["n_removed"].append(len(words) - len(stay))
        out["removed"].append([{"start": a, "stop": b} for a, b in merged])
        out["kept_text"].append(b" ".join(stay).decode("utf-8", "surrogatepass"))
    return out
