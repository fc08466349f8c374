"""Joins between records, passages, metadata and full text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftbook.functions import fixed
from siftbook.functions.layout import chapter_of
from siftbook.functions.text import token_set
from siftbook.operators.ranking import first_per_key, top_per_group
from siftbook.session import stage

#: Bits of the filter that is sent to all tasks, 4 MB.
BLOOM_BITS = 1 << 25
#: Up to so many questions of a document are compared with all its passages; beyond, words are joined first.
FEW_QUESTIONS = 4


def with_source(pairs: DataFrame, chunks: DataFrame, on: str) -> DataFrame:
    """Pairs with their source chunk and a flag for the ones that have none."""
    marked = chunks.withColumn("_found", F.lit(True))
    return pairs.join(marked, on, "left").withColumn("missing", F.col("_found").isNull()).drop("_found")


def wanted_chunks(chunks: DataFrame, pairs: DataFrame, chunk_id: str, pair_id: str, order: str) -> DataFrame:
    """Only the chunks some pair asks for, the last of each id, with how often the id occurs."""
    ids = pairs.select(F.col(pair_id).alias(chunk_id)).distinct()
    asked = chunks.join(ids, chunk_id, "left_semi")
    last = F.max_by(F.struct(*[c for c in chunks.columns if c != chunk_id]), F.col(order))
    return asked.groupBy(chunk_id).agg(last.alias("_row"), F.count("*").alias("n_copies")).select(chunk_id, "_row.*", "n_copies")


def unfinished(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work whose key is not among the finished ones."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def lookup_or_default(left: DataFrame, right: DataFrame, on: str, defaults: dict[str, str]) -> DataFrame:
    joined = left.join(right.select(on, *defaults), on, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def recover_identifier(articles: DataFrame, other: DataFrame, on: str, identifier: str) -> DataFrame:
    """Fill a missing identifier from a second source."""
    second = other.filter(F.col(identifier).isNotNull()).groupBy(on).agg(F.min(identifier).alias("_other"))
    joined = articles.join(second, on, "left")
    return joined.withColumn("recovered", F.col(identifier).isNull() & F.col("_other").isNotNull()).withColumn(
        identifier, F.coalesce(identifier, "_other")
    ).drop("_other")


def full_text(articles: DataFrame, publisher: DataFrame, article_xml: DataFrame, on: str) -> DataFrame:
    """Publisher text, else article XML, else none; says which it was. Both sides are (key, body)."""
    joined = articles.join(publisher.withColumnRenamed("body", "_pdf"), on, "left").join(article_xml.withColumnRenamed("body", "_xml"), on, "left")
    source = F.when(F.col("_pdf").isNotNull(), "publisher_direct").when(F.col("_xml").isNotNull(), "rendered_from_jats_xml")
    return joined.withColumn("body", F.coalesce("_pdf", "_xml")).withColumn("source_used", source).drop("_pdf", "_xml")


def linked_preprints(articles: DataFrame, records: DataFrame) -> DataFrame:
    """Preprint of each link of an article: (doi, preprint_doi, preprint_date).

    ``articles`` has doi and ``links`` (array of doi), ``records`` has doi, created and published.
    """
    links = articles.select("doi", F.explode("links").alias("preprint_doi")).filter(F.col("preprint_doi").isNotNull())
    found = records.select(F.col("doi").alias("preprint_doi"), F.coalesce("created", "published").alias("preprint_date"))
    return links.join(found, "preprint_doi", "left").select("doi", "preprint_doi", "preprint_date")


def figure_sections(figures: DataFrame, page_sections: DataFrame, document: str, page: str) -> DataFrame:
    """Section of a figure: its page's, else the page before, else the document's last."""
    here = page_sections.select(document, F.col(page), F.col("section_title").alias("_here"))
    before = page_sections.select(document, (F.col(page) + 1).alias(page), F.col("section_title").alias("_before"))
    last = page_sections.groupBy(document).agg(F.max_by("section_title", page).alias("_last"))
    joined = figures.join(here, [document, page], "left").join(before, [document, page], "left").join(last, document, "left")
    return joined.withColumn("section_title", F.coalesce("_here", "_before", "_last")).drop("_here", "_before", "_last")


def table_sections(tables: DataFrame, headings: DataFrame, last_sections: DataFrame, document: str, page: str, order: str, text: str) -> DataFrame:
    """Section of a table: the first heading of its page, else the document's current section."""
    first = first_per_key(headings, [document, page], [order]).select(document, page, F.col(text).alias("_first"))
    joined = tables.join(first, [document, page], "left").join(last_sections, document, "left")
    section = F.coalesce("_first", "section_title")
    return joined.withColumn("section_title", section).withColumn("chapter", chapter_of(F.col("section_title"))).drop("_first")


def find_passages(questions: DataFrame, passages: DataFrame, document: str, k: int = 3, few: int = FEW_QUESTIONS) -> DataFrame:
    """Passage of a question: its own chunk when it exists, else the ``k`` with most shared words.

    ``questions`` has id, ``document``, source_chunk_id and ``needle``; ``passages`` has
    ``document``, chunk_id, ``order`` and body. The score is the number of shared words through the root of
    the passage's words. A document with at most ``few`` questions has each compared with all its passages, which move once
    by their document. For the others candidates come from :func:`passage_candidates`, which leaves out the common words
    of a question; their whole word sets are then compared. The first ``k`` of the document fill up places.
    """
    # words are taken once, each side is read several times
    q = stage(questions.select("id", document, "source_chunk_id", token_set(F.col("needle")).alias("_q")), "questions")
    c = stage(passages.select(document, "chunk_id", "order", token_set(F.col("body")).alias("_c")).withColumn("_size", F.size("_c")), "passages")
    exact = q.join(c.select(document, F.col("chunk_id").alias("source_chunk_id")), [document, "source_chunk_id"])
    exact = exact.select("id", F.col("source_chunk_id").alias("chunk_id"), F.lit(1.0).alias("score"), F.lit(1).cast("long").alias("place"), F.lit(True).alias("exact"))
    rest = q.join(exact.select("id").distinct(), "id", "left_anti")
    chunk = ["chunk_id", "order", "_size"]
    worded = c.filter("_size > 0")
    rest = stage(rest.select("id", document, "_q"), "unanswered")
    asked = stage(rest.groupBy(document).agg(F.count("*").alias("_asked")), "asked")
    shared = F.size(F.coalesce(F.array_intersect("_q", "_c"), F.array().cast("array<string>"))).cast("long").alias("_n")
    counted = rest.join(asked.filter(F.col("_asked") <= few), document).join(worded, document).select("id", *chunk, shared)
    if not asked.filter(F.col("_asked") > few).isEmpty():
        many = stage(rest.join(asked.filter(F.col("_asked") > few), document).drop("_asked"), "many-questions")
        found = passage_candidates(many, worded, document, k).join(many.select("id", "_q"), "id").join(worded.select(document, "chunk_id", "order", "_c"), [document, "chunk_id", "order"])
        counted = counted.unionByName(found.select("id", *chunk, shared))
        first = top_per_group(worded.select(document, *chunk), [document], [F.col("order")], F.lit(k), bound=k)
        spare = many.select("id", document).join(first, document).select("id", *chunk, F.lit(0).cast("long").alias("_n"))
        counted = counted.unionByName(spare)
    scored = counted.groupBy("id", *chunk).agg(F.round(F.max("_n") / F.sqrt(F.col("_size")), 9).alias("score"))
    by = W.partitionBy("id").orderBy(F.col("score").desc(), "order")
    ranked = scored.withColumn("place", F.row_number().over(by).cast("long")).filter(F.col("place") <= k)
    fuzzy = ranked.select("id", "chunk_id", F.round("score", 2).alias("score"), "place", F.lit(False).alias("exact"))
    return exact.unionByName(fuzzy)


def passage_candidates(questions: DataFrame, passages: DataFrame, document: str, k: int) -> DataFrame:
    """(id, ``document``, chunk_id, order, _size) that may be among the ``k`` best of a question; none of those is left out.

    ``questions`` has id, ``document`` and words ``_q``; ``passages`` has ``document``, chunk_id, order, words ``_c`` and
    their number ``_size``. The words of a question are put in order, those in the fewest passages of its document
    first. The rarer half is joined; the k-th score among the best so reached is the least a result has. A passage with none of the
    words before one shares at most the words from there on, so a common word is joined only while that number,
    through the root of the passage's size, is not below the least score. Candidates are held to it in the same way.
    """
    chunk = ["chunk_id", "order", "_size"]
    words = questions.select("id", document, F.explode("_q").alias("_word"))
    asked = words.select(document, "_word").distinct()
    postings = passages.select(document, *chunk, F.explode("_c").alias("_word")).join(asked, [document, "_word"], "left_semi")
    postings = stage(postings, "postings")
    often = postings.groupBy(document, "_word").agg(F.count("*").alias("_often"))
    smallest = postings.groupBy(document).agg(F.min("_size").alias("_smallest"))
    mine = W.partitionBy("id")
    placed = words.join(often, [document, "_word"]).withColumn("_at", F.row_number().over(mine.orderBy("_often", "_word")))
    # ``_left``: words from this one on, itself included
    placed = stage(placed.withColumn("_all", F.count("*").over(mine)).withColumn("_left", F.col("_all") - F.col("_at") + 1), "placed")
    rare = 2 * F.col("_at") <= F.col("_all") + 1
    reached = placed.filter(rare).join(postings, [document, "_word"]).groupBy("id", document, *chunk).agg(F.count("*").alias("_n"), F.max("_all").alias("_all"))
    reached = stage(reached.withColumn("_score", F.col("_n") / F.sqrt("_size")), "reached")
    # few of the best so far are compared in full; scores are rounded to nine digits in the end
    best = reached.withColumn("_k", F.row_number().over(mine.orderBy(F.desc("_score")))).filter(F.col("_k") <= 4 * k)
    whole = best.select("id", document, "chunk_id", "order").join(questions.select("id", "_q"), "id").join(passages, [document, "chunk_id", "order"])
    scores = F.sort_array(F.collect_list(F.size(F.array_intersect("_q", "_c")) / F.sqrt("_size")), asc=False)
    least = stage(whole.groupBy("id").agg((F.get(scores, F.lit(k - 1)) - 1e-8).alias("_least")), "least")
    common = placed.filter(~rare).join(least, "id", "left").join(smallest, document).withColumn("_least", F.coalesce("_least", F.lit(0.0)))
    common = common.filter(F.col("_left") >= F.col("_least") * F.sqrt("_smallest"))
    late = common.join(postings, [document, "_word"]).filter(F.col("_left") >= F.col("_least") * F.sqrt("_size"))
    late = late.groupBy("id", document, *chunk).agg(F.max("_left").alias("_most"))
    early = reached.select("id", document, *chunk, (F.col("_n") + F.floor(F.col("_all") / 2)).alias("_most"))
    either = early.unionByName(late).groupBy("id", document, *chunk).agg(F.max("_most").alias("_most")).join(least, "id", "left")
    return either.filter(F.col("_most") >= F.coalesce("_least", F.lit(0.0)) * F.sqrt("_size")).select("id", document, *chunk)


def shared_substrings(probes: DataFrame, texts: DataFrame, probe_key: str, text_key: str, text: str, width: int = 40, stride: int = 20) -> DataFrame:
    """(probe, text) pairs where a slice of the probe, taken every ``stride`` characters, occurs in the whole text.

    As :func:`siftbook.functions.text.shares_substring`, without holding every pair: the fingerprints of all
    windows of a text are looked up in a Bloom filter of the slices' fingerprints, of fixed size. Only
    windows that pass it leave their text, and they join slices of the same characters, so texts need no
    blanks, nothing is joined by a common word, and no text moves.
    """
    kinds = dict(probes.dtypes)[probe_key], dict(texts.dtypes)[text_key]
    own = probes.select(F.col(probe_key).alias("_key"), F.lower(text).alias("text"))
    slices = own.mapInArrow(windows_of(width, stride), f"_key {kinds[0]}, print long, part string").withColumnRenamed("_key", "_probe")
    passes = texts.sparkSession.sparkContext.broadcast(_bloom_filter(slices))
    held = texts.select(F.col(text_key).alias("_key"), F.lower(text).alias("text"))
    found = held.mapInArrow(windows_of(width, 1, passes), f"_key {kinds[1]}, print long, part string")
    same = found.join(slices, ["print", "part"])
    return same.select(F.col("_probe").alias(probe_key), F.col("_key").alias(text_key)).distinct()


def _bloom_filter(slices: DataFrame) -> np.ndarray:
    """A bit field of ``BLOOM_BITS`` as 64-bit words, set from two parts of each fingerprint; made by tasks, put together here."""
    modulo = lambda c: F.pmod(c, F.lit(BLOOM_BITS))
    places = F.explode(F.array(modulo(F.col("print")), modulo(F.shiftrightunsigned("print", 32))))
    word = F.shiftright("at", 6).cast("int").alias("word")
    bit = F.expr("shiftleft(1L, cast(at % 64 as int))")
    words = np.zeros(BLOOM_BITS // 64, np.int64)
    for r in slices.select(places.alias("at")).groupBy(word).agg(F.bit_or(bit).alias("bits")).collect():
        words[r["word"]] = r["bits"]
    return words.view(np.uint64)


def windows_of(width: int, stride: int, passes: Broadcast | None = None) -> Callable:
    """A task that gives (_key, print, part) for windows of texts, each once for a text; with a filter only those that pass it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, prints, parts = [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                if text is None or len(text) < width:
                    continue
                values = window_prints(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), width)[::stride]
                at = np.arange(len(values))
                if passes is not None:
                    for part in (values, values >> np.uint64(32)):
                        place = (part % np.uint64(BLOOM_BITS))[at]
                        at = at[(passes.value[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
                values, first = np.unique(values[at], return_index=True)
                rows += [row] * len(values)
                prints.append(values.view(np.int64))
                parts += [text[i * stride : i * stride + width] for i in at[first].tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("_key").take(pa.array(rows, pa.int64())), pa.array(np.concatenate(prints) if prints else [], pa.int64()), pa.array(parts, pa.string())], ["_key", "print", "part"])

    return task


def window_prints(points: np.ndarray, width: int) -> np.ndarray:
    """64-bit fingerprints of all windows of ``width`` code points, put together from windows of 1, 2, 4, ... points."""
    base, size = np.uint64(0x9E3779B97F4A7C15), 1
    held = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    held ^= held >> np.uint64(32)
    power, out, have, left = base, None, 0, width
    with np.errstate(over="ignore"):
        while True:
            if left & size:
                # the part of this size follows what there is already
                out = held if out is None else out[: len(held) - have] * power + held[have:][: len(out)]
                have += size
                left -= size
            if not left:
                break
            held, size, power = held[: len(held) - size] * power + held[size:], 2 * size, power * power
    out = out[: len(points) - width + 1]
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def pair_outputs(first: DataFrame, second: DataFrame, on: list[str]) -> DataFrame:
    """Two outputs for the same item side by side: both sides are (keys, output)."""
    return first.withColumnRenamed("output", "a").join(second.withColumnRenamed("output", "b"), on)


def complete_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs where both answers are there."""
    return pairs.filter((F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != ""))


def flatten_metadata(df: DataFrame, nested: list[str], plain: list[str]) -> DataFrame:
    """Nested values as JSON text, missing values as '', content type defaults to text."""
    out = {c: F.coalesce(F.to_json(c), F.lit("")) for c in nested}
    out |= {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in plain}
    if "content_type" not in df.columns:
        out["content_type"] = F.lit("text")
    return df.withColumns(out)


def source_card(df: DataFrame, document: Column, ranges: Column, number: Column, text: Column) -> DataFrame:
    """What a reader sees of a hit: document, page, one-line snippet."""
    blank = lambda c: F.nullif(c.cast("string"), F.lit(""))
    return df.withColumns({
        "document_name": F.coalesce(document, F.lit("?")),
        "page": F.coalesce(blank(ranges), F.when(number != 0, blank(number)), F.lit("?")),
        "snippet": F.replace(F.left(text, F.lit(200)), F.lit("\n"), F.lit(" ")),
    })


def in_categories(df: DataFrame, category: str, wanted: tuple[str, ...] = fixed.TARGET_CATEGORIES) -> DataFrame:
    return df.filter(F.col(category).isin(*wanted))
