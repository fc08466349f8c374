"""Sections and chunks of a document.

Sections are filled forward in blocks of a document; chunks are found in splits that a document may run
through, so neither needs a document in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftbook.functions import fixed
from siftbook.functions.layout import chapter_of, fence_code, is_caption, is_stop_section, is_top_level
from siftbook.functions.text import page_range, provenance_header, strip
from siftbook.operators import chunk_splits
from siftbook.operators.quality import drop_repeated

BODY = "Body"


def fill_forward(df: DataFrame, document: str, order: str, values: dict[str, Column], block: int = 10_000) -> DataFrame:
    """Latest non-null value up to each row of its document, for a numeric order.

    Rows without a document are one document; rows without an order are filled by nothing but their own value.

    A document is cut into blocks of the order. Each block is filled by itself; what a block hands
    on is one row, so a document of any length meets in one task only as its list of blocks.
    """
    blocked = df.withColumns({"_block": F.floor(F.col(order) / block), **{f"_v_{n}": v for n, v in values.items()}})
    ends = blocked.groupBy(document, "_block").agg(
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))).alias(n) for n in values]
    )
    earlier = W.partitionBy("_d").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumnsRenamed({document: "_d", "_block": "_b"})
    carried = ends.select("_d", "_b", *[F.last(n, ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in values])
    so_far = W.partitionBy(document, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    local = blocked.withColumns({f"_v_{n}": F.last(f"_v_{n}", ignorenulls=True).over(so_far) for n in values})
    joined = local.join(carried, local[document].eqNullSafe(carried["_d"]) & local["_block"].eqNullSafe(carried["_b"]))
    return joined.select(*[local[c] for c in df.columns], *[F.coalesce(f"_v_{n}", f"_c_{n}").alias(n) for n in values])


def fill_sections(elements: DataFrame, document: str, order: str, text: str, heading: str) -> DataFrame:
    """Give every element the latest heading before it; cut the document at a stop section."""
    title = F.when(F.col(heading), F.col(text))
    filled = fill_forward(elements, document, order, {"section_title": title, "_stopped": F.when(is_stop_section(title), True)})
    known = F.col("section_title").isNotNull()
    return filled.filter(F.col("_stopped").isNull()).drop("_stopped").withColumns({
        "section_title": F.coalesce("section_title", F.lit("Unknown Section")),
        "chapter": F.when(known, chapter_of(F.col("section_title"))).otherwise("Unknown Chapter"),
    })


def fill_hierarchy(elements: DataFrame, document: str, order: str, text: str, heading: str, capitals: bool = True) -> DataFrame:
    """Two levels: top-level names open a chapter, other headings a section inside it."""
    title = F.when(F.col(heading), F.col(text))
    filled = fill_forward(elements, document, order, {"chapter": F.when(is_top_level(title, capitals), title), "section_title": title})
    return filled.withColumns({c: F.coalesce(c, F.lit(BODY)) for c in ("chapter", "section_title")})


def section_of_page(elements: DataFrame, document: str, page: str, order: str) -> DataFrame:
    """Section in force at the end of each page."""
    return elements.groupBy(document, page).agg(F.max_by("section_title", order).alias("section_title"))


def chunk_starts(marks: Column, limit: int = fixed.MAX_SECTION_CHARS) -> Column:
    """Positions at which the chunks of an array of (size, fresh, alone) begin.

    A chunk closes before an element that is ``fresh`` (new section) or ``alone`` (a table), after
    one that is alone, and where it would grow beyond ``limit``; an oversized element is a chunk.
    """
    start = F.struct(
        F.lit(1).alias("at"), F.lit(0).cast("long").alias("used"), F.lit(True).alias("closed"),
        F.array().cast("array<int>").alias("starts"),
    )

    def step(s: Column, e: Column) -> Column:
        opens = s["closed"] | e["fresh"] | e["alone"] | (s["used"] + e["size"] > limit)
        return F.struct(
            (s["at"] + 1).alias("at"),
            F.when(opens, e["size"]).otherwise(s["used"] + e["size"]).alias("used"),
            e["alone"].alias("closed"),
            F.when(opens, F.concat(s["starts"], F.array(s["at"]))).otherwise(s["starts"]).alias("starts"),
        )

    return F.aggregate(marks, start, step, lambda s: s["starts"])


def pack_arrays(df: DataFrame, elements: str, limit: int = fixed.MAX_SECTION_CHARS) -> DataFrame:
    """Adds ``chunks`` for an array of (kind, content, chapter, section_title) in document order."""
    e = F.col(elements)

    def mark(x: Column, i: Column) -> Column:
        before = F.get(e, i - 1)
        same = x["chapter"].eqNullSafe(before["chapter"]) & x["section_title"].eqNullSafe(before["section_title"])
        return F.struct(F.length(x["content"]).cast("long").alias("size"), ((i > 0) & ~same).alias("fresh"), (x["kind"] == "table").alias("alone"))

    def chunk(start: Column, i: Column) -> Column:
        until = F.coalesce(F.get("_starts", i + 1), F.size(e) + 1)
        part, first = F.slice(e, start, until - start), F.element_at(e, start)
        return F.struct(
            (i + 1).cast("long").alias("chunk"), first["kind"].alias("content_type"), first["chapter"].alias("chapter"),
            first["section_title"].alias("section_title"), F.array_join(F.transform(part, lambda p: p["content"]), "\n\n").alias("text"),
            F.size(part).cast("long").alias("n_elements"),
        )

    marked = df.withColumn("_marks", F.transform(e, mark))
    started = marked.withColumn("_starts", chunk_starts(F.col("_marks"), limit))
    return started.withColumn("chunks", F.transform("_starts", chunk)).drop("_starts", "_marks")


def pack_elements(elements: DataFrame, document: str, order: str, content: str, kind: str, limit: int = fixed.MAX_SECTION_CHARS,
                  page: str | None = None, run: str | None = None) -> DataFrame:
    """Section-aware chunks of rows (document, order, kind, content, chapter, section_title).

    With ``page`` a chunk gets its first_page and last_page. ``run`` tells sections of one name apart
    that stand in different places.

    Rows are sorted over all tasks, so a document of any length is packed in many: see
    :mod:`siftbook.operators.chunk_splits`. Chunks close as in :func:`chunk_starts`. Rows without a
    document are one document.
    """
    rows = elements.select(F.col(document).alias("d"), F.col(order).alias("o"), F.col(kind).alias("kind"), F.col(content).alias("content"), "chapter", "section_title",
                           (F.col(page) if page else F.lit(None)).cast("long").alias("page"), (F.col(run) if run else F.lit(None)).cast("long").alias("run"))
    chunks = chunk_splits.pack(rows, limit)
    return chunks.select(F.col("d").alias(document), "chunk", F.col("kind").alias("content_type"), "chapter", "section_title", "text", "n_elements",
                         *(["first_page", "last_page"] if page else []))


def layout_chunks(blocks: DataFrame, document: str, order: str, page: str, text: str, heading: str, mono: str, limit: int = fixed.MAX_SECTION_CHARS) -> DataFrame:
    """Corpus chunks of layout blocks, as one operator.

    Blocks are stripped; empty ones, short ones that a document repeats and captions go. A heading
    that differs from the one before opens a section, a stop section ends the document, and code is
    fenced. Chunks carry their pages in ``page_range`` and in the header in front of the text.
    ``order`` is numeric and sorts the blocks of a document.
    """
    rows = blocks.select(F.col(document).alias("_d"), F.col(order).alias("_o"), F.col(page).alias("_p"), strip(F.col(text)).alias("_t"), F.coalesce(F.col(heading), F.lit(False)).alias("_h"), F.col(mono).alias("_m"))
    rows = drop_repeated(rows.filter("_t != ''"), "_d", "_t").filter(~is_caption(F.col("_t")))
    # headings are few, so a document's meet in one task
    before = F.coalesce(F.lag("_t").over(W.partitionBy("_d").orderBy("_o")), F.lit("Introduction"))
    opened = rows.filter("_h").withColumn("_new", F.col("_t") != before)
    # names of sections come with the headings, so that filling them in does not move the other texts once more
    opened = opened.select(F.col("_d").alias("_hd"), F.col("_o").alias("_ho"), "_new", F.when(F.col("_new"), F.col("_t")).alias("_title"), F.when(is_stop_section(F.col("_t")), True).alias("_stop"))
    marked = rows.join(opened, rows["_d"].eqNullSafe(opened["_hd"]) & (rows["_o"] == opened["_ho"]), "left")
    filled = fill_forward(marked.drop("_hd", "_ho"), "_d", "_o", {"_section": F.col("_title"), "_run": F.when(F.col("_new"), F.col("_o")), "_stopped": F.col("_stop")})
    body = filled.filter(F.col("_stopped").isNull() & ~F.col("_h")).select(
        "_d", "_o", "_p", F.lit("text").alias("kind"), fence_code(F.col("_t"), F.coalesce("_m", F.lit(0.0))).alias("content"), "_run",
        F.coalesce("_section", F.lit("Introduction")).alias("section_title"), F.when(F.col("_section").isNull(), "Chapter 1").otherwise(chapter_of(F.col("_section"))).alias("chapter"),
    )
    packed = pack_elements(body, "_d", "_o", "content", "kind", limit, page="_p", run="_run")
    pages = page_range(F.col("first_page"), F.col("last_page"))
    header = provenance_header(F.coalesce(F.col("_d").cast("string"), F.lit("")), F.col("chapter"), F.col("section_title"), pages)
    return packed.select(
        "content_type", F.concat(F.lit("chunk_"), F.format_string("%04d", "chunk")).alias("id"), F.col("_d").alias(document), "chapter", "section_title",
        F.col("first_page").alias("page_number"), pages.alias("page_range"), F.concat(header, F.col("text")).alias("text"),
    )


def unnest(df: DataFrame, items: str, keep: list[str]) -> DataFrame:
    """One row per struct of a computed array.

    The outer form is used because the plain one lets the optimizer copy the array's whole
    expression into a size filter below it.
    """
    rows = df.select(*keep, F.explode_outer(items).alias("_x"))
    return rows.filter(F.col("_x").isNotNull()).select(*keep, "_x.*")
