"""Rules over layout blocks: headings, chapters, captions, code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftbook.functions import fixed
from siftbook.functions.text import blank_to_null, strip


def is_heading(text: Column, size: Column, median: Column, bold: Column) -> Column:
    t = strip(text)
    low, high = fixed.HEADING_CHARS
    prominent = bold | (size >= median * fixed.LARGE_HEADING_FACTOR)
    too_small = bold & (size < median * fixed.SMALL_BOLD_FACTOR)
    return prominent & ~too_small & F.length(t).between(low, high) & ~t.rlike(fixed.NO_LETTERS)


def chapter_of(heading: Column) -> Column:
    h = strip(heading)
    number = F.coalesce(
        blank_to_null(F.regexp_extract(h, fixed.CHAPTER_NUMBER, 1)),
        blank_to_null(F.regexp_extract(h, fixed.CHAPTER_NAME, 1)),
    )
    return F.coalesce(F.concat(F.lit("Chapter "), number), F.lit("Unknown Chapter"))


def is_stop_section(c: Column) -> Column:
    return c.rlike(fixed.STOP_SECTION)


def is_caption(c: Column) -> Column:
    return c.rlike(fixed.CAPTION)


def is_top_level(c: Column, capitals: bool) -> Column:
    """A section name that opens a chapter; ``capitals`` also accepts names in capitals."""
    named = c.rlike(fixed.TOP_LEVEL_SECTION)
    if not capitals:
        return named
    flat = F.regexp_replace(c, r"\s+", " ")
    return named | ((flat == F.upper(flat)) & (F.length(flat) > 3))


def is_code(text: Column, mono_ratio: Column) -> Column:
    t = strip(text)
    request = t.rlike(fixed.HTTP_REQUEST)
    braces = (t.startswith("{") | t.startswith("[")) & (t.endswith("}") | t.endswith("]"))
    return (mono_ratio >= fixed.MONO_SHARE) | request | braces | t.startswith("curl ")


def fence_code(text: Column, mono_ratio: Column) -> Column:
    return F.when(is_code(text, mono_ratio), F.concat(F.lit("```\n"), text, F.lit("\n```"))).otherwise(text)


def element_id(page: Column, index: Column, kind: str) -> Column:
    return F.concat(F.lit("p"), page.cast("string"), F.lit(f"_{kind}"), index.cast("string"))


def table_text(rows: Column, label: Column, caption: Column) -> Column:
    """Tab-separated table with a title line, '' for a table without rows."""
    body = F.array_join(F.transform(rows, lambda cells: F.array_join(cells, "\t")), "\n")
    head = F.concat_ws(" | ", blank_to_null(strip(label)), blank_to_null(caption))
    titled = F.when(head == "", body).otherwise(F.concat(head, F.lit("\n"), body))
    return F.when(F.coalesce(F.size(rows), F.lit(0)) <= 0, F.lit("")).otherwise(titled)
