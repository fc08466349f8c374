"""Text expressions: headers, whitespace, markup, keys, names, counts."""

from __future__ import annotations

import html
import html.entities
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftbook.functions import fixed

BLANK_LINE = "\n\n"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """Remove whitespace at both ends."""
    return F.trim(c, F.lit(fixed.SPACE))


def collapse(c: Column) -> Column:
    """One space between words, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def keep_indent(c: Column) -> Column:
    """Drop trailing blanks of each line and blank lines at both ends, keep indentation."""
    unix = F.regexp_replace(c, "\r\n?", "\n")
    lines = F.regexp_replace(unix, r"[^\S\n]+\n", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"\A\s*\n", ""), r"\s+\z", "")


def strip_header(c: Column) -> Column:
    """Remove a provenance header; text without one is only stripped."""
    return strip(F.regexp_replace(c, fixed.HEADER, ""))


def cut_header(c: Column) -> Column:
    """Everything after the first blank line, or all of it when there is none."""
    at = F.instr(c, BLANK_LINE)
    return F.when(at > 0, F.substring(c, at + F.lit(2), F.length(c))).otherwise(c)


def provenance_header(document: Column, chapter: Column, section: Column, page: Column | None = None) -> Column:
    parts = [F.lit("[Document: "), document, F.lit(" | Chapter: "), chapter, F.lit(" | Section: "), section]
    if page is not None:
        parts += [F.lit(" | Page: "), page]
    return F.concat(*parts, F.lit("]" + BLANK_LINE))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]+>", "")


def clean(c: Column) -> Column:
    """Markup out, whitespace collapsed."""
    return collapse(strip_tags(c))


def clean_markup(c: Column) -> Column:
    """Tags out, the five XML entities decoded, tags out again."""
    text = strip_tags(c)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return strip(strip_tags(text))


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


_CLOSED = re.compile("&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _decoded(found: re.Match) -> str:
    entity = found[0]
    return html.unescape(entity) if entity[1] == "#" or entity[1:] in html.entities.html5 else entity


@F.pandas_udf(T.StringType())
def _unescape_closed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: _CLOSED.sub(_decoded, x), na_action="ignore")


def clean_markup_full(c: Column, closed_only: bool = False) -> Column:
    """As :func:`clean_markup` with every named and numbered entity.

    HTML readers decode some names without a semicolon too, also at the front of a longer word (``&ampThe``);
    with ``closed_only`` those stay as they are.
    """
    decode = _unescape_closed if closed_only else _unescape
    return strip(strip_tags(decode(strip_tags(c))))


def title_key(c: Column) -> Column:
    """Comparison key of a title: markup out, lower case, letters a-z and digits only."""
    return F.regexp_replace(F.lower(strip_tags(c)), "[^a-z0-9]", "")


def content_key(c: Column) -> Column:
    """Digest of a text's letters and digits in any script, lower-cased, without markup; null if it has none."""
    plain = F.regexp_replace(F.lower(strip_tags(c)), r"[^\p{L}\p{N}]+", "")
    return F.when(plain != "", F.sha2(plain, 256))


def title_words(c: Column) -> Column:
    """Comparison form of a title that keeps word borders."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def safe_filename(c: Column, size: int = 80) -> Column:
    return F.left(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), F.lit(size))


def filename_part(c: Column, size: int) -> Column:
    runs = F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]+", "_")
    return F.coalesce(blank_to_null(F.left(F.regexp_replace(runs, "^_+|_+$", ""), F.lit(size))), F.lit("x"))


def build_filename(year: Column, author: Column, title: Column, identifier: Column) -> Column:
    name = F.concat_ws("_", year, filename_part(author, 25), filename_part(title, 50), filename_part(identifier, 20))
    return F.concat(name, F.lit(".pdf"))


def slug(c: Column, size: int = 30) -> Column:
    cut = F.left(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit(size))
    return F.regexp_replace(cut, "^_+|_+$", "")


def chunk_id(prefix: str, name: Column, kind: Column, number: Column) -> Column:
    return F.format_string(f"{prefix}_%s_%s_%04d", slug(name), kind, number)


def document_name(stem: Column) -> Column:
    """Readable name of a file stem; a name in one case gets capitals."""
    name = F.regexp_replace(stem, "[_-]", " ")
    runs = F.regexp_extract_all(name, F.lit(r"(\pL+|\PL+)"), F.lit(1))
    titled = F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substring(r, F.lit(2), F.length(r))))), "")
    return F.when((name == F.lower(name)) | (name == F.upper(name)), titled).otherwise(name)


def page_range(first: Column, last: Column) -> Column:
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first, last))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)[^\s\x1c-\x1f]+")).cast("long")


def mentions(c: Column, pattern: str = fixed.TOPIC) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def token_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(fixed.TOKEN), F.lit(0)))


def entities(c: Column, stop: tuple[str, ...] = fixed.STOP_ENTITIES) -> Column:
    """Distinct entity names in a text without the ones that never count."""
    found = F.regexp_extract_all(c, F.lit(f"(?U)({fixed.ENTITY})"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda e: ~F.upper(e).isin(*stop)))


def meta_leak(c: Column) -> Column:
    return c.rlike("(?U)" + fixed.META_LEAK)


def contains_any(c: Column, needles: tuple[str, ...]) -> Column:
    """True where the lower-cased text holds any of the plain substrings."""
    low = F.lower(c)
    hit = F.lit(False)
    for needle in needles:
        hit = hit | F.contains(low, F.lit(needle))
    return hit


def shares_substring(a: Column, b: Column, width: int = 40, stride: int = 20) -> Column:
    """True where a slice of ``a`` taken every ``stride`` characters occurs in ``b``."""
    starts = F.when(F.length(a) >= width, F.sequence(F.lit(1), F.length(a) - F.lit(width - 1), F.lit(stride)))
    low = F.struct(F.lower(a).alias("a"), F.lower(b).alias("b"))
    hit = let(low, lambda s: F.exists(starts, lambda i: F.contains(s["b"], F.substring(s["a"], i, F.lit(width)))))
    return F.coalesce(hit, F.lit(False))


def unfence(c: Column) -> Column:
    """Text of a fenced block without the fence."""
    opened = F.regexp_replace(strip(c), fixed.FENCE_START, "")
    return F.regexp_replace(strip(opened), fixed.FENCE_END, "")


def first_author(authors: Column) -> Column:
    name = strip(F.element_at(F.split(authors, ","), 1))
    return F.when(F.coalesce(authors, F.lit("")) == "", F.lit("unknown")).otherwise(name)


def canonical_pmcid(c: Column) -> Column:
    up = F.upper(c)
    return F.when(up.startswith("PMC"), up).otherwise(F.concat(F.lit("PMC"), up))


def canonical_doi(c: Column) -> Column:
    return blank_to_null(F.lower(F.regexp_replace(c, "https://doi.org/", "")))


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)
