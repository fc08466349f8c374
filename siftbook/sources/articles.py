"""Article XML.

A small function walks one article and returns its parts with the titles of the sections around
them. What the parts mean (stop sections, chapters, tables as text, chunks) is decided with array
expressions on the article's row, the same way for both dialects.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from siftbook.functions import fixed
from siftbook.functions.layout import is_stop_section, is_top_level, table_text
from siftbook.functions.text import blank_to_null, clean, collapse, provenance_header, slug
from siftbook.operators.packing import BODY, pack_arrays, unnest

JATS_ROOTS = ("article", "pmc-articleset")
# element names per dialect
JATS = {"title": ("title-group", "article-title"), "abstract": ("abstract",), "body": "body", "section": "sec", "heading": "title",
        "text": ("p",), "table": "table-wrap", "row": "tr", "cell": ("th", "td")}
ELSEVIER = {"title": ("{http://purl.org/dc/elements/1.1/}title",), "abstract": ("description",), "body": "sections", "section": "section", "heading": "section-title",
            "text": ("para", "simple-para"), "table": "table", "row": "row", "cell": ("entry",)}

PARTS = "array<struct<kind:string,value:string,attr:string,titles:array<string>,section:int,label:string,caption:string,cells:array<array<string>>>>"


def _local(el) -> str:
    return el.tag.rpartition("}")[2] if isinstance(el.tag, str) else ""


def _text(el) -> str:
    return "".join(el.itertext()).strip() if el is not None else ""


def _words(el) -> str:
    return " ".join(_text(el).split())


def _first(el, *path):
    """First element below ``el`` with the path's last name, inside one of each name before; names may have a namespace."""
    inside = [el]
    for name in path:
        inside = [e for parent in inside for e in parent.findall(f".//{name if name[0] == '{' else '{*}' + name}")]
    return next(iter(inside), None)


class _Walk:
    """Collects the parts of one article in document order."""

    def __init__(self):
        self.parts, self.sections = [], 0

    def add(self, kind, value, attr=None, titles=(), section=0, table=(None, None, None)):
        self.parts.append((kind, value, attr, list(titles), section, *table))

    def article(self, root):
        kind = _local(root)
        names = JATS if kind in JATS_ROOTS else ELSEVIER
        self.add("root", kind)
        article = _first(root, "article") if kind == "pmc-articleset" else root
        if article is None:
            return
        for part in ("title", "abstract"):
            found = _first(article, *names[part])
            if found is not None:
                self.add(part, _text(found))
        years = {}
        for date in (e for e in article.iter() if _local(e) == "pub-date"):
            year = next((_text(c) for c in date if _local(c) == "year"), "")
            if year.isdigit():
                years[date.get("pub-type", "")] = year
        for when, year in years.items():
            self.add("year", year, attr=when)
        body = _first(article, names["body"])
        if body is not None:
            self.section(body, names, (), 0, tables=False)
        elif names is ELSEVIER:
            for e in article.iter():
                if _local(e) == "simple-para" and _text(e):
                    self.add("loose", _text(e))

    def section(self, el, names, titles, number, tables):
        for child in el:
            name = _local(child)
            if name in names["text"] and _text(child):
                self.add("text", _text(child), titles=titles, section=number)
            elif name == names["table"] and tables:
                self.add("table", "", titles=titles, section=number, table=self.table(child, names))
            elif name == names["section"]:
                self.sections += 1
                heading = next((c for c in child if _local(c) == names["heading"]), None)
                self.section(child, names, (*titles, _words(heading)), self.sections, tables=True)

    def table(self, el, names):
        label = next((c.text for c in el if _local(c) == "label"), None)
        caption = next((t for t in (_words(c) for c in el.iter() if _local(c) == "caption") if t), None)
        rows = [[_words(c) for c in r if _local(c) in names["cell"]] for r in el.iter() if _local(r) == names["row"]]
        keep = any if names is ELSEVIER else len
        return label, caption, [r for r in rows if keep(r)]


def _parse(xml: str) -> list[tuple]:
    walk = _Walk()
    try:
        walk.article(ET.fromstring(xml or ""))
    except ET.ParseError as error:
        return [("error", str(error), None, [], 0, None, None, None)]
    return walk.parts


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """(stem, xml) of each file; unreadable files are skipped."""
    files = spark.read.option("ignoreCorruptFiles", True).text(path, wholetext=True)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+?)(\.[^./]*)?$", 1)
    return files.select(stem.alias("stem"), F.col("value").alias("xml"))


def article_parts(articles: DataFrame) -> DataFrame:
    """(stem, parts) of (stem, xml) rows. A malformed or missing article has one 'error' part.

    Batches of articles are bounded by bytes on their way in and by rows on their way out.
    """
    schema = articles.select("stem", F.lit(None).cast(PARTS).alias("parts")).schema
    arrow = to_arrow_schema(schema)
    names = [f.name for f in arrow.field("parts").type.value_type]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in (batch.slice(i, 50) for i in range(0, batch.num_rows, 50)):
                parts = [[dict(zip(names, p, strict=True)) for p in _parse(xml)] for xml in some.column("xml").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("stem").cast(arrow.field("stem").type), pa.array(parts, arrow.field("parts").type)], schema=arrow)

    return articles.select("stem", "xml").mapInArrow(parse, schema)


def _of_kind(kind: str) -> Column:
    return F.filter("parts", lambda p: p["kind"] == kind)


def _value(kind: str) -> Column:
    return F.get(_of_kind(kind), 0)["value"]


def _with_head(parts: DataFrame) -> DataFrame:
    root = _value("root")
    years = _of_kind("year")
    year = lambda when: F.get(F.filter(years, lambda p: p["attr"] == when), 0)["value"]
    return parts.withColumns({
        "format": F.when(root.isin(*JATS_ROOTS), "jats").when(root.isNotNull(), "elsevier"),
        "document_name": F.coalesce(blank_to_null(collapse(_value("title"))), F.col("stem")),
        "abstract": F.coalesce(collapse(_value("abstract")), F.lit("")),
        "pub_year": F.coalesce(year("epub"), year("ppub"), year("collection"), F.get(years, 0)["value"]),
    })


def parse_report(parts: DataFrame) -> DataFrame:
    """One row per article: format by root tag and the error of the ones that could not be read."""
    return _with_head(parts).select("stem", "format", _value("error").alias("error"))


def article_head(parts: DataFrame) -> DataFrame:
    """(stem, format, document_name, abstract, pub_year). An article without title has its stem."""
    head = _with_head(parts).select("stem", "format", "document_name", "abstract", "pub_year")
    return head.filter(F.col("format").isNotNull())


def _with_items(parts: DataFrame) -> DataFrame:
    """Adds ``items``: (kind, content, chapter, section_title) of paragraphs and tables."""
    head = _with_head(parts).filter(F.col("format").isNotNull())
    jats = F.col("format") == "jats"

    def opens(title: Column) -> Column:
        return F.when(jats, is_top_level(title, False)).otherwise(is_top_level(title, True))

    def item(p: Column) -> Column:
        named = F.filter(p["titles"], lambda t: t != "")
        table = p["kind"] == "table"
        content = F.when(table, table_text(p["cells"], p["label"], p["caption"])).otherwise(collapse(p["value"]))
        last = lambda titles: F.coalesce(F.try_element_at(titles, F.lit(-1)), F.lit(BODY))
        return F.struct(
            F.when(table, "table").otherwise("text").alias("kind"), content.alias("content"),
            last(F.filter(named, opens)).alias("chapter"), last(named).alias("section_title"), (p["kind"] == "loose").alias("loose"),
        )

    body = F.filter("parts", lambda p: p["kind"].isin("text", "table", "loose") & ~F.exists(p["titles"], is_stop_section))
    items = head.withColumn("items", F.transform(body, item))
    # paragraphs outside sections may repeat the abstract
    wanted = F.filter("items", lambda i: (i["content"] != "") & ~(i["loose"] & (i["content"] == F.col("abstract"))))
    return items.withColumn("items", wanted).drop("parts")


def article_items(parts: DataFrame) -> DataFrame:
    """Paragraphs and tables with chapter and section; stop sections and empty tables are gone."""
    return unnest(_with_items(parts), "items", ["stem"]).drop("loose")


def article_chunks(parts: DataFrame) -> DataFrame:
    """Corpus chunks of articles: the abstract first, then packed sections and tables.

    Everything happens inside the article's row, so no article is shuffled.
    """
    packed = pack_arrays(_with_items(parts), "items")
    has_abstract = F.col("abstract") != ""
    abstract = F.struct(
        F.lit(0).cast("long").alias("chunk"), F.lit("text").alias("content_type"), F.lit("Abstract").alias("chapter"),
        F.lit("Abstract").alias("section_title"), F.col("abstract").alias("text"), F.lit(1).cast("long").alias("n_elements"),
    )
    every = F.when(has_abstract, F.concat(F.array(abstract), F.col("chunks"))).otherwise(F.col("chunks"))
    rows = unnest(packed.withColumn("chunks", every), "chunks", ["stem", "format", "document_name", "pub_year", "abstract"])
    number = F.col("chunk") + (F.col("abstract") != "").cast("long")
    table = F.col("content_type") == "table"
    prefix = F.when(F.col("format") == "jats", "pmc").otherwise("xml")
    kind = F.when(table, "tbl").otherwise("chunk")
    body = F.when(table, F.concat(F.lit("[TABLE]\n"), F.col("text"))).otherwise(F.col("text"))
    return rows.select(
        "stem", "content_type", F.concat_ws("_", prefix, slug(F.col("stem")), kind, F.format_string("%04d", number)).alias("id"),
        "document_name", F.when(F.col("format") == "jats", F.col("pub_year")).alias("pub_year"), "chapter", "section_title",
        F.lit(None).cast("int").alias("page_number"), F.lit("N/A").alias("page_range"),
        F.concat(provenance_header(F.col("document_name"), F.col("chapter"), F.col("section_title")), body).alias("text"),
    )


def section_texts(parts: DataFrame) -> DataFrame:
    """(stem, section, title, text, abstract) of each section with paragraphs; nothing is left out.

    The abstract loses a leading 'ABSTRACT' label.
    """
    texts = F.filter("parts", lambda p: (p["kind"] == "text") & (p["section"] > 0))
    abstract = F.regexp_replace(_value("abstract"), r"(?i)\A\s*ABSTRACT\s*", "")
    placed = F.transform(texts, lambda p, i: F.struct(p["section"].alias("section"), i.alias("i"), p["value"].alias("value"), p["titles"].alias("titles")))
    # sorted, the texts of a section are one run, so each is copied once
    rows = parts.select("stem", abstract.alias("abstract"), F.array_sort(placed).alias("_texts"))
    begins = F.transform("_texts", lambda p, i: F.when((i == 0) | (p["section"] != F.get("_texts", i - 1)["section"]), i + 1))
    rows = rows.withColumn("_begins", F.array_compact(begins))
    until = lambda k: F.coalesce(F.get("_begins", k + 1), F.size("_texts") + 1)
    own = rows.withColumn("own", F.explode(F.transform("_begins", lambda at, k: F.slice("_texts", at, until(k) - at))))
    first = F.get("own", 0)
    return own.select("stem", first["section"].alias("section"), F.element_at(first["titles"], -1).alias("title"), F.array_join(F.col("own.value"), "\n\n").alias("text"), "abstract")


def abstract_by_pattern(articles: DataFrame, patterns: tuple[str, ...] = fixed.ABSTRACT_PATTERNS,
                        least: int = fixed.MIN_ABSTRACT_CHARS) -> DataFrame:
    """Abstract of the first pattern that matches, when long enough."""
    found = F.coalesce(*[F.when(F.col("xml").rlike(p), clean(F.regexp_extract("xml", p, 1))) for p in patterns])
    return articles.select("stem", found.alias("abstract")).filter(F.length("abstract") > least)


def title_by_pattern(articles: DataFrame, patterns: tuple[str, ...] = fixed.TITLE_PATTERNS) -> DataFrame:
    """Raw title of the first pattern that matches."""
    found = F.coalesce(*[F.when(F.col("xml").rlike(p), F.regexp_extract("xml", p, 1)) for p in patterns])
    return articles.select("stem", found.alias("title"))

