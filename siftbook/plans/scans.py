"""Sources and sinks over data derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftbook.functions import fixed
from siftbook.functions.text import title_key
from siftbook.operators.ranking import latest_per_key, sample_per_category
from siftbook.operators.lookups import unfinished
from siftbook.plans import inputs as I
from siftbook.plans.inputs import q, sql_collapse, sql_rank, sql_title_key, with_
from siftbook.plans.registry import Tables, query
from siftbook.session import scratch_path, stage
from siftbook.sources.concatenated import read_concatenated
from siftbook.sources import articles as A
from siftbook.sources import files as S
from siftbook.sources import landed as L

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
PAIR = "messages array<struct<role:string,content:string>>, source_chunk_id string, category string"


@query("a1_jsonl_scan", "SELECT doc_id, lang, md5(text) AS digest FROM documents")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "a1")
    S.write_jsonl(t.documents, path)
    return S.read_jsonl(t.spark, path, DOCUMENT).select("doc_id", "lang", F.md5("text").alias("digest"))


@query("a2_tolerant_jsonl_scan", """SELECT count(*) FILTER (WHERE event_type <> 'error') AS n_good, count(*) FILTER (WHERE event_type = 'error') AS n_corrupt,
    sum(CAST(json_extract(props, '$.k') AS BIGINT)) FILTER (WHERE event_type <> 'error')::BIGINT AS k FROM events""")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "a2")
    whole = F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "k": '), F.get_json_object("props", "$.k"), F.lit("}"))
    # error events are cut off in the middle of the record
    line = F.when(F.col("event_type") == "error", F.regexp_replace(whole, ".{4}$", "")).otherwise(whole)
    t.events.select(line).write.text(path)
    read = S.read_jsonl_tolerant(t.spark, path, "event_id long, k long")
    good = F.col(S.CORRUPT).isNull()
    return read.agg(F.count_if(good).alias("n_good"), F.count_if(~good).alias("n_corrupt"), F.sum(F.when(good, F.col("k"))).alias("k"))


def _pair_record(t: Tables) -> DataFrame:
    turn = lambda role: F.struct(F.lit(role).alias("role"), F.col(role).alias("content"))
    return I.pairs(t).select("conv_id", F.struct(F.array(turn("user"), turn("assistant")).alias("messages"), "source_chunk_id", "category").alias("r"))


@query("a3_concatenated_json_scan", with_("pairs") + 'SELECT source_chunk_id, category, md5("user") AS u, md5(assistant) AS a FROM pairs')
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "a3")
    _pair_record(t).select(F.to_json("r", {"pretty": "true"})).write.text(path)
    read = read_concatenated(t.spark, path, PAIR)
    return read.select("source_chunk_id", "category", F.md5(read.messages[0].content).alias("u"), F.md5(read.messages[1].content).alias("a"))


@query("a4_json_array_scan", "SELECT conv_id, turn, role, conv_id // 64 AS file FROM conversations")
def _(t: Tables) -> DataFrame:
    # a file is one short array: the turns of 64 conversations
    path = scratch_path(t.spark, "a4")
    file = F.floor(F.col("conv_id") / 64).alias("file")
    one = t.conversations.groupBy(file).agg(F.to_json(F.collect_list(F.struct("conv_id", "turn", "role"))).alias("value"))
    one.write.partitionBy("file").text(path)
    return S.read_json_array(t.spark, path, "conv_id long, turn long, role string, file long")


@query("a5_shard_glob_scan", "SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "a5")
    t.documents.withColumn("shard", F.col("lang")).write.partitionBy("shard").json(path)
    return S.read_jsonl(t.spark, f"{path}/shard=*", DOCUMENT).groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("a6_tsv_scan", "SELECT CAST(p_partkey AS VARCHAR) AS pmid, p_name AS title, p_brand AS authors FROM part")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "a6")
    S.write_tsv(t.part.select(F.col("p_partkey").alias("pmid"), F.col("p_name").alias("title"), F.col("p_brand").alias("authors")), path)
    return S.read_tsv(t.spark, path, "pmid string, title string, authors string")


@query("a8_jsonl_sink", "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "a8")
    S.write_jsonl(t.conversations.filter("turn = 0"), path)
    S.write_jsonl(t.conversations, path)
    read = S.read_jsonl(t.spark, path, "conv_id long, turn long, role string, text string")
    return read.select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("a9_jsonl_append", with_("pairs") + "SELECT conv_id, count(*) AS n FROM pairs GROUP BY conv_id")
def _(t: Tables) -> DataFrame:
    path, schema = scratch_path(t.spark, "a9"), "conv_id long, category string"
    work = I.pairs(t).select("conv_id", "category")
    S.write_jsonl(work.filter(F.col("category") == I.CATEGORIES[0]), path, "append")
    S.write_jsonl(unfinished(work, S.read_jsonl(t.spark, path, schema), "conv_id"), path, "append")
    return S.read_jsonl(t.spark, path, schema).groupBy("conv_id").agg(F.count("*").alias("n"))


@query("a10_score_store", "SELECT event_id, event_type, value AS score FROM events")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "a10")
    S.write_scores(t.events, path, "event_id", "value")
    scores = t.spark.read.parquet(path).withColumnRenamed("value", "score")
    return t.events.select("event_id", "event_type").join(scores, "event_id")


# -- article XML -----------------------------------------------------------------------------

TITLES = ("Introduction", "Materials and Methods", "Assay", "Results", "References")
NAMESPACES = 'xmlns:ce="http://www.elsevier.com/xml/common/dtd" xmlns:c="http://www.elsevier.com/xml/common/cals/dtd" xmlns:dc="http://purl.org/dc/elements/1.1/"'


def _escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _tag(name: str, *inner: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), *inner, F.lit(f"</{name.split()[0]}>"))


def _body(names: dict[str, str], table: Column) -> Column:
    """Three lines per section, titles in turn, a table in 'Results'; the first line is the abstract."""
    lines, groups = F.split("text", "\n"), F.ceil((F.size(F.split("text", "\n")) - 1) / 3).cast("int")
    titles = F.array(*[F.lit(x) for x in TITLES])

    def section(g: Column) -> Column:
        paragraphs = F.array_join(F.transform(F.slice(lines, g * 3 + 2, 3), lambda x: _tag(names["p"], _escape(x))), "")
        title = F.element_at(titles, F.pmod(g, F.lit(5)) + 1)
        return _tag(names["sec"], _tag(names["title"], title), paragraphs, F.when(title == "Results", table).otherwise(""))

    sections = F.transform(F.sequence(F.lit(0), groups - 1), section)
    return F.when(groups > 0, F.array_join(sections, "")).otherwise("")


def _jats(wrap: bool = False) -> Column:
    table = F.concat(
        F.lit("<table-wrap><label>Table 1.</label><caption><p>Where\n it is from</p></caption><table><tr><th>lang</th><th>source</th></tr><tr><td>"),
        F.col("lang"), F.lit("</td><td> "), F.col("source"), F.lit("</td></tr></table></table-wrap>"),
    )
    front = _tag("front", _tag("title-group", _tag("article-title", F.lit("On <i>"), F.col("source"), F.lit("</i> and\n"), F.col("lang"))),
                 F.lit('<pub-date pub-type="ppub"><year>2023</year></pub-date>'),
                 F.when(F.col("lang") == "en", '<pub-date pub-type="epub"><year>2024</year></pub-date>').otherwise(""),
                 _tag("abstract", F.lit("ABSTRACT"), _escape(F.substring_index("text", "\n", 1))))
    article = _tag("article", front, _tag("body", _body({"p": "p", "sec": "sec", "title": "title"}, table)))
    return _tag("pmc-articleset", article) if wrap else article


def _elsevier() -> Column:
    table = F.concat(
        F.lit("<ce:table><ce:label>Table 1.</ce:label><ce:caption><ce:simple-para>Where\n it is from</ce:simple-para></ce:caption>"
              "<c:tgroup><c:row><c:entry>lang</c:entry><c:entry>source</c:entry></c:row><c:row><c:entry>"),
        F.col("lang"), F.lit("</c:entry><c:entry> "), F.col("source"), F.lit("</c:entry></c:row><c:row><c:entry/></c:row></c:tgroup></ce:table>"),
    )
    names = {"p": "ce:para", "sec": "ce:section", "title": "ce:section-title"}
    head = F.concat(_tag("dc:title", F.lit("On "), F.col("source"), F.lit(" and "), F.col("lang")), _tag("dc:description", _escape(F.substring_index("text", "\n", 1))))
    # French articles have no sections, only loose paragraphs
    loose = F.array_join(F.transform(F.split("text", "\n"), lambda x: _tag("ce:simple-para", _escape(x))), "")
    body = F.when(F.col("lang") == "fr", loose).otherwise(_tag("ce:sections", _body(names, table)))
    return F.concat(F.lit(f"<full-text {NAMESPACES}>"), head, body, F.lit("</full-text>"))


def _articles(t: Tables, xml: Column) -> DataFrame:
    return t.documents.select(F.col("doc_id").cast("string").alias("stem"), xml.alias("xml"))


_TITLE_SQL = f"{I.sql_list(TITLES)}[((no - 2) // 3) % 5 + 1]"
_TOP_SQL = f"CASE WHEN regexp_matches(title, {q(fixed.TOP_LEVEL_SECTION)}) THEN title ELSE 'Body' END"
# every paragraph outside 'References', and one table per 'Results' section
ARTICLE_ITEMS = f"""SELECT doc_id, no, 'text' AS kind, {sql_collapse('line')} AS content, {_TOP_SQL} AS chapter, title AS section_title
    FROM (SELECT doc_id, no, line, {_TITLE_SQL} AS title FROM lines WHERE no >= 2) WHERE title <> 'References' AND {sql_collapse('line')} <> ''
    UNION ALL SELECT doc_id, max(no) + 0.5, 'table', 'Table 1. | Where it is from' || chr(10) || 'lang' || chr(9) || 'source' || chr(10) || any_value(lang) || chr(9) || any_value(source), 'Results', 'Results'
    FROM (SELECT l.*, d.lang, d.source, {_TITLE_SQL} AS title FROM lines l JOIN documents d USING (doc_id) WHERE no >= 2) WHERE title = 'Results' GROUP BY doc_id, (no - 2) // 3"""


def sql_pack(items: str, limit: int = fixed.MAX_SECTION_CHARS) -> dict[str, str]:
    """CTEs that number the chunks of (doc_id, no, kind, content, chapter, section_title)."""
    same = "chapter = lag(chapter) OVER w AND section_title = lag(section_title) OVER w"
    opens = f"(w.closed OR i.fresh OR i.alone OR w.used + i.size > {limit})"
    return {
        "marked": f"""SELECT *, row_number() OVER w AS pos, length(content) AS size, NOT coalesce({same}, false) AS fresh, kind = 'table' AS alone
            FROM {items} WINDOW w AS (PARTITION BY doc_id ORDER BY no)""",
        "walk": f"""SELECT doc_id, pos, 1 AS chunk, size AS used, alone AS closed FROM marked WHERE pos = 1
            UNION ALL SELECT i.doc_id, i.pos, w.chunk + CAST({opens} AS INT), CASE WHEN {opens} THEN i.size ELSE w.used + i.size END, i.alone
            FROM walk w JOIN marked i ON i.doc_id = w.doc_id AND i.pos = w.pos + 1""",
        "packed": """SELECT doc_id, chunk, any_value(kind) AS content_type, any_value(chapter) AS chapter, any_value(section_title) AS section_title,
            string_agg(content, chr(10) || chr(10) ORDER BY pos) AS text, count(*) AS n_elements FROM marked JOIN walk USING (doc_id, pos) GROUP BY doc_id, chunk""",
    }


_ABSTRACT_SQL = "'ABSTRACT' || split_part(text, chr(10), 1)"


@query("a11_jats_chunks", with_("lines", items=ARTICLE_ITEMS, **sql_pack("items")).replace("WITH ", "WITH RECURSIVE ", 1) + f"""
    SELECT CAST(doc_id AS VARCHAR) AS stem, content_type, 'pmc_' || doc_id || CASE content_type WHEN 'table' THEN '_tbl_' ELSE '_chunk_' END || format('{{:04d}}', chunk + 1) AS id,
    chapter, section_title, md5('[Document: On ' || source || ' and ' || lang || ' | Chapter: ' || chapter || ' | Section: ' || section_title || ']' || chr(10) || chr(10)
    || CASE content_type WHEN 'table' THEN '[TABLE]' || chr(10) ELSE '' END || packed.text) AS digest, CASE lang WHEN 'en' THEN '2024' ELSE '2023' END AS pub_year
    FROM (SELECT * FROM packed UNION ALL SELECT doc_id, 0, 'text', 'Abstract', 'Abstract', {sql_collapse(_ABSTRACT_SQL)}, 1 FROM documents) packed JOIN documents USING (doc_id)""")
def _(t: Tables) -> DataFrame:
    out = A.article_chunks(A.article_parts(_articles(t, _jats())))
    return out.select("stem", "content_type", "id", "chapter", "section_title", F.md5("text").alias("digest"), "pub_year")


@query("a12_elsevier_items", with_("lines", items=ARTICLE_ITEMS) + f"""
    SELECT CAST(doc_id AS VARCHAR) AS stem, kind, content, chapter, section_title FROM items JOIN documents USING (doc_id) WHERE lang <> 'fr'
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'text', {sql_collapse('line')}, 'Body', 'Body' FROM lines JOIN documents USING (doc_id)
    WHERE lang = 'fr' AND {sql_collapse('line')} <> '' AND {sql_collapse('line')} <> {sql_collapse("split_part(text, chr(10), 1)")}""")
def _(t: Tables) -> DataFrame:
    return A.article_items(A.article_parts(_articles(t, _elsevier()))).select("stem", "kind", "content", "chapter", "section_title")


def _mixed(t: Tables) -> DataFrame:
    """German articles miss their last tag, Spanish ones come in a set, French ones in the other dialect."""
    xml = (
        F.when(F.col("lang") == "de", F.regexp_replace(_jats(), "</article>$", "")).when(F.col("lang") == "es", _jats(wrap=True))
        .when(F.col("lang") == "fr", _elsevier()).otherwise(_jats())
    )
    return _articles(t, xml)


@query("a13_format_dispatch", """SELECT CAST(doc_id AS VARCHAR) AS stem, CASE lang WHEN 'fr' THEN 'elsevier' ELSE 'jats' END AS format,
    'On ' || source || ' and ' || lang AS document_name FROM documents WHERE lang <> 'de'""")
def _(t: Tables) -> DataFrame:
    return A.article_head(A.article_parts(_mixed(t))).select("stem", "format", "document_name")


@query("a14_error_isolation", """SELECT CASE lang WHEN 'de' THEN NULL WHEN 'fr' THEN 'elsevier' ELSE 'jats' END AS format, lang = 'de' AS failed, count(*) AS n
    FROM documents GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    report = A.parse_report(A.article_parts(_mixed(t)))
    return report.groupBy("format", F.col("error").isNotNull().alias("failed")).agg(F.count("*").alias("n"))


@query("a15_section_reader", with_("lines") + f"""SELECT CAST(doc_id AS VARCHAR) AS stem, (no - 2) // 3 + 1 AS section, any_value({_TITLE_SQL}) AS title,
    string_agg({I.sql_strip('line')}, chr(10) || chr(10) ORDER BY no) AS text, any_value(abstract) AS abstract
    FROM lines JOIN (SELECT doc_id, {I.sql_strip("split_part(text, chr(10), 1)")} AS abstract FROM documents) USING (doc_id)
    WHERE no >= 2 AND {I.sql_strip('line')} <> '' GROUP BY doc_id, (no - 2) // 3""")
def _(t: Tables) -> DataFrame:
    return A.section_texts(A.article_parts(_articles(t, _jats())))


def _pages(t: Tables) -> DataFrame:
    return t.pages.select(F.col("page_id").cast("string").alias("stem"), F.col("html").alias("xml"))


# pages without a note in front stand for articles without a description
_NOTE, _ARTICLE = r'(?s)<div class="ad">(.*?)</div>', r"(?s)<article[^>]*>(.*?)</article>"
_found = lambda p: f"CASE WHEN regexp_matches(html, {q(p)}) THEN {sql_collapse(I.sql_tags(f'regexp_extract(html, {q(p)}, 1)'))} END"


@query("a16_abstract_by_pattern", f"SELECT stem, md5(abstract) AS digest, length(abstract) AS n FROM (SELECT CAST(page_id AS VARCHAR) AS stem, coalesce({_found(_NOTE)}, {_found(_ARTICLE)}) AS abstract FROM pages) WHERE length(abstract) > 80")
def _(t: Tables) -> DataFrame:
    found = A.abstract_by_pattern(_pages(t), (_NOTE, _ARTICLE))
    return found.select("stem", F.md5("abstract").alias("digest"), F.length("abstract").alias("n"))


@query("a17_title_by_pattern", f"""SELECT title_key, min(page_id) AS first_page, count(*) AS n FROM (SELECT page_id, {sql_title_key("regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)")} AS title_key FROM pages)
    WHERE title_key <> '' GROUP BY title_key""")
def _(t: Tables) -> DataFrame:
    titles = A.title_by_pattern(_pages(t), (r"(?s)<dc:title[^>]*>(.*?)</dc:title>", r"(?s)<title[^>]*>(.*?)</title>"))
    keyed = titles.select(F.col("stem").cast("long").alias("page_id"), title_key(F.col("title")).alias("title_key")).filter("title_key <> ''")
    return keyed.groupBy("title_key").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n"))


# -- landed responses ------------------------------------------------------------------------

@query("a18_work_normaliser", with_("page_parts") + """SELECT page_id, CASE WHEN host = '' THEN NULL ELSE '10.1/' || lower(host) END AS doi, nullif(number, '') AS pmid,
    CASE WHEN lang = 'en' THEN 'PMC' || number END AS pmcid, title, CASE lang WHEN 'de' THEN '' ELSE host || ', ' || lang END AS authors,
    CASE lang WHEN 'fr' THEN '' ELSE host END AS journal, CAST(2020 + page_id % 6 AS BIGINT) AS pub_year FROM page_parts""")
def _(t: Tables) -> DataFrame:
    author = lambda c: F.struct(F.struct(F.col(c).alias("display_name")).alias("author"))
    work = F.struct(
        F.struct(
            F.concat(F.lit("https://doi.org/10.1/"), F.upper("host")).alias("doi"), F.concat(F.lit("https://pubmed.example/"), F.col("number"), F.lit("/")).alias("pmid"),
            F.when(F.col("lang") == "en", F.concat(F.lit("https://www.example/articles/"), F.col("number"))).alias("pmcid"),
        ).alias("ids"),
        F.when(F.col("lang") != "de", F.array(author("host"), author("lang"))).alias("authorships"),
        F.when(F.col("lang") != "fr", F.struct(F.struct(F.col("host").alias("display_name")).alias("source"))).alias("primary_location"),
        "title", (2020 + F.col("page_id") % 6).alias("publication_year"),
    )
    landed = I.page_parts(t).select("page_id", F.to_json(work).alias("value"))
    return L.normalise_work(landed, "value").select("page_id", "doi", "pmid", "pmcid", "title", "authors", "journal", "pub_year")


@query("a19_summary_normaliser", with_("page_parts") + f"""SELECT CAST(page_id AS VARCHAR) AS uid, regexp_replace({I.sql_strip('title')}, '\\.+\\z', '') AS title,
    host || '; ' || lang AS authors, {sql_title_key("regexp_replace(" + I.sql_strip('title') + ", '\\.+\\z', '')")} AS title_key FROM page_parts""")
def _(t: Tables) -> DataFrame:
    author = lambda c: F.struct(F.col(c).alias("name"))
    doc = F.to_json(F.struct("title", F.array(author("host"), author("lang")).alias("authors")))
    uid = F.col("page_id").cast("string")
    value = F.concat(F.lit('{"result": {"uids": ["'), uid, F.lit('"], "'), uid, F.lit('": '), doc, F.lit("}}"))
    return L.summary_documents(I.page_parts(t).select(value.alias("value")), "value")


@query("a20_condition_folder", with_("scored") + """SELECT cond, id, is_correct, CASE WHEN cond = 'tuned' THEN NULL ELSE raw_output END AS raw_output FROM scored""")
def _(t: Tables) -> DataFrame:
    folder = scratch_path(t.spark, "a20")
    graded = I.scored(t)
    for cond in I.CONDITIONS:
        rows = graded.filter(F.col("cond") == cond)
        S.write_jsonl(rows.select("id", "predicted", "is_correct"), f"{folder}/{cond}_scored.jsonl")
        if cond != "tuned":  # a condition may lack raw outputs
            S.write_jsonl(rows.select("id", "raw_output"), f"{folder}/{cond}.jsonl")
    return S.read_conditions(t.spark, folder, "id string, predicted string, is_correct boolean", "id string, raw_output string").select("cond", "id", "is_correct", "raw_output")


@query("a21_sample_report", with_("pairs") + f"""SELECT category, pick, md5(CASE WHEN pick = 1 THEN repeat('=', 80) || chr(10) || 'CATEGORY: ' || category || '  (' || total || ' total in dataset)' || chr(10) || repeat('=', 80) || chr(10) || chr(10) ELSE '' END
    || '--- example ' || pick || ' (source: ' || source_chunk_id || ') ---' || chr(10) || 'USER:' || chr(10) || "user" || chr(10) || chr(10) || 'ASSISTANT:' || chr(10) || assistant || chr(10) || chr(10)) AS digest
    FROM (SELECT *, {sql_rank('conv_id', 7, 'category')} AS pick, count(*) OVER (PARTITION BY category) AS total FROM pairs) WHERE pick <= 25""")
def _(t: Tables) -> DataFrame:
    sample = sample_per_category(I.pairs(t), "category", ["conv_id"], 25)
    report = S.sample_report(sample, F.col("category"), F.col("total"), F.col("pick"), F.col("source_chunk_id"), F.col("user"), F.col("assistant"))
    S.write_text_report(report, scratch_path(t.spark, "a21"), ["category", "pick"])
    return report.select("category", "pick", F.md5("block").alias("digest"))


def _prompt(user: str = "user", assistant: str = "assistant") -> Column:
    return F.concat(F.lit("Question:\n"), F.col(user), F.lit("\n\nAnswer:\n"), F.col(assistant))


@query("a22_batch_requests", with_("pairs") + """SELECT source_chunk_id AS custom_id, 'judge-1' AS model, '100' AS max_tokens,
    md5('Question:' || chr(10) || "user" || chr(10) || chr(10) || 'Answer:' || chr(10) || assistant) AS digest FROM pairs""")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "a22")
    L.batch_requests(I.pairs(t), "source_chunk_id", "Grade the answer.", _prompt(), "judge-1").write.text(path)
    value = lambda p: F.get_json_object("value", p)
    return t.spark.read.text(path).select(
        value("$.custom_id").alias("custom_id"), value("$.body.model").alias("model"), value("$.body.max_tokens").alias("max_tokens"),
        F.md5(value("$.body.messages[1].content")).alias("digest"),
    )


def responses(t: Tables) -> DataFrame:
    """Response lines for the base condition: one in sixteen failed, one in sixteen is cut off."""
    s = I.scored(t).filter("cond = 'base'")
    scores = F.to_json(F.struct("predicted", *fixed.METRICS))
    key = I.digit(F.concat(F.lit("r"), F.col("id")))
    content = F.when(key == 1, F.left(scores, F.length(scores) - 3)).otherwise(scores)
    body = F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices"))
    line = F.struct(F.col("id").alias("custom_id"), F.when(key == 0, "rate limit").alias("error"), F.when(key != 0, F.struct(body.alias("body"))).alias("response"))
    return stage(s.select(F.to_json(line).alias("value")), "responses")


_RESPONSE_KEY = I.sql_digit("'r' || id")
_METRIC_LIST = ", ".join(f"CAST({m} AS BIGINT) AS {m}" for m in fixed.METRICS)


@query("a23_batch_responses", with_("scored") + f"""SELECT id AS custom_id, CASE {_RESPONSE_KEY} WHEN 0 THEN 'error' WHEN 1 THEN 'malformed' END AS problem,
    CASE WHEN {_RESPONSE_KEY} > 1 THEN factual_accuracy END AS factual_accuracy FROM scored WHERE cond = 'base'""")
def _(t: Tables) -> DataFrame:
    read = L.batch_scores(responses(t))
    return read.select("custom_id", "problem", F.when(F.col("problem").isNull(), F.col("factual_accuracy")).alias("factual_accuracy"))


@query("a24_review_export", """WITH r AS (SELECT user_id, event_type, arg_max(props, event_id) AS notes, max(event_id) AS ts FROM events GROUP BY ALL)
    SELECT user_id AS qid, '{' || string_agg('"' || event_type || '":{"verdict":"good","notes":"' || json_extract_string(notes, '$.k') || '","ts":"' || ts || '"}', ',' ORDER BY event_type) || '}' AS reviews FROM r GROUP BY user_id""")
def _(t: Tables) -> DataFrame:
    last = latest_per_key(t.events, ["user_id", "event_type"], ["event_id"])
    reviews = last.select(
        F.col("user_id").alias("qid"), F.col("event_type").alias("reviewer"), F.lit("good").alias("verdict"),
        F.get_json_object("props", "$.k").alias("notes"), F.col("event_id").cast("string").alias("ts"),
    )
    return L.nested_reviews(reviews)
