"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftbook.functions import dates, fixed
from siftbook.functions import text as X
from siftbook.functions.layout import chapter_of
from siftbook.operators import dedup, evaluation, lookups, metric_index, packing, pairs, ranking, retrieval
from siftbook.plans import inputs as I
from siftbook.plans.inputs import q, sql_order, sql_rank, sql_title_key, with_
from siftbook.plans.projections import entity_pairs, sql_entities, ENTITY_PAIRS_SQL
from siftbook.plans.registry import Tables, query
from siftbook.session import stage
from siftbook.plans.scans import _METRIC_LIST, responses, sql_pack
from siftbook.sources.landed import batch_scores, scored_responses


def _tagged_labels(t: Tables) -> DataFrame:
    return t.labels.select(I.tag("chunk_", "doc_id").alias("id"), "quality")


@query("d1_pair_source_lookup", """SELECT 'chunk_' || l.doc_id AS id, CAST(quality AS BIGINT) AS quality, d.source AS document_name, d.doc_id IS NULL AS missing
    FROM labels l LEFT JOIN (SELECT * FROM documents WHERE lang <> 'de') d USING (doc_id)""")
def _(t: Tables) -> DataFrame:
    known = t.documents.filter("lang <> 'de'").select(I.tag("chunk_", "doc_id").alias("id"), F.col("source").alias("document_name"))
    return lookups.with_source(_tagged_labels(t), known, "id")


@query("d2_wanted_chunks", """WITH c AS (SELECT 'chunk_' || (doc_id // 2) AS id, doc_id, source FROM documents)
    SELECT id, arg_max(source, doc_id) AS source, max(doc_id) AS doc_id, count(*) AS n_copies FROM c WHERE id IN (SELECT 'chunk_' || doc_id FROM labels) GROUP BY id""")
def _(t: Tables) -> DataFrame:
    # two documents share each id, as when ids only count inside a file
    chunks = t.documents.select(F.concat(F.lit("chunk_"), F.floor(F.col("doc_id") / 2)).alias("id"), "doc_id", "source")
    return lookups.wanted_chunks(chunks, _tagged_labels(t).withColumnRenamed("id", "pair_id"), "id", "pair_id", "doc_id")


@query("d3_results_with_questions", with_("answers") + "SELECT a.cond, a.id, q.topic FROM answers a JOIN (SELECT * FROM questions WHERE document_name <> 'src3') q ON a.id = q.id")
def _(t: Tables) -> DataFrame:
    known = I.questions(t).filter("document_name <> 'src3'").select("id", "topic")
    return I.answers(t).select("cond", "id").join(known, "id").select("cond", "id", "topic")


@query("d4_resume_anti_join", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t: Tables) -> DataFrame:
    return lookups.unfinished(t.documents.select("doc_id", "source"), t.labels, "doc_id")


@query("d5_known_title_anti_join", with_("page_parts", keyed=f"SELECT page_id, lang, {sql_title_key('title')} AS title_key FROM page_parts") +
       "SELECT page_id, title_key FROM keyed WHERE lang <> 'en' AND (title_key = '' OR title_key NOT IN (SELECT title_key FROM keyed WHERE lang = 'en'))")
def _(t: Tables) -> DataFrame:
    keyed = I.page_parts(t).select("page_id", "lang", X.title_key(F.col("title")).alias("title_key"))
    return dedup.not_known(keyed.filter("lang <> 'en'").drop("lang"), keyed.filter("lang = 'en'"), "title_key")


def article_keys(t: Tables) -> DataFrame:
    p = I.page_parts(t)
    return p.select("page_id", F.concat("lang", F.lit("/"), "number").alias("doi"), F.when(F.col("lang") == "en", F.col("host")).alias("pmid"), X.title_words(F.col("title")).alias("norm_title"))


ARTICLE_KEYS_SQL = """SELECT page_id, list_filter(['doi:' || lang || '/' || number, CASE WHEN lang = 'en' THEN 'pmid:' || host END,
    'norm_title:' || nullif(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), '')], lambda x: x IS NOT NULL) AS names, row_number() OVER (ORDER BY page_id) AS pos FROM page_parts"""


@query("d6_any_key_duplicates", with_("page_parts", k=ARTICLE_KEYS_SQL, walk="""SELECT 0::BIGINT AS pos, 0::BIGINT AS page_id, false AS is_copy, []::VARCHAR[] AS seen
    UNION ALL SELECT k.pos, k.page_id, len(list_intersect(w.seen, k.names)) > 0, CASE WHEN len(list_intersect(w.seen, k.names)) > 0 THEN w.seen ELSE list_concat(w.seen, k.names) END
    FROM walk w JOIN k ON k.pos = w.pos + 1""").replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT page_id, is_copy FROM walk WHERE pos > 0")
def _(t: Tables) -> DataFrame:
    return dedup.first_seen_by_any_key(article_keys(t), "page_id", ["doi", "pmid", "norm_title"]).select("page_id", "is_copy")


@query("d7_paired_outputs", "SELECT a.conv_id, a.turn, md5(a.text) AS a, md5(b.text) AS b FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1")
def _(t: Tables) -> DataFrame:
    c = t.conversations
    first = c.select("conv_id", "turn", F.md5("text").alias("output"))
    second = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.md5("text").alias("output"))
    return lookups.pair_outputs(first, second, ["conv_id", "turn"])


_DISTANCE = "round(greatest(list_sum(list_transform(list_zip(q.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 0), 9)"
VECTORS_SQL = "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"


def sql_hits(k: int) -> str:
    return f"""SELECT query_id, neighbour_id, distance, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS place
        FROM (SELECT q.vec_id AS query_id, b.vec_id AS neighbour_id, {_DISTANCE} AS distance FROM vectors q JOIN vectors b ON q.vec_id <> b.vec_id)) WHERE place <= {k}"""


@query("d8_nearest_other", with_(vectors=VECTORS_SQL, hits=sql_hits(1)) + "SELECT query_id, neighbour_id, round(1 - distance / 2, 6) AS similarity FROM hits")
def _(t: Tables) -> DataFrame:
    hits = retrieval.nearest(t.embeddings, t.embeddings, "vec_id", "embedding", 1, exclude_self=True)
    # unit vectors: inner product from squared distance
    return hits.select("query_id", "neighbour_id", F.round(1 - F.col("distance") / 2, 6).alias("similarity"))


@query("d9_one_shot_context", with_("pairs", vectors=VECTORS_SQL, hits=sql_hits(1)) + """SELECT h.query_id, h.neighbour_id, md5('user:' || n."user" || '|assistant:' || n.assistant || '|user:' || s."user" || '|assistant:' || s.assistant) AS messages
    FROM hits h JOIN pairs s ON s.conv_id = h.query_id JOIN pairs n ON n.conv_id = h.neighbour_id""")
def _(t: Tables) -> DataFrame:
    samples = I.pairs(t)
    hits = retrieval.nearest(t.embeddings, t.embeddings, "vec_id", "embedding", 1, exclude_self=True)
    four = retrieval.one_shot_context(samples, hits, "conv_id")
    flat = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return four.select("query_id", "neighbour_id", F.md5(flat).alias("messages"))


@query("d10_top_k_retrieval", with_(vectors=VECTORS_SQL, hits=sql_hits(fixed.TOP_K)) + "SELECT query_id, neighbour_id, round(distance, 6) AS distance, place FROM hits")
def _(t: Tables) -> DataFrame:
    hits = metric_index.search(I.vector_index(t), t.embeddings, "vec_id", "embedding", fixed.TOP_K, exclude_self=True)
    return hits.withColumn("distance", F.round("distance", 6))


PASSAGE_CHARS = 1000
_ITEMS = "SELECT doc_id, no, 'text' AS kind, line AS content, '' AS chapter, '' AS section_title FROM lines"


@query("d11_passage_match", with_("lines", "questions", items=_ITEMS, **sql_pack("items", PASSAGE_CHARS)).replace("WITH ", "WITH RECURSIVE ", 1) + f"""
    , c AS (SELECT doc_id, 'chunk_' || doc_id || '_' || chunk AS chunk_id, chunk, list_distinct(regexp_extract_all(lower(text), {q(fixed.TOKEN)})) AS tok FROM packed),
    n AS (SELECT id, doc_id, CASE WHEN cognitive_level = 'recall' THEN 'chunk_' || doc_id || '_2' ELSE document_name END AS source_chunk_id,
      list_distinct(regexp_extract_all(lower(question || ' ' || CASE correct WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c ELSE d END || ' ' || explanation), {q(fixed.TOKEN)})) AS tok FROM questions),
    e AS (SELECT n.id, c.chunk_id, 1.0::DOUBLE AS score, 1::BIGINT AS place, true AS exact FROM n JOIN c ON n.doc_id = c.doc_id AND n.source_chunk_id = c.chunk_id)
    SELECT * FROM e UNION ALL SELECT id, chunk_id, round(score, 2), place, false FROM (SELECT id, chunk_id, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk) AS place
    FROM (SELECT n.id, c.chunk_id, c.chunk, round(len(list_intersect(n.tok, c.tok)) / sqrt(len(c.tok)), 9) AS score FROM n JOIN c USING (doc_id) WHERE len(c.tok) > 0 AND n.id NOT IN (SELECT id FROM e))) WHERE place <= 3""")
def _(t: Tables) -> DataFrame:
    elements = I.lines(t).select("doc_id", "no", F.lit("text").alias("kind"), F.col("line").alias("content"), F.lit("").alias("chapter"), F.lit("").alias("section_title"))
    packed = packing.pack_elements(elements, "doc_id", "no", "content", "kind", PASSAGE_CHARS)
    passages = packed.select("doc_id", F.concat_ws("_", F.lit("chunk"), "doc_id", "chunk").alias("chunk_id"), F.col("chunk").alias("order"), F.col("text").alias("body"))
    q_ = I.questions(t)
    # recall questions know their chunk, the others only their paper
    source = F.when(F.col("cognitive_level") == "recall", F.concat(F.lit("chunk_"), "doc_id", F.lit("_2"))).otherwise(F.col("document_name"))
    needle = F.concat_ws(" ", "question", q_.choices[q_.correct], "explanation")
    asked = q_.select("id", "doc_id", source.alias("source_chunk_id"), needle.alias("needle"))
    return lookups.find_passages(asked, passages, "doc_id")


VIEWS_SQL = f"""SELECT s.cond, s.id, s.predicted, s.is_correct, s.raw_output, CASE WHEN s.cond = 'base' THEN 'ABCD' ELSE {sql_order('s.id')} END AS o, q.a, q.b, q.c, q.d, q.correct FROM scored s JOIN questions q ON s.id = q.id"""
_TEXT_OF = lambda x: f"CASE {x} WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d END"
PICKED_SQL = f"""SELECT *, CASE WHEN picked_text IS NOT NULL THEN substr(o, instr('ABCD', predicted), 1) END AS picked_letter
    FROM (SELECT *, {_TEXT_OF("substr(o, instr('ABCD', predicted), 1)")} AS picked_text FROM views)"""


def views(t: Tables) -> DataFrame:
    # both are read several times
    graded, asked = stage(I.scored(t), "scored"), stage(I.questions(t).select("id", "choices", "correct"), "questions")
    return evaluation.condition_view(graded.drop("raw_output"), asked, graded)


@query("d12_condition_view", with_("scored", views=VIEWS_SQL, picked=PICKED_SQL) + "SELECT cond, id, predicted, picked_text, picked_letter, raw_output, true AS order_verified FROM picked")
def _(t: Tables) -> DataFrame:
    return views(t).select("cond", "id", "predicted", "picked_text", "picked_letter", "raw_output", "order_verified")


@query("d13_responses_with_requests", with_("scored") + f"""SELECT id, predicted, is_correct, penalised, {_METRIC_LIST} FROM scored WHERE cond = 'base' AND {I.sql_digit("'r' || id")} > 1""")
def _(t: Tables) -> DataFrame:
    requests = I.answers(t).filter("cond = 'base'").select("id", "correct_presented")
    return scored_responses(batch_scores(responses(t)), requests).select("id", "predicted", "is_correct", "penalised", *fixed.METRICS)


@query("d14_linked_preprints", """SELECT 'o' || a.o_orderkey AS doi, 'o' || (a.o_orderkey - a.o_orderkey % 7) AS preprint_doi, CAST(CAST(p.o_orderdate AS DATE) AS VARCHAR) AS preprint_date
    FROM orders a LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') p ON p.o_orderkey = a.o_orderkey - a.o_orderkey % 7 WHERE a.o_orderkey % 7 > 0""")
def _(t: Tables) -> DataFrame:
    # every seventh order is the preprint of the six after it
    key, lead = F.col("o_orderkey"), F.col("o_orderkey") % 7
    articles = t.orders.select(I.tag("o", "o_orderkey").alias("doi"), F.array(F.when(lead > 0, F.concat(F.lit("o"), key - lead))).alias("links"))
    day = F.to_date("o_orderdate")
    records = t.orders.filter("o_orderstatus <> 'P'").select(
        I.tag("o", "o_orderkey").alias("doi"), F.when(F.col("o_orderstatus") == "F", day).alias("created"), day.alias("published")
    )
    return lookups.linked_preprints(articles, records).withColumn("preprint_date", F.col("preprint_date").cast("string"))


SECTIONS_SQL = """SELECT doc_id, no, page, y, line, is_heading, coalesce(last_value(CASE WHEN is_heading THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING), 'Unknown Section') AS section_title,
    max(CASE WHEN is_heading AND regexp_matches(line, {stop}) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS stopped FROM lines""".format(stop=q(fixed.STOP_SECTION))
PAGE_SECTIONS_SQL = "SELECT doc_id, page, arg_max(section_title, no) AS section_title FROM sections WHERE stopped = 0 GROUP BY doc_id, page"


def sections(t: Tables) -> DataFrame:
    return packing.fill_sections(I.lines(t), "doc_id", "no", "line", "is_heading")


@query("d15_figure_sections", with_("lines", sections=SECTIONS_SQL, ps=PAGE_SECTIONS_SQL) + """SELECT f.doc_id, f.page, coalesce(h.section_title, b.section_title, l.section_title) AS section_title
    FROM (SELECT doc_id, page + 1 AS page FROM lines WHERE y = 0) f LEFT JOIN ps h ON h.doc_id = f.doc_id AND h.page = f.page LEFT JOIN ps b ON b.doc_id = f.doc_id AND b.page = f.page - 1
    LEFT JOIN (SELECT doc_id, arg_max(section_title, page) AS section_title FROM ps GROUP BY doc_id) l ON l.doc_id = f.doc_id""")
def _(t: Tables) -> DataFrame:
    figures = I.lines(t).filter("y = 0").select("doc_id", (F.col("page") + 1).alias("page"))
    return lookups.figure_sections(figures, packing.section_of_page(sections(t), "doc_id", "page", "no"), "doc_id", "page")


@query("d16_table_sections", with_("lines", sections=SECTIONS_SQL) + """SELECT t.doc_id, t.page, coalesce(h.line, l.section_title) AS section_title,
    coalesce('Chapter ' || coalesce(nullif(regexp_extract(trim(coalesce(h.line, l.section_title)), '^(\\d+)\\.', 1), ''), nullif(regexp_extract(trim(coalesce(h.line, l.section_title)), '(?i)^Chapter\\s+(\\d+)', 1), '')), 'Unknown Chapter') AS chapter
    FROM (SELECT doc_id, page FROM lines WHERE y = 5) t LEFT JOIN (SELECT doc_id, page, arg_min(line, no) AS line FROM lines WHERE is_heading GROUP BY doc_id, page) h USING (doc_id, page)
    LEFT JOIN (SELECT doc_id, arg_max(section_title, no) AS section_title FROM sections WHERE stopped = 0 GROUP BY doc_id) l ON l.doc_id = t.doc_id""")
def _(t: Tables) -> DataFrame:
    rows = I.lines(t)
    tables = rows.filter("y = 5").select("doc_id", "page")
    headings = rows.filter("is_heading").select("doc_id", "page", "no", "line")
    last = sections(t).groupBy("doc_id").agg(F.max_by("section_title", "no").alias("section_title"))
    return lookups.table_sections(tables, headings, last, "doc_id", "page", "no", "line").select("doc_id", "page", "section_title", "chapter")


@query("d17_lookup_with_default", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'NOT FOUND' ELSE 'title ' || quality END AS title, CASE WHEN l.doc_id IS NULL THEN '' ELSE 'author ' || toxic END AS authors FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(t: Tables) -> DataFrame:
    known = t.labels.select("doc_id", F.concat(F.lit("title "), "quality").alias("title"), F.concat(F.lit("author "), "toxic").alias("authors"))
    return lookups.lookup_or_default(t.documents.select("doc_id"), known, "doc_id", {"title": "NOT FOUND", "authors": ""})


@query("d18_recover_identifier", "SELECT d.doc_id, CASE WHEN lang = 'en' THEN 'PMC' || d.doc_id WHEN l.doc_id IS NOT NULL THEN 'PMC' || (d.doc_id + quality) END AS pmcid, lang <> 'en' AND l.doc_id IS NOT NULL AS recovered FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(t: Tables) -> DataFrame:
    articles = t.documents.select("doc_id", F.when(F.col("lang") == "en", I.tag("PMC", "doc_id")).alias("pmcid"))
    other = t.labels.select("doc_id", F.concat(F.lit("PMC"), (F.col("doc_id") + F.col("quality")).cast("string")).alias("pmcid"))
    return lookups.recover_identifier(articles, other, "doc_id", "pmcid")


@query("d19_full_text_fallback", """SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'publisher_direct' WHEN p.page_id IS NOT NULL THEN 'rendered_from_jats_xml' END AS source_used,
    CASE WHEN l.quality = 1 THEN md5(d.text) WHEN p.page_id IS NOT NULL THEN md5(p.html) END AS digest FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN pages p ON p.page_id = d.doc_id""")
def _(t: Tables) -> DataFrame:
    publisher = t.documents.join(t.labels.filter("quality = 1").select("doc_id"), "doc_id").select("doc_id", F.col("text").alias("body"))
    xml = t.pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("body"))
    return lookups.full_text(t.documents.select("doc_id"), publisher, xml, "doc_id").select("doc_id", "source_used", F.md5("body").alias("digest"))


# -- set operations --------------------------------------------------------------------------


@query("h1_union_corpora", "SELECT kind, count(*) AS n, count(year) AS n_dated FROM (SELECT 'old' AS kind, NULL AS year FROM documents WHERE lang <> 'en' UNION ALL SELECT 'new', n_chars FROM documents) GROUP BY kind")
def _(t: Tables) -> DataFrame:
    old = t.documents.filter("lang <> 'en'").select("doc_id", F.lit("old").alias("kind"))
    new = t.documents.select("doc_id", F.lit("new").alias("kind"), F.col("n_chars").alias("year"))
    return old.unionByName(new, allowMissingColumns=True).groupBy("kind").agg(F.count("*").alias("n"), F.count("year").alias("n_dated"))


@query("h2_extra_sample", f"SELECT doc_id FROM (SELECT doc_id, {sql_rank('doc_id', 9)} AS r FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) WHERE r <= 50")
def _(t: Tables) -> DataFrame:
    rest = lookups.unfinished(t.documents.select("doc_id"), t.labels, "doc_id")
    return rest.orderBy(ranking.hash_order(9, "doc_id"), "doc_id").limit(50)


@query("h3_drop_copies", f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY coalesce(nullif(regexp_replace(lower({I.sql_tags('text')}), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), ''), 'row ' || doc_id)")
def _(t: Tables) -> DataFrame:
    keyed = t.documents.select("doc_id", X.content_key(F.col("text")).alias("key"))
    return dedup.drop_copies(keyed, "doc_id", F.col("key")).select("doc_id")


@query("h4_content_copies", "SELECT doc_id, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY sha256(text)) THEN 'accepted' ELSE 'DUPLICATE' END AS status FROM documents")
def _(t: Tables) -> DataFrame:
    return dedup.mark_content_copies(t.documents.select("doc_id", F.sha2("text", 256).alias("sha256")), "doc_id", "sha256").select("doc_id", "status")


@query("h5_entity_sets", with_("pairs", e=ENTITY_PAIRS_SQL) + f"""SELECT conv_id, len(list_intersect(x, y)) AS n_shared, array_to_string(list_sort(list_filter(x, lambda i: NOT list_contains(y, i))), ' ') AS missing
    FROM (SELECT conv_id, {sql_entities('assistant')} AS x, {sql_entities('passage')} AS y FROM e)""")
def _(t: Tables) -> DataFrame:
    sets = entity_pairs(t).select("conv_id", X.entities(F.col("assistant")).alias("x"), X.entities(F.col("passage")).alias("y"))
    return sets.select("conv_id", F.size(F.array_intersect("x", "y")).alias("n_shared"), F.array_join(F.array_sort(F.array_except("x", "y")), " ").alias("missing"))


@query("h6_split_disjoint", f"""WITH s AS (SELECT *, CASE WHEN source IN (SELECT source FROM (SELECT DISTINCT source FROM documents) ORDER BY md5('42|' || source), source LIMIT 5) THEN 'eval' ELSE 'train' END AS split FROM documents)
    SELECT split, count(*) AS chunks, count(DISTINCT source) AS documents, (SELECT count(*) FROM (SELECT source FROM s WHERE split = 'eval' INTERSECT SELECT source FROM s WHERE split = 'train')) AS shared FROM s GROUP BY split""")
def _(t: Tables) -> DataFrame:
    split = ranking.holdout_documents(t.documents, "source", 5)
    names = lambda s: split.filter(F.col("split") == s).select("source")
    shared = names("eval").intersect(names("train")).agg(F.count("*").alias("n")).scalar()
    return split.groupBy("split").agg(F.count("*").alias("chunks"), F.count_distinct("source").alias("documents")).withColumn("shared", shared)
