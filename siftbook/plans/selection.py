"""Ranking, sampling, packing, ordering, retrieval pipelines, record updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftbook.functions import fixed
from siftbook.functions import text as X
from siftbook.operators import evaluation, packing, ranking, records, retrieval
from siftbook.plans import inputs as I
from siftbook.plans.aggregates import rounded
from siftbook.plans.inputs import q, sql_list, sql_order, sql_rank, with_
from siftbook.plans.joins import SECTIONS_SQL, VECTORS_SQL, sections, sql_hits
from siftbook.plans.projections import GENERATION_SQL, generation_chunks, leaky_pairs, LEAKY_SQL
from siftbook.plans.registry import Tables, query
from siftbook.plans.scans import sql_pack
from siftbook.session import stage

# -- ranks, splits, samples ------------------------------------------------------------------


@query("f1_last_write_wins", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def _(t: Tables) -> DataFrame:
    return ranking.latest_per_key(t.events.select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])


@query("f2_first_wins", with_("lines") + "SELECT min(doc_id) AS doc_id, trim(lower(line)) AS key, count(*) AS n FROM lines GROUP BY trim(lower(line))")
def _(t: Tables) -> DataFrame:
    rows = I.lines(t).select("doc_id", "no", F.trim(F.lower("line")).alias("key"))
    return rows.groupBy("key").agg(F.min(F.struct("doc_id", "no")).alias("first"), F.count("*").alias("n")).select("first.doc_id", "key", "n")


@query("f3_document_holdout", "SELECT doc_id, source, CASE WHEN source IN (SELECT source FROM (SELECT DISTINCT source FROM documents) ORDER BY md5('42|' || source), source LIMIT 5) THEN 'eval' ELSE 'train' END AS split FROM documents")
def _(t: Tables) -> DataFrame:
    return ranking.holdout_documents(t.documents.select("doc_id", "source"), "source", 5)


@query("f4_train_validation", f"SELECT doc_id, CASE WHEN {sql_rank('doc_id', 42)} <= greatest(1, floor(count(*) OVER () * 0.02)) THEN 'val' ELSE 'train' END AS split FROM documents")
def _(t: Tables) -> DataFrame:
    return ranking.train_validation(t.documents.select("doc_id"), ["doc_id"], 0.02)


@query("f5_round_robin_shard", with_("chunks", g=GENERATION_SQL) + "SELECT id, (row_number() OVER (ORDER BY ord) - 1) % 16 AS shard FROM g")
def _(t: Tables) -> DataFrame:
    return ranking.shard(generation_chunks(t).select("ord", "id"), [F.col("ord")], 16).select("id", "shard")


@query("f6_category_assignment", with_("chunks", g=GENERATION_SQL) + f"SELECT id, {sql_list(sorted(I.CATEGORIES))}[({sql_rank('id', 42)} - 1) % 4 + 1] AS category FROM g")
def _(t: Tables) -> DataFrame:
    return ranking.assign_categories(generation_chunks(t).select("id"), ["id"], list(I.CATEGORIES))


@query("f7_quota_fill", with_("questions") + "SELECT id, cognitive_level FROM (SELECT *, row_number() OVER (PARTITION BY cognitive_level ORDER BY doc_id) AS r FROM questions) WHERE r <= 40 - CASE cognitive_level WHEN 'recall' THEN 15 ELSE 0 END")
def _(t: Tables) -> DataFrame:
    rows = I.questions(t).select("id", "doc_id", "cognitive_level")
    filled = ranking.fill_quota(rows, "cognitive_level", [F.col("doc_id")], 160, list(fixed.LEVELS), existing={"recall": 15})
    return filled.select("id", "cognitive_level")


@query("f8_category_fill", f"SELECT doc_id, {sql_list(I.CATEGORIES)}[(r - 1) // 15 + 1] AS category FROM (SELECT doc_id, {sql_rank('doc_id', 42)} AS r FROM documents WHERE n_chars >= 300) WHERE r <= 60")
def _(t: Tables) -> DataFrame:
    # candidates that fail are dropped first, the others move up
    usable = t.documents.filter("n_chars >= 300").select("doc_id")
    return ranking.fill_categories(usable, ["doc_id"], list(I.CATEGORIES), 15).select("doc_id", "category")


@query("f9_stratified_sample", f"SELECT doc_id, lang FROM (SELECT *, {sql_rank('doc_id', 1, 'lang')} AS r FROM documents) WHERE r <= ceil(50 / (SELECT count(DISTINCT lang) FROM documents)) ORDER BY md5('1-all|' || doc_id), doc_id LIMIT 50")
def _(t: Tables) -> DataFrame:
    return ranking.stratified_sample(t.documents.select("doc_id", "lang"), "lang", ["doc_id"], 50)


@query("f10_sample_per_category", f"SELECT doc_id, lang, total, r AS pick FROM (SELECT *, {sql_rank('doc_id', 7, 'lang')} AS r, count(*) OVER (PARTITION BY lang) AS total FROM documents) WHERE r <= 25")
def _(t: Tables) -> DataFrame:
    return ranking.sample_per_category(t.documents.select("doc_id", "lang"), "lang", ["doc_id"], 25).select("doc_id", "lang", "total", "pick")


@query("f11_top_fraction", "WITH s AS (SELECT * FROM events WHERE event_type <> 'error') SELECT event_id, value FROM (SELECT *, row_number() OVER (ORDER BY value DESC, event_id) AS r FROM s) WHERE r <= floor((SELECT count(*) FROM s) * 0.1)")
def _(t: Tables) -> DataFrame:
    # failed rows have NaN scores
    score = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    return ranking.top_fraction(t.events.select("event_id", score.alias("value")), "value", "event_id", 0.1).select("event_id", "value")


@query("f12_masked_reselect", with_("pairs", leaky=LEAKY_SQL, clean="SELECT conv_id, length(\"user\") / length(assistant) AS score FROM leaky WHERE NOT (" + " OR ".join(f"contains(lower(\"user\" || assistant), {q(p)})" for p in fixed.CONTAMINATION) + ")")
       + "SELECT conv_id FROM (SELECT *, row_number() OVER (ORDER BY score DESC, conv_id) AS r FROM clean) WHERE r <= floor((SELECT count(*) FROM clean) * 0.1)")
def _(t: Tables) -> DataFrame:
    clean = leaky_pairs(t).filter(~X.contains_any(F.concat("user", "assistant"), fixed.CONTAMINATION))
    scores = clean.select("conv_id", (F.length("user") / F.length("assistant")).alias("score"))
    return ranking.top_fraction(scores, "score", "conv_id", 0.1).select("conv_id")


@query("f13_sequence_ids", "SELECT doc_id, 'amcq_' || lang || '_' || format('{:03d}', row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 + CASE lang WHEN 'en' THEN 40 ELSE 0 END) AS id FROM documents")
def _(t: Tables) -> DataFrame:
    # English already has 40 items
    start = F.when(F.col("lang") == "en", 40).otherwise(0)
    prefix = F.concat(F.lit("amcq_"), F.col("lang"), F.lit("_"))
    return ranking.sequence_ids(t.documents.select("doc_id", "lang"), ["lang"], [F.col("doc_id")], prefix, 3, start).select("doc_id", "id")


_AT = lambda i: f"CASE substr(o, {i}, 1) WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c ELSE d END"


@query("f14_choice_shuffle", with_("questions") + f"SELECT id, substr('ABCD', instr(o, correct), 1) AS correct_presented, {_AT(1)} AS a, {_AT(4)} AS d FROM (SELECT *, {sql_order('id')} AS o FROM questions)")
def _(t: Tables) -> DataFrame:
    shown = evaluation.shuffle_questions(I.questions(t).select("id", "choices", "correct"))
    return shown.select("id", "correct_presented", shown.choices["A"].alias("a"), shown.choices["D"].alias("d"))


@query("f15_shuffle_replay", with_("answers", x=f"""SELECT cond, id, correct, CASE WHEN cond = 'tuned' AND length(raw_output) % 5 = 0 THEN 'A' ELSE correct_presented END AS shown, {sql_order('id')} AS o FROM answers""") +
       "SELECT cond, id, cond <> 'base' AS randomised, CASE WHEN cond = 'base' THEN 'ABCD' WHEN shown = substr('ABCD', instr(o, correct), 1) THEN o END AS letter_order FROM x")
def _(t: Tables) -> DataFrame:
    # some tuned answers were recorded under another seed
    other = (F.col("cond") == "tuned") & (F.length("raw_output") % 5 == 0)
    shown = I.answers(t).select("cond", "id", F.when(other, "A").otherwise(F.col("correct_presented")).alias("correct_presented"))
    return evaluation.verify_order(shown, I.questions(t)).select("cond", "id", "randomised", "letter_order")


@query("f16_order_randomisation", with_("pairs") + f"""SELECT conv_id, first, md5(CASE WHEN first THEN "user" ELSE assistant END) AS first_shown FROM (SELECT *, {I.sql_digit("'42|' || conv_id")} % 2 = 0 AS first FROM pairs)""")
def _(t: Tables) -> DataFrame:
    shown = evaluation.show_in_random_order(I.pairs(t).select("conv_id", F.col("user").alias("a"), F.col("assistant").alias("b")), "conv_id")
    return shown.select("conv_id", F.col("a_shown_first").alias("first"), F.md5("first_shown").alias("first_shown"))


# short lines are headings, lines with a digit count as tables
_PACK_ITEMS = """SELECT doc_id, no, CASE WHEN regexp_matches(line, '[0-9]{3}') THEN 'table' ELSE 'text' END AS kind, line AS content, section_title AS chapter, section_title FROM sections WHERE stopped = 0 AND NOT is_heading"""


@query("f17_section_packing", with_("lines", sections=SECTIONS_SQL, items=_PACK_ITEMS, **sql_pack("items")).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT doc_id, CAST(chunk AS BIGINT) AS chunk, content_type, section_title, md5(text) AS digest, n_elements FROM packed")
def _(t: Tables) -> DataFrame:
    body = sections(t).filter(~F.col("is_heading"))
    kind = F.when(F.col("line").rlike("[0-9]{3}"), "table").otherwise("text")
    elements = body.select("doc_id", "no", kind.alias("kind"), F.col("line").alias("content"), F.col("section_title").alias("chapter"), "section_title")
    packed = packing.pack_elements(elements, "doc_id", "no", "content", "kind")
    return packed.select("doc_id", "chunk", "content_type", "section_title", F.md5("text").alias("digest"), "n_elements")


_CLEAN_SQL = f"""SELECT doc_id, no, page, raw, is_heading FROM (SELECT *, {I.sql_strip('line')} AS raw FROM lines) WHERE raw <> ''
    QUALIFY NOT (count(*) OVER (PARTITION BY doc_id, raw) > 3 AND length(raw) < 200) AND NOT regexp_matches(raw, {q(fixed.CAPTION)})"""
_OPENED_SQL = "SELECT doc_id, no, raw <> coalesce(lag(raw) OVER (PARTITION BY doc_id ORDER BY no), 'Introduction') AS fresh FROM clean WHERE is_heading"
_RUNS_SQL = f"""SELECT c.*, coalesce(max(CASE WHEN fresh THEN no END) OVER w, 0) AS run, last_value(CASE WHEN fresh THEN raw END IGNORE NULLS) OVER w AS section,
    max(CASE WHEN is_heading AND regexp_matches(raw, {q(fixed.STOP_SECTION)}) THEN 1 ELSE 0 END) OVER w AS stopped
    FROM clean c LEFT JOIN opened USING (doc_id, no) WINDOW w AS (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING)"""
_CODE = f"regexp_matches(raw, {q(fixed.HTTP_REQUEST)}) OR ((raw LIKE '{{%' OR raw LIKE '[%') AND (raw LIKE '%}}' OR raw LIKE '%]')) OR raw LIKE 'curl %'"
_LAYOUT_ITEMS = f"""SELECT doc_id, no, 'text' AS kind, page, CASE WHEN {_CODE} THEN '```' || chr(10) || raw || chr(10) || '```' ELSE raw END AS content, run::VARCHAR AS chapter,
    coalesce(section, 'Introduction') AS section_title FROM runs WHERE stopped = 0 AND NOT is_heading"""
_NUMBER = f"coalesce(nullif(regexp_extract(section_title, {q(fixed.CHAPTER_NUMBER)}, 1), ''), nullif(regexp_extract(section_title, {q(fixed.CHAPTER_NAME)}, 1), ''))"


@query("f17_layout_chunks", with_("lines", clean=_CLEAN_SQL, opened=_OPENED_SQL, runs=_RUNS_SQL, items=_LAYOUT_ITEMS, **sql_pack("items")).replace("WITH ", "WITH RECURSIVE ", 1) + f"""
    SELECT doc_id, 'chunk_' || format('{{:04d}}', chunk) AS id, chapter, section_title, page_number, page_range, md5('[Document: ' || doc_id || ' | Chapter: ' || chapter || ' | Section: ' || section_title
    || ' | Page: ' || page_range || ']' || chr(10) || chr(10) || text) AS digest
    FROM (SELECT doc_id, chunk, text, section_title, CASE WHEN run = '0' THEN 'Chapter 1' ELSE coalesce('Chapter ' || {_NUMBER}, 'Unknown Chapter') END AS chapter, p AS page_number,
    CASE WHEN p = p2 THEN p::VARCHAR ELSE p || '-' || p2 END AS page_range FROM (SELECT doc_id, chunk, any_value(chapter) AS run, any_value(section_title) AS section_title,
    string_agg(content, chr(10) || chr(10) ORDER BY pos) AS text, min(page) AS p, max(page) AS p2 FROM marked JOIN walk USING (doc_id, pos) GROUP BY doc_id, chunk))""")
def _(t: Tables) -> DataFrame:
    chunks = packing.layout_chunks(I.lines(t).withColumn("mono_ratio", F.lit(0.0)), "doc_id", "no", "page", "line", "is_heading", "mono_ratio")
    return chunks.select("doc_id", "id", "chapter", "section_title", "page_number", "page_range", F.md5("text").alias("digest"))


@query("f18_section_fill", with_("lines", sections=SECTIONS_SQL) + "SELECT doc_id, no, section_title FROM sections WHERE stopped = 0")
def _(t: Tables) -> DataFrame:
    return sections(t).select("doc_id", "no", "section_title")


_HIER = f"""SELECT doc_id, no, CASE WHEN is_heading AND no % 4 = 1 THEN 'METHODS ' || no WHEN is_heading THEN line ELSE line END AS line, is_heading FROM lines"""


@query("f19_heading_hierarchy", with_("lines", h=_HIER) + f"""SELECT doc_id, no, coalesce(last_value(CASE WHEN is_heading AND (regexp_matches(line, {q(fixed.TOP_LEVEL_SECTION)}) OR (regexp_replace(line, '\\s+', ' ', 'g') = upper(regexp_replace(line, '\\s+', ' ', 'g')) AND length(line) > 3)) THEN line END IGNORE NULLS) OVER w, 'Body') AS chapter,
    coalesce(last_value(CASE WHEN is_heading THEN line END IGNORE NULLS) OVER w, 'Body') AS section_title FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING)""")
def _(t: Tables) -> DataFrame:
    title = F.when(F.col("is_heading") & (F.col("no") % 4 == 1), F.concat(F.lit("METHODS "), F.col("no"))).otherwise(F.col("line"))
    return packing.fill_hierarchy(I.lines(t).withColumn("line", title), "doc_id", "no", "line", "is_heading").select("doc_id", "no", "chapter", "section_title")


@query("f20_usable_sample", "SELECT page_id FROM pages WHERE length(html) > 3000 ORDER BY md5('42|' || page_id), page_id LIMIT 15")
def _(t: Tables) -> DataFrame:
    return ranking.usable_sample(t.pages.select("page_id", "html"), F.length("html") > 3000, ["page_id"], 15).select("page_id")


@query("f21_name_collisions", "SELECT page_id, CASE r WHEN 1 THEN host || '.pdf' ELSE host || '_' || (r - 1) || '.pdf' END AS local_filename FROM (SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY page_id) AS r FROM (SELECT page_id, regexp_replace(regexp_extract(url, 'https?://([^/]+)', 1), '[^A-Za-z0-9]+', '_', 'g') AS host FROM pages))")
def _(t: Tables) -> DataFrame:
    name = F.concat(X.filename_part(F.col("host"), 200), F.lit(".pdf"))
    named = I.page_parts(t).select("page_id", name.alias("name"))
    return records.unique_names(named, "name", [F.col("page_id")]).select("page_id", "local_filename")


_SHOT_START = f"CAST('0x' || substr(md5('42-start|' || doc_id), 1, 8) AS BIGINT)"


@query("f22_few_shot", with_("pairs", s=f"SELECT conv_id, category, {sql_rank('conv_id', 42, 'category')} - 1 AS at, count(*) OVER (PARTITION BY category) AS m FROM pairs", r=f"""SELECT doc_id, {sql_list(I.CATEGORIES)}[{I.sql_digit("'p' || doc_id")} % 4 + 1] AS category FROM documents""") +
       f"SELECT r.doc_id, i AS shot, s.conv_id FROM r JOIN (SELECT DISTINCT category, m FROM s) USING (category), range(1, 9) x(i) JOIN s ON s.category = r.category AND s.at = ({_SHOT_START} + i - 1) % s.m WHERE i <= s.m")
def _(t: Tables) -> DataFrame:
    category = F.element_at(F.array(*[F.lit(c) for c in I.CATEGORIES]), F.pmod(I.digit(I.tag("p", "doc_id")), F.lit(4)) + 1)
    wanted = t.documents.select("doc_id", category.alias("category"))
    return ranking.few_shot(wanted, I.pairs(t).select("conv_id", "category"), "doc_id", "conv_id", "category").select("doc_id", "shot", "conv_id")


@query("f23_diagnostic_sample", with_(vectors=VECTORS_SQL, hits=sql_hits(1), c="SELECT query_id, label, ntile(3) OVER (ORDER BY distance, query_id) AS tercile FROM hits JOIN embeddings ON vec_id = query_id") +
       f"SELECT query_id, CAST(label AS BIGINT) AS label, tercile FROM (SELECT *, {sql_rank('query_id', 3, 'label, tercile')} AS r FROM c) WHERE r <= 7")
def _(t: Tables) -> DataFrame:
    hits = retrieval.nearest(t.embeddings, t.embeddings, "vec_id", "embedding", 1, exclude_self=True).select("query_id", "distance")
    cut = ranking.tiles(stage(hits, "hits"), "distance", "query_id", 3, "tercile")
    cells = cut.join(t.embeddings.select(F.col("vec_id").alias("query_id"), "label"), "query_id").select("query_id", "label", "tercile")
    return ranking.top_per_group(cells, ["label", "tercile"], [ranking.hash_order(3, "query_id"), F.col("query_id")], F.lit(7), bound=7).drop("pick")


# -- orders and limits -----------------------------------------------------------------------


@query("g1_reading_order", with_("lines") + "SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY page, y)) AS digest FROM lines GROUP BY doc_id")
def _(t: Tables) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("page", "y", "line")))
    text = F.array_join(F.transform(ordered, lambda e: e["line"]), "\n")
    return I.lines(t).groupBy("doc_id").agg(F.md5(text).alias("digest"))


@query("g3_cap_per_source", "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r <= 50 ORDER BY event_id LIMIT 200")
def _(t: Tables) -> DataFrame:
    capped = ranking.top_per_group(t.events.select("event_id", "event_type"), ["event_type"], [F.col("event_id")], F.lit(50), bound=50)
    return capped.drop("pick").orderBy("event_id").limit(200)


@query("g4_sample_prefix", "SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 100")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").orderBy(ranking.hash_order(42, "doc_id"), "doc_id").limit(100)


@query("g5_distinct_names", with_("questions") + "SELECT DISTINCT cognitive_level, topic FROM questions")
def _(t: Tables) -> DataFrame:
    return I.questions(t).select("cognitive_level", "topic").distinct().orderBy("cognitive_level", "topic")


# -- retrieval pipelines ---------------------------------------------------------------------


def _contexts(t: Tables) -> DataFrame:
    hits = retrieval.nearest(t.embeddings, t.embeddings, "vec_id", "embedding", fixed.TOP_K, exclude_self=True)
    # there are fewer documents than vectors: every vector has a document
    n = ranking.row_total(t.documents)
    texts = t.embeddings.select("vec_id", F.pmod("vec_id", n).alias("doc_id")).join(t.documents.select("doc_id", "text"), "doc_id")
    return retrieval.build_context(hits, texts, "vec_id", "text")


_CONTEXT_SQL = """SELECT query_id, string_agg(x.text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS context, min(distance) AS top_distance
    FROM hits JOIN (SELECT vec_id, text FROM embeddings JOIN documents ON doc_id = vec_id % (SELECT count(*) FROM documents)) x ON x.vec_id = neighbour_id GROUP BY query_id"""


@query("i1_context_build", with_(vectors=VECTORS_SQL, hits=sql_hits(fixed.TOP_K), c=_CONTEXT_SQL) + "SELECT query_id, md5(context) AS context, round(top_distance, 6) AS top_distance FROM c")
def _(t: Tables) -> DataFrame:
    return _contexts(t).select("query_id", F.md5("context").alias("context"), F.round("top_distance", 6).alias("top_distance"))


@query("i2_distance_gate", with_(vectors=VECTORS_SQL, hits=sql_hits(fixed.TOP_K), c=_CONTEXT_SQL) + "SELECT query_id, top_distance <= 0.9 AS used_context, md5(CASE WHEN top_distance <= 0.9 THEN context ELSE '' END) AS context FROM c")
def _(t: Tables) -> DataFrame:
    # the default threshold fits the usual encoder; these vectors lie further apart
    return retrieval.gate(_contexts(t), 0.9).select("query_id", "used_context", F.md5("context").alias("context"))


@query("i3_selection_score", with_(vectors=VECTORS_SQL, hits=sql_hits(1)) + """SELECT h.query_id, round(n.value - s.value, 6) AS score FROM hits h JOIN events s ON s.event_id = h.query_id JOIN events n ON n.event_id = h.neighbour_id""")
def _(t: Tables) -> DataFrame:
    hits = retrieval.nearest(t.embeddings, t.embeddings, "vec_id", "embedding", 1, exclude_self=True)
    loss = lambda k, name: t.events.select(F.col("event_id").alias(k), F.col("value").alias(name))
    joined = hits.join(loss("query_id", "without"), "query_id").join(loss("neighbour_id", "with_neighbour"), "neighbour_id")
    return joined.select("query_id", F.round(retrieval.selection_score(F.col("with_neighbour"), F.col("without")), 6).alias("score"))


@query("i4_index_table", "SELECT vec_id AS id, 'text' AS content_type, CAST(label AS VARCHAR) AS label, len(embedding) AS dims, true AS has_cell FROM embeddings")
def _(t: Tables) -> DataFrame:
    index = I.vector_index(t)
    cells = index.table("vectors").select("h1", "h2", F.size("v").alias("dims"), F.col("fine").isNotNull().alias("has_cell"))
    return index.table("rows").join(cells, ["h1", "h2"]).select("id", "content_type", "label", "dims", "has_cell")


# -- record updates --------------------------------------------------------------------------


@query("i5_record_patch", """SELECT c_custkey, CASE WHEN n_regionkey = 1 THEN 'PATCHED ' || n_name ELSE c_mktsegment END AS c_mktsegment, CASE WHEN n_regionkey = 2 THEN replace(c_name, 'Customer#', 'Client ') ELSE c_name END AS c_name
    FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def _(t: Tables) -> DataFrame:
    customers = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment", "c_name")
    regions = t.nation.filter(F.col("n_regionkey").isin(1, 2)).withColumnRenamed("n_nationkey", "c_nationkey")
    patches = customers.join(regions, "c_nationkey").select(
        "c_custkey", F.when(F.col("n_regionkey") == 1, F.concat(F.lit("PATCHED "), "n_name")).alias("new_c_mktsegment"),
        F.when(F.col("n_regionkey") == 2, "Customer#").alias("old"), F.lit("Client ").alias("new"),
    )
    return records.patch(customers, patches, "c_custkey", ["c_mktsegment"], {"c_name": ("old", "new")}).select("c_custkey", "c_mktsegment", "c_name")


@query("i6_quarantine", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'quarantined' ELSE 'active' END AS pool, CASE WHEN toxic = 1 THEN CASE WHEN lang = 'en' THEN 'QUARANTINED: toxic ' || source ELSE lang || ' | QUARANTINED: toxic ' || source END WHEN lang = 'en' THEN '' ELSE lang END AS notes FROM documents LEFT JOIN labels USING (doc_id)")
def _(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "source", F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("notes"))
    toxic = t.labels.filter("toxic = 1").join(t.documents.select("doc_id", "source"), "doc_id")
    active, moved = records.quarantine(rows, toxic.select("doc_id", F.concat(F.lit("toxic "), "source").alias("reason")), "doc_id")
    return active.withColumn("pool", F.lit("active")).unionByName(moved.withColumn("pool", F.lit("quarantined"))).select("doc_id", "pool", "notes")
