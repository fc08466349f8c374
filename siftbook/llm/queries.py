"""Registered queries of the pipeline operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftbook.llm import classifier, decontamination, hard_negatives, language, licenses, near_dedup, packing, pages, quality, ranked_search, sharding, substrings, warc
from siftbook.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# the twins: lower-case A-Z only, words of letters, digits and non-ASCII characters, words between white space
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TERM, SPACED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary() -> str:
    """The public word vocabulary that is installed on every worker."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def remainder(modulus: int) -> Column:
    """Fold of a row, from its id; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus, F.lit(0))


@query
def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    profiles = language.learn(docs.filter(remainder(4) != 2))
    return language.identify(docs, profiles, keep=["doc_id"]).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op6_pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, folder, "documents"), vocabulary()))


@query
def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.find_passages(table(spark, folder, "documents"), table(spark, folder, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL["op10_decontaminate"] = rf"""
WITH words AS (
    SELECT doc_id, 'd' AS kind, regexp_extract_all({LOWER}, '{TERM}') AS w FROM documents
    UNION ALL SELECT item_id, 'b', regexp_extract_all({LOWER}, '{TERM}') FROM benchmark
), windows AS (
    SELECT DISTINCT doc_id AS item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS phrase
    FROM words, range(1, greatest(len(w) - 9, 1) + 1) r(i) WHERE kind = 'b' AND len(w) > 0
), sizes AS (SELECT DISTINCT size FROM windows), places AS (
    SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
    FROM words, sizes, range(1, len(w) - size + 2) r(i) WHERE kind = 'd' AND len(w) >= size
), found AS (SELECT doc_id, i, size, item_id FROM places JOIN windows USING (size, phrase)), hits AS (
    SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, i, size FROM found), range(0, size) s(k) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id) WHERE kind = 'd'"""


@query
def op4_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.classes(table(spark, folder, "documents"))


SQL["op4_near_dedup"] = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all({LOWER}, '{SPACED}') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM words, range(1, greatest(len(w) - 4, 1) + 1) r(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), lowest AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM lowest LEFT JOIN sizes USING (doc_id)"""


@query
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.judged(table(spark, folder, "documents"), keep=["doc_id"])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL["op3_quality"] = rf"""
WITH words AS (
    SELECT doc_id, source, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '{SPACED}'), []) AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{SPACED}')) AS lines FROM documents
), runs AS (
    SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS run FROM words, range(1, len(w) - 1) r(i)
), twice AS (SELECT doc_id, i FROM runs QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1), repeated AS (
    SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 3) s(k) GROUP BY doc_id
), counted AS (
    SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
        length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_capitals
    FROM words LEFT JOIN repeated USING (doc_id)
), judged AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        CAST(n_symbols > 0.1 * n_words AS INT) + CAST(n_dup_lines > 0.5 * n_lines AS INT) + CAST(n_capitals > 0.5 * word_chars AS INT) AS n_failed
    FROM counted
), hosts AS (
    SELECT source, count(*) AS n, sum(CAST(base_failed OR n_failed > 0 AS INT)) AS failed FROM judged WHERE source IS NOT NULL GROUP BY source
), prior AS (SELECT avg(failed / n) AS mean, var_pop(failed / n) AS spread FROM hosts), strength AS (
    SELECT mean, CASE WHEN spread > 0 THEN least(greatest(mean * (1 - mean) / spread - 1, 1), 1e6) ELSE 1e6 END AS s FROM prior
), rates AS (SELECT source, (failed + mean * s) / (n + s) AS rate FROM hosts, strength)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND n_failed <= CASE WHEN coalesce(rate > 0.1, FALSE) THEN 0 ELSE 1 END AS kept
FROM judged LEFT JOIN rates USING (source)"""


@query
def op5_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"), keep=["doc_id"])


def _license_rows() -> tuple[str, str]:
    """The templates as rows: (t, label, base, key, words of the key), (t, place from the key on, word)."""
    keys, notices = [], []
    for number, t in enumerate(licenses.TEMPLATES):
        words, key = t.notice.split(), t.key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        keys.append(f"({number}, '{t.label}', {t.base}, '{t.key}', {len(key)})")
        notices += [f"({number}, {i - at}, '{w}')" for i, w in enumerate(words)]
    return ", ".join(keys), ", ".join(notices)


SQL["op5_licenses"] = rf"""
WITH keys(t, label, base, key, size) AS (VALUES {_license_rows()[0]}), notices(t, off, word) AS (VALUES {_license_rows()[1]}),
words AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER}, '{TERM}'), []) AS w FROM documents), sizes AS (SELECT DISTINCT size FROM keys),
windows AS (
    SELECT doc_id, w, i - 1 AS pos, size, array_to_string(w[i : i + size - 1], ' ') AS phrase FROM words, sizes, range(1, len(w) - size + 2) r(i)
), found AS (SELECT doc_id, w, pos, t, label, base FROM windows JOIN keys ON phrase = key AND windows.size = keys.size),
present AS (SELECT word, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(w) AS word FROM words) GROUP BY word),
rarity AS (
    SELECT DISTINCT notices.word, ln(((SELECT count(*) FROM documents) + 1) / (coalesce(n, 0) + 1)) + 1e-6 AS idf FROM notices LEFT JOIN present USING (word)
), weights AS (SELECT t, off, word, idf / sum(idf) OVER (PARTITION BY t) AS part FROM notices JOIN rarity USING (word)),
shares AS (
    SELECT doc_id, t, pos, sum(CASE WHEN pos + off >= 0 AND w[pos + off + 1] = word THEN part ELSE 0 END) AS share FROM found JOIN weights USING (t) GROUP BY ALL
), scores AS (SELECT doc_id, max(share) AS score FROM shares GROUP BY doc_id), marked AS (
    SELECT doc_id, count(*) FILTER (base) AS n_base, min(pos) FILTER (base) AS first_word, max(pos) FILTER (base) AS last_word,
        array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels
    FROM found GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0), 6) AS score
FROM words LEFT JOIN marked USING (doc_id) LEFT JOIN scores USING (doc_id)"""


@query
def op7_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shards(table(spark, folder, "documents"))


@query
def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    net = classifier.learn(docs.filter(remainder(5) != 0), table(spark, folder, "labels"), "quality")
    rows = classifier.scored(docs, net, keep=["doc_id"])
    return rows.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = warc.write_monolithic(warc.marked(table(spark, folder, "pages")), scratch_path(spark, "warc"))
    records = warc.read_records(warc.normalise(archives))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op9_warc"] = """
WITH rows AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
firsts AS (SELECT page_id, html, sha1(html) AS sha, max(page_id) OVER (PARTITION BY html) AS first FROM rows)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((CAST('0x' || substr(sha, 5 * (k // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts"""


@query
def op2_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extracted(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query
def op13_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = substrings.remove_repeats(table(spark, folder, "documents"), keep=["doc_id"])
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL["op13_substring_dedup"] = rf"""
WITH words AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{SPACED}'), []) AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS passage FROM words, range(1, len(w) - 48) r(i)),
later AS (SELECT doc_id, i FROM windows QUALIFY doc_id > min(doc_id) OVER (PARTITION BY passage)),
covered AS (SELECT DISTINCT doc_id, i + k AS place FROM later, range(0, 50) s(k)),
lists AS (SELECT doc_id, list(place) AS gone FROM covered GROUP BY doc_id),
kept AS (SELECT doc_id, w, list_filter(w, lambda x, place: NOT list_contains(coalesce(gone, []), place)) AS stay FROM words LEFT JOIN lists USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(stay) AS BIGINT) AS n_removed, sha256(array_to_string(stay, ' ')) AS kept_sha256 FROM kept"""


@query
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


SQL["op11_hard_negatives"] = """
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), FALSE))) = len(embedding)
), pairs AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), ranked AS (
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank, id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5"""


@query
def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


SQL["op12_ranked_search"] = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all({LOWER}, '{TERM}') AS w FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT doc_id, len(w) AS n FROM words WHERE len(w) > 0), totals AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM sizes),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWER}, '{TERM}')) AS term FROM benchmark),
counts AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM items) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, totals GROUP BY term, nn),
scores AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // l)))) AS BIGINT) AS score
    FROM items JOIN counts USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), totals GROUP BY item_id, doc_id
), ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10"""
