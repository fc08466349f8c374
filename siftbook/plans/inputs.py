"""Stand-in inputs that Spark and SQL both derive from the given tables.

The tables hold no questions, graded answers or layout blocks, so these are computed from whole
tables with md5 choices. ``CTE`` holds the same definitions for the SQL twins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftbook.functions import fixed
from siftbook.functions.grading import letter_at, shuffled_letters
from siftbook.functions.text import provenance_header
from siftbook.operators import metric_index
from siftbook.operators.evaluation import grade
from siftbook.plans.registry import Tables
from siftbook.session import scratch_path

CONDITIONS = ("base", "retrieval", "tuned")
CATEGORIES = ("mechanism", "methodology_critique", "premise_correction", "result_interpretation")
LINES_PER_PAGE = 40
TOPIC_WORDS = r"(?i)tion"
# whitespace as members of an RE2 character class
SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def sql_in(items) -> str:
    return "(" + ", ".join(q(i) for i in items) + ")"


def digit(key: Column, at: int = 1) -> Column:
    """Hex digit of the key's md5 as a number."""
    return F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(key), at, 1)) - 1


def sql_digit(key: str, at: int = 1) -> str:
    return f"(instr('0123456789abcdef', substr(md5({key}), {at}, 1)) - 1)"


def tag(prefix: str, *cols: str) -> Column:
    return F.concat(F.lit(prefix), *[F.col(c).cast("string") for c in cols])


def chunks(t: Tables) -> DataFrame:
    section = F.when(F.col("source") == "src7", "Abstract").otherwise(F.concat(F.lit("Section "), F.col("source")))
    header = provenance_header(F.col("source"), F.col("lang"), section)
    return t.documents.select(
        F.col("doc_id").alias("ord"), tag("chunk_", "doc_id").alias("id"),
        F.when(F.col("lang") == "es", "table").otherwise("text").alias("content_type"),
        F.col("source").alias("document_name"), section.alias("section_title"),
        F.when(F.col("lang") == "fr", F.col("text")).otherwise(F.concat(header, F.col("text"))).alias("text"), "lang",
    )


def lines(t: Tables) -> DataFrame:
    split = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    no = F.col("no") + 1
    return split.select(
        "doc_id", no.cast("long").alias("no"), "line", (F.floor((no - 1) / LINES_PER_PAGE) + 1).alias("page"),
        F.pmod(no - 1, F.lit(LINES_PER_PAGE)).cast("long").alias("y"), (F.length("line") < 60).alias("is_heading"),
    )


def questions(t: Tables) -> DataFrame:
    """Question, choices and explanation are lines of the whole document, picked by md5."""
    d = t.documents.withColumn("_lines", F.split("text", "\n"))

    def line(i: int) -> Column:
        number = F.conv(F.substring(F.md5(F.concat(F.lit("q"), F.col("doc_id").cast("string"), F.lit(f"|{i}"))), 1, 8), 16, 10).cast("long")
        return F.element_at("_lines", (F.pmod(number, F.size("_lines")) + 1).cast("int"))

    parts = [line(i) for i in range(1, 5)]
    pick = lambda names, at: F.element_at(F.array(*[F.lit(n) for n in names]), F.pmod(digit(tag("q", "doc_id"), at), F.lit(len(names))) + 1)
    return d.select(
        "doc_id", tag("mcq_", "doc_id").alias("id"), tag("chunk_", "doc_id").alias("source_chunk_id"), F.col("source").alias("document_name"),
        F.concat(F.lit("Which one? "), line(0)).alias("question"),
        F.map_from_arrays(F.array(*[F.lit(x) for x in fixed.LETTERS]), F.array(*parts)).alias("choices"),
        pick(fixed.LETTERS, 1).alias("correct"), line(5).alias("explanation"),
        pick(fixed.LEVELS, 2).alias("cognitive_level"), pick(fixed.TOPICS, 3).alias("topic"),
    )


# raw outputs: wording around a letter, and one without any
WORDINGS = (
    ("Answer: ", ""), ("So the answer is option ", "."), ("I would choose ", " here"), ("select ", ""), ("", ") because of that"),
    ("Clearly ", " is the correct one"), ("It is likely\n ", " "), ("the Correct answer is ", "!"), ("Option ", " is correct"), ("none of them", None),
)


def answers(t: Tables) -> DataFrame:
    """(cond, id, correct, letter_order, correct_presented, raw_output): only 'base' keeps the order."""
    m = questions(t).select("id", "correct", "cognitive_level").withColumn("cond", F.explode(F.array(*[F.lit(c) for c in CONDITIONS])))
    key = F.concat_ws("|", "cond", "id")
    order = F.when(F.col("cond") == "base", "ABCD").otherwise(shuffled_letters(F.col("id"), 42))
    m = m.withColumn("letter_order", order).withColumn("correct_presented", letter_at(F.col("letter_order"), F.col("correct")))
    letter = F.when(digit(key, 1) < 9, F.col("correct_presented")).otherwise(F.substring(F.lit("ABCD"), F.pmod(digit(key, 2), F.lit(4)) + 1, F.lit(1)))
    # no placeholder in the wording without a letter
    wordings = F.array(*[F.lit(before if after is None else f"{before}%s{after}") for before, after in WORDINGS])
    chosen = F.element_at(wordings, F.pmod(digit(key, 3), F.lit(len(WORDINGS))) + 1)
    m = m.withColumn("_letter", letter).withColumn("_wording", chosen)
    return m.withColumn("raw_output", F.replace(F.col("_wording"), F.lit("%s"), F.col("_letter"))).drop("_letter", "_wording")


def scored(t: Tables) -> DataFrame:
    key = F.concat_ws("|", "cond", "id")
    marks = {m: F.when(digit(key, 4 + i) > 0, F.pmod(digit(key, 4 + i), F.lit(5)) + 1) for i, m in enumerate(fixed.METRICS)}
    return grade(answers(t)).withColumns(marks).drop("letter_order", "correct")


def pairs(t: Tables) -> DataFrame:
    """Each user turn with the assistant turn after it; ``conv_id`` names the pair: the turn stands above 40 bits of the conversation's id."""
    turns = lambda role, back: t.conversations.filter(F.col("role") == role).select("conv_id", (F.col("turn") - back).alias("turn"), F.col("text").alias(role))
    both = turns("user", 0).join(turns("assistant", 1), ["conv_id", "turn"]).filter("user IS NOT NULL AND assistant IS NOT NULL")
    both = both.select((F.col("conv_id") + F.col("turn") * (1 << 40)).alias("conv_id"), "user", "assistant")
    category = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), F.pmod(digit(tag("p", "conv_id")), F.lit(4)) + 1)
    return both.withColumn("category", category).withColumn("source_chunk_id", tag("chunk_", "conv_id"))


def page_parts(t: Tables) -> DataFrame:
    """Host, last path segment, language and title of each page."""
    return t.pages.select(
        "page_id", "html", F.regexp_extract("url", "https?://([^/]+)", 1).alias("host"),
        F.regexp_extract("url", r"/([a-z]{2})/", 1).alias("lang"), F.regexp_extract("url", r"/(\d+)", 1).alias("number"),
        F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"),
    )


def _sql_pick(names, at: int) -> str:
    return f"{sql_list(names)}[{sql_digit(chr(39) + 'q' + chr(39) + ' || doc_id', at)} % {len(names)} + 1]"


def _sql_line(i: int) -> str:
    return f"l[('0x' || substr(md5('q' || doc_id || '|{i}'), 1, 8))::BIGINT % len(l) + 1]"


_KEY = "cond || '|' || id"
_LETTER = f"CASE WHEN {sql_digit(_KEY)} < 9 THEN correct_presented ELSE substr('ABCD', {sql_digit(_KEY, 2)} % 4 + 1, 1) END"
_NL = lambda s: q(s).replace("\n", "' || chr(10) || '")
_RAW = " ".join(f"WHEN {i} THEN {_NL(b)} || letter || {q(a)}" for i, (b, a) in enumerate(WORDINGS[:-1]))


def sql_order(key: str, seed: int = 42) -> str:
    tagged = ", ".join(f"md5('{seed}|' || {key} || '|{x}') || '{x}'" for x in fixed.LETTERS)
    return f"array_to_string(list_transform(list_sort([{tagged}]), lambda x: right(x, 1)), '')"


def sql_letter(raw: str) -> str:
    found = ", ".join(f"nullif(regexp_extract({raw}, {q('(?im)' + p)}, 1), '')" for p in fixed.ANSWER_PATTERNS)
    return f"upper(coalesce({found}))"


HEADER_SQL = "'[Document: ' || source || ' | Chapter: ' || lang || ' | Section: ' || section_title || ']' || chr(10) || chr(10)"

CTE = {
    "chunks": f"""SELECT doc_id AS ord, 'chunk_' || doc_id AS id, CASE WHEN lang = 'es' THEN 'table' ELSE 'text' END AS content_type,
        source AS document_name, section_title, CASE WHEN lang = 'fr' THEN text ELSE {HEADER_SQL} || text END AS text
        FROM (SELECT *, CASE WHEN source = 'src7' THEN 'Abstract' ELSE 'Section ' || source END AS section_title FROM documents)""",
    "lines": f"""SELECT doc_id, no, line, (no - 1) // {LINES_PER_PAGE} + 1 AS page, (no - 1) % {LINES_PER_PAGE} AS y, length(line) < 60 AS is_heading
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents)""",
    "questions": f"""SELECT doc_id, 'mcq_' || doc_id AS id, 'chunk_' || doc_id AS source_chunk_id, source AS document_name,
        'Which one? ' || {_sql_line(0)} AS question, {_sql_line(1)} AS a, {_sql_line(2)} AS b, {_sql_line(3)} AS c, {_sql_line(4)} AS d,
        {_sql_pick(fixed.LETTERS, 1)} AS correct, {_sql_line(5)} AS explanation,
        {_sql_pick(fixed.LEVELS, 2)} AS cognitive_level, {_sql_pick(fixed.TOPICS, 3)} AS topic FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents)""",
    "answers": f"""SELECT cond, id, correct, cognitive_level, letter_order, correct_presented,
        CASE {sql_digit(_KEY, 3)} % {len(WORDINGS)} {_RAW} ELSE {q(WORDINGS[-1][0])} END AS raw_output
        FROM (SELECT *, {_LETTER} AS letter FROM (SELECT *, substr('ABCD', instr(letter_order, correct), 1) AS correct_presented
        FROM (SELECT *, CASE WHEN cond = 'base' THEN 'ABCD' ELSE {sql_order('id')} END AS letter_order
        FROM (SELECT id, correct, cognitive_level, unnest({sql_list(CONDITIONS)}) AS cond FROM questions))))""",
    "scored": f"""SELECT *, coalesce(predicted = correct_presented, false) AS is_correct,
        CASE WHEN predicted IS NULL THEN 0.0::DOUBLE WHEN predicted = correct_presented THEN 1.0::DOUBLE ELSE -0.5::DOUBLE END AS penalised,
        {', '.join(f"CASE WHEN {sql_digit(_KEY, 4 + i)} > 0 THEN {sql_digit(_KEY, 4 + i)} % 5 + 1 END AS {m}" for i, m in enumerate(fixed.METRICS))}
        FROM (SELECT cond, id, cognitive_level, correct_presented, raw_output, {sql_letter('raw_output')} AS predicted FROM answers)""",
    "pairs": f"""SELECT *, {sql_list(CATEGORIES)}[{sql_digit("'p' || conv_id")} % 4 + 1] AS category, 'chunk_' || conv_id AS source_chunk_id
        FROM (SELECT u.conv_id + u.turn * {1 << 40} AS conv_id, u.text AS "user", a.text AS assistant
        FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')
        WHERE "user" IS NOT NULL AND assistant IS NOT NULL""",
    "page_parts": """SELECT page_id, html, regexp_extract(url, 'https?://([^/]+)', 1) AS host, regexp_extract(url, '/([a-z]{2})/', 1) AS lang,
        regexp_extract(url, '/(\\d+)', 1) AS number, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages""",
}
NEEDS = {"answers": ["questions"], "scored": ["questions", "answers"]}


def with_(*names: str, **extra: str) -> str:
    """WITH clause of named inputs, with what they need, and of extra ones in order."""
    order: list[str] = []
    for name in names:
        order += [n for n in [*NEEDS.get(name, []), name] if n not in order]
    parts = [f"{n} AS ({CTE[n]})" for n in order] + [f"{n} AS ({s})" for n, s in extra.items()]
    return "WITH " + ", ".join(parts) + " "


# SQL forms of the text expressions
def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '\\A[{SPACE}]+|[{SPACE}]+\\z', '', 'g')"


def sql_collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '[{SPACE}]+', ' ', 'g'))"


def sql_strip_header(c: str) -> str:
    return sql_strip(f"regexp_replace({c}, {q(fixed.HEADER)}, '')")


def sql_cut_header(c: str) -> str:
    return f"(CASE WHEN instr({c}, chr(10) || chr(10)) > 0 THEN substr({c}, instr({c}, chr(10) || chr(10)) + 2) ELSE {c} END)"


def sql_words(c: str) -> str:
    return f"len(regexp_extract_all({c}, '[^{SPACE}]+'))"


def sql_mentions(c: str, pattern: str = TOPIC_WORDS) -> str:
    return f"len(regexp_extract_all({c}, {q(pattern)}))"


def sql_tags(c: str) -> str:
    return f"regexp_replace({c}, '<[^>]+>', '', 'g')"


def sql_title_key(c: str) -> str:
    return f"regexp_replace(lower({sql_tags(c)}), '[^a-z0-9]', '', 'g')"


def sql_rank(key: str, seed, within: str = "") -> str:
    part = f"PARTITION BY {within} " if within else ""
    return f"row_number() OVER ({part}ORDER BY md5('{seed}|' || {key}), {key})"


def vector_index(t: Tables) -> metric_index.MetricIndex:
    """The index of the vectors with what a hit shows."""
    rows = t.embeddings.select("vec_id", "embedding", F.col("label").cast("string").alias("label"), F.lit("text").alias("content_type"))
    return metric_index.build(rows, "vec_id", "embedding", scratch_path(t.spark, "index"), ["content_type", "label"])
