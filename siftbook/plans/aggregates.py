"""Aggregations: document quality, grading, consensus, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftbook.functions import fixed
from siftbook.functions.text import content_key, strip_header, word_count
from siftbook.operators import evaluation as E
from siftbook.operators import pairs as P
from siftbook.operators import quality as Q
from siftbook.operators import languages, ranking, records, retrieval
from siftbook.operators.dedup import drop_copies
from siftbook.plans import inputs as I
from siftbook.plans.inputs import q, sql_digit, sql_mentions, sql_rank, sql_strip_header, sql_words, with_
from siftbook.plans.joins import PICKED_SQL, VECTORS_SQL, VIEWS_SQL, sql_hits, views
from siftbook.plans.projections import (
    AUDIT_FLAGS, AUDIT_RECORDS_SQL, AUDIT_SQL, ENTITY_PAIRS_SQL, LEARNED_CTES, audited, entity_pairs, leaky_pairs, LEAKY_SQL, sql_detected, sql_entities, sql_language,
)
from siftbook.plans.registry import Tables, query
from siftbook.session import scratch_path, stage
from siftbook.sources import files as S

TOPIC, LEAST = I.TOPIC_WORDS, 20


@query("e1_document_regroup", "SELECT conv_id, md5(string_agg(text, ' ' ORDER BY turn)) AS digest, count(*) AS n_chunks FROM conversations GROUP BY conv_id")
def _(t: Tables) -> DataFrame:
    return Q.regroup(t.conversations, "conv_id", "turn", "text").select("conv_id", F.md5("full_text").alias("digest"), "n_chunks")


# opening text and mentions per document, then the reason to drop it
DECISIONS_SQL = f"""SELECT document_name, CASE WHEN lang <> 'en' THEN 'NON_ENGLISH' WHEN mentions < {LEAST} THEN 'OFF_TOPIC_LOW_MENTIONS' END AS reason, lang AS detected_lang, mentions, n_chunks
    FROM (SELECT document_name, {sql_language('whole')} AS lang, mentions, n_chunks FROM (SELECT document_name, string_agg(body, ' ' ORDER BY ord) AS whole,
    sum({sql_mentions('body', TOPIC)})::BIGINT AS mentions, count(*) AS n_chunks FROM (SELECT document_name, ord, {sql_strip_header('text')} AS body FROM doc_chunks) GROUP BY document_name))"""
# a document is what a source has in one language within a hundred ids
DOC_CHUNKS_SQL = "SELECT ord, source || '-' || lang || '-' || (ord // 100) AS document_name, c.text FROM chunks c JOIN documents d ON d.doc_id = c.ord"


def doc_chunks(t: Tables) -> DataFrame:
    return I.chunks(t).select("ord", "id", F.concat_ws("-", "document_name", "lang", F.floor(F.col("ord") / 100)).alias("document_name"), "text")


def decisions(t: Tables) -> DataFrame:
    return Q.decide_documents(doc_chunks(t), "document_name", "text", topic=TOPIC, least=LEAST)


@query("e2_document_decisions", with_("chunks", doc_chunks=DOC_CHUNKS_SQL) + DECISIONS_SQL)
def _(t: Tables) -> DataFrame:
    return decisions(t)


LEARNED_SQL = f"""SELECT document_name, CASE WHEN detected_lang <> 'en' THEN 'NON_ENGLISH' WHEN mentions < {LEAST} THEN 'OFF_TOPIC_LOW_MENTIONS' END AS reason, detected_lang, mentions, n_chunks
    FROM (SELECT document_name, sum({sql_mentions('body', TOPIC)})::BIGINT AS mentions, count(*) AS n_chunks FROM bodies GROUP BY document_name) JOIN ({sql_detected('bodies', 'document_name', 'body')}) ON key = document_name"""


@query("e2_learned_language", with_("chunks", doc_chunks=DOC_CHUNKS_SQL, bodies=f"SELECT document_name, {sql_strip_header('text')} AS body FROM doc_chunks", **LEARNED_CTES) + LEARNED_SQL)
def _(t: Tables) -> DataFrame:
    return Q.decide_documents(doc_chunks(t), "document_name", "text", topic=TOPIC, least=LEAST, profiles=languages.learn(t.documents, "text", "lang"))


@query("e2_chunks_follow_document", with_("chunks", doc_chunks=DOC_CHUNKS_SQL, d=DECISIONS_SQL) + "SELECT ord, coalesce(reason, 'kept') AS outcome FROM doc_chunks JOIN d USING (document_name)")
def _(t: Tables) -> DataFrame:
    return Q.split_by_decision(doc_chunks(t), decisions(t), "document_name").select("ord", F.coalesce("reason", F.lit("kept")).alias("outcome"))


@query("a7_csv_report", with_("chunks", doc_chunks=DOC_CHUNKS_SQL, d=DECISIONS_SQL) + "SELECT document_name, reason, detected_lang, mentions, n_chunks FROM d WHERE reason IS NOT NULL")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "a7")
    S.write_csv_report(decisions(t).filter("reason IS NOT NULL"), path)
    return S.read_csv_report(t.spark, path, "document_name string, reason string, detected_lang string, mentions long, n_chunks long")


@query("e3_status_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"))


@query("e4_drop_repeated_blocks", with_("lines") + "SELECT source, line, count(*) AS n FROM (SELECT source, line FROM lines JOIN documents USING (doc_id) QUALIFY NOT (count(*) OVER (PARTITION BY source, " + I.sql_strip('line') + ") > 3 AND length(" + I.sql_strip('line') + ") < 200)) GROUP BY source, line")
def _(t: Tables) -> DataFrame:
    blocks = I.lines(t).join(t.documents.select("doc_id", "source"), "doc_id")
    return Q.drop_repeated(blocks, "source", "line").groupBy("source", "line").agg(F.count("*").alias("n"))


@query("e5_upper_median", "SELECT l_orderkey, list_sort(list(l_quantity))[count(*) // 2 + 1] AS median_size FROM lineitem GROUP BY l_orderkey")
def _(t: Tables) -> DataFrame:
    return Q.upper_median(t.lineitem, ["l_orderkey"], "l_quantity")


@query("e6_block_style", """SELECT l_orderkey, round(sum(l_quantity * n) / sum(n), 6) AS avg_size, round(sum(CASE WHEN l_returnflag = 'R' THEN n ELSE 0 END) / sum(n), 3) AS mono_ratio,
    sum(CASE WHEN l_linestatus = 'O' THEN n ELSE 0 END) / sum(n) > 0.6 AS is_bold FROM (SELECT *, length(l_extendedprice::BIGINT::VARCHAR) AS n FROM lineitem) GROUP BY l_orderkey""")
def _(t: Tables) -> DataFrame:
    spans = t.lineitem.select(
        "l_orderkey", F.round("l_extendedprice").cast("long").cast("string").alias("text"), F.col("l_quantity").alias("size"),
        (F.col("l_returnflag") == "R").alias("mono"), (F.col("l_linestatus") == "O").alias("bold"),
    )
    return Q.block_style(spans, ["l_orderkey"], "text", "size", "mono", "bold").withColumn("avg_size", F.round("avg_size", 6))


DIFFICULTY_SQL = """SELECT q.id, q.document_name, q.question, q.topic, q.cognitive_level, n_cond, n_correct, right_in, wrong_in,
    coalesce(top.picked_letter <> q.correct AND top.votes >= greatest(3.0, 0.6 * top.picks), false) AS key_suspect, CASE WHEN top.picked_letter <> q.correct AND top.votes >= greatest(3.0, 0.6 * top.picks) THEN top.picked_letter END AS suspect_letter
    FROM questions q JOIN (SELECT id, count(*) AS n_cond, count(*) FILTER (WHERE is_correct) AS n_correct, coalesce(string_agg(cond, ',' ORDER BY cond) FILTER (WHERE is_correct), '') AS right_in,
    coalesce(string_agg(cond, ',' ORDER BY cond) FILTER (WHERE NOT is_correct), '') AS wrong_in FROM picked GROUP BY id) v USING (id)
    LEFT JOIN (SELECT * FROM (SELECT *, sum(votes) OVER (PARTITION BY id) AS picks, row_number() OVER (PARTITION BY id ORDER BY votes DESC, f) AS r FROM (SELECT id, picked_letter, count(*) AS votes, min(cond) AS f FROM picked WHERE picked_letter IS NOT NULL GROUP BY id, picked_letter)) WHERE r = 1) top USING (id)"""


def difficulty(t: Tables) -> DataFrame:
    questions = I.questions(t).select("id", "document_name", "question", "topic", "cognitive_level", "correct")
    return E.question_difficulty(views(t), questions)


@query("e7_question_difficulty", with_("scored", views=VIEWS_SQL, picked=PICKED_SQL, d=DIFFICULTY_SQL) + "SELECT id, n_cond, n_correct, right_in, wrong_in, key_suspect, suspect_letter FROM d")
def _(t: Tables) -> DataFrame:
    return difficulty(t).select("id", "n_cond", "n_correct", "right_in", "wrong_in", "key_suspect", "suspect_letter")


_FILTERS = (
    ("level", dict(level="recall"), "cognitive_level = 'recall'"),
    ("topic", dict(topic="vaccine"), "topic = 'vaccine'"),
    ("wrong_in", dict(wrong_in="base"), "contains(wrong_in, 'base')"),
    ("right_in", dict(right_in="tuned", text="SRC1"), "contains(right_in, 'tuned') AND contains(lower(question || ' ' || document_name), 'src1')"),
    ("allright", dict(result="allright"), "n_correct = n_cond"),
    ("allwrong", dict(result="allwrong"), "n_correct = 0"),
    ("mixed", dict(result="mixed"), "n_correct > 0 AND n_correct < n_cond"),
    ("suspect", dict(result="suspect"), "key_suspect"),
    ("flagged", dict(review="flagged"), "topic IN ('biofilm', 'genomics')"),
)


@query("b17_review_list", with_("scored", views=VIEWS_SQL, picked=PICKED_SQL, d=DIFFICULTY_SQL) + " UNION ALL ".join(f"SELECT id, {q(n)} AS list FROM d WHERE {c}" for n, _, c in _FILTERS))
def _(t: Tables) -> DataFrame:
    rows = difficulty(t).withColumn("review", F.when(F.col("topic").isin("biofilm", "genomics"), "flagged").otherwise("good"))
    rows = stage(rows, "difficulty")  # nine lists read the same rows
    out = None
    for name, conditions, _sql in _FILTERS:
        part = E.review_list(rows, **conditions).select("id", F.lit(name).alias("list"))
        out = part if out is None else out.unionByName(part)
    return out


@query("g2_hardest_first", with_("scored", views=VIEWS_SQL, picked=PICKED_SQL, d=DIFFICULTY_SQL) + "SELECT id, n_correct / n_cond AS fraction, row_number() OVER (ORDER BY n_correct / n_cond, id) AS place FROM d")
def _(t: Tables) -> DataFrame:
    rows = difficulty(t).select("id", (F.col("n_correct") / F.col("n_cond")).alias("fraction"))
    return ranking.ordered_rank(rows, [F.col("fraction"), F.col("id")], name="place")


_R = lambda c, a: f"round({c}, 6) AS {a}"


def rounded(df: DataFrame, *skip: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if k == "double" and c not in skip else F.col(c) for c, k in df.dtypes])


@query("e8_grading_summary", with_("scored") + f"""SELECT cond, count(*) AS n, count(*) FILTER (WHERE is_correct) AS n_correct, count(*) FILTER (WHERE predicted IS NULL) AS n_no_answer, count(*) FILTER (WHERE NOT is_correct AND predicted IS NOT NULL) AS n_wrong,
    {_R('avg(is_correct::INT)', 'accuracy')}, {_R('avg(penalised)', 'penalised_accuracy')}, {', '.join(_R(f'avg(coalesce({m}, 0))', f'avg_{m}') for m in fixed.METRICS)} FROM scored GROUP BY cond""")
def _(t: Tables) -> DataFrame:
    return rounded(E.grading_summary(I.scored(t), ["cond"]))


@query("e9_leaderboard", with_("scored", s="SELECT s.*, q.topic IN ('biofilm', 'genomics') AS flagged FROM scored s JOIN questions q USING (id)") + f"""SELECT cond, {_R('avg(is_correct::INT)', 'overall')}, {_R('avg(is_correct::INT) FILTER (WHERE NOT flagged)', 'excluding_flagged')},
    count(*) FILTER (WHERE NOT flagged) AS n_excluding_flagged, {', '.join(_R(f"avg(is_correct::INT) FILTER (WHERE cognitive_level = '{x}')", f'level_{x}') for x in fixed.LEVELS)}, count(*) FILTER (WHERE predicted IS NULL) AS no_answer,
    {', '.join(_R(f'avg({m})', f'judge_{m}') for m in fixed.METRICS)} FROM s GROUP BY cond""")
def _(t: Tables) -> DataFrame:
    questions = I.questions(t)
    flagged = questions.filter(F.col("topic").isin("biofilm", "genomics"))
    return rounded(E.leaderboard(I.scored(t).drop("cognitive_level"), questions, flagged))


@query("e10_review_state", "SELECT user_id AS qid, count(*) AS n_reviews, CASE WHEN bool_and(event_type IN ('view', 'click', 'signup')) THEN 'good' ELSE 'flagged' END AS review FROM events GROUP BY user_id")
def _(t: Tables) -> DataFrame:
    verdict = F.when(F.col("event_type").isin("view", "click", "signup"), "good").otherwise("wrong_key")
    return E.review_state(t.events.select(F.col("user_id").alias("qid"), verdict.alias("verdict")))


@query("e11_score_statistics", "SELECT count(*) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS sd, max(value) AS top, min(value) AS low FROM events WHERE event_type <> 'error'")
def _(t: Tables) -> DataFrame:
    # scores of failed rows are NaN
    scores = t.events.select(F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value")).alias("s")).filter(~F.isnan("s"))
    return scores.agg(F.count("*").alias("n"), F.round(F.avg("s"), 4).alias("mean"), F.round(F.stddev_pop("s"), 4).alias("sd"), F.max("s").alias("top"), F.min("s").alias("low"))


JUDGED_SQL = f"""SELECT conv_id, {sql_digit("'42|' || conv_id")} % 2 = 0 AS a_shown_first, ['1', '2', 'tie', 'none'][{sql_digit("'w' || conv_id")} % 4 + 1] AS verdict FROM pairs"""


@query("e12_win_tally", with_("pairs", j=JUDGED_SQL) + """SELECT CASE WHEN verdict = 'tie' THEN 'tie' WHEN a_shown_first = (verdict = '1') THEN 'base' ELSE 'tuned' END AS winner, a_shown_first, count(*) AS n FROM j WHERE verdict <> 'none' GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    shown = E.show_in_random_order(I.pairs(t).select("conv_id", F.col("user").alias("a"), F.col("assistant").alias("b")), "conv_id")
    verdict = F.element_at(F.array(*[F.lit(v) for v in ("1", "2", "tie", "none")]), F.pmod(I.digit(I.tag("w", "conv_id")), F.lit(4)) + 1)
    return E.win_tally(E.resolve_winner(shown.withColumn("verdict", verdict), "base", "tuned"))


CHECKED_SQL = f"""SELECT conv_id, words, leak, len(x) AS n, round(CASE WHEN len(x) > 0 THEN len(g) / len(x) END, 2) AS grounding, array_to_string(list_sort(list_filter(x, lambda e: NOT list_contains(g, e)))[1:12], ' ') AS missing
    FROM (SELECT *, list_filter(x, lambda e: contains(lower(passage), lower(e))) AS g FROM (SELECT conv_id, passage, {sql_words('assistant')} AS words, regexp_matches(assistant, {q(fixed.META_LEAK)}) AS leak, {sql_entities('assistant')} AS x FROM e))"""


def checked(t: Tables) -> DataFrame:
    checks = P.auto_checks(F.col("assistant"), F.col("passage"))
    return entity_pairs(t).select("conv_id", *[c.alias(n) for n, c in checks.items()])


@query("e22_entity_grounding", with_("pairs", e=ENTITY_PAIRS_SQL, c=CHECKED_SQL) + "SELECT conv_id, words, n AS n_entities, grounding AS entity_grounding, missing AS ungrounded FROM c")
def _(t: Tables) -> DataFrame:
    return checked(t).select("conv_id", "words", "n_entities", "entity_grounding", F.array_join("ungrounded_entities", " ").alias("ungrounded"))


@query("e13_qc_summary", with_("pairs", leaky=LEAKY_SQL, e=ENTITY_PAIRS_SQL.replace("FROM pairs", "FROM leaky"), c=CHECKED_SQL) + """SELECT count(*) AS n_pairs, count(*) FILTER (WHERE leak) AS n_leaks, count(*) FILTER (WHERE words NOT BETWEEN 150 AND 300) AS n_outside_words,
    round(avg(grounding), 6) AS mean_grounding, count(*) FILTER (WHERE grounding < 0.5) AS n_low_grounding FROM c""")
def _(t: Tables) -> DataFrame:
    leaky = leaky_pairs(t).select("conv_id", F.col("assistant").alias("leaky"))
    pairs = entity_pairs(t).join(leaky, "conv_id")
    # the entity sentence follows the answer, leaked or not
    tail = F.substring("assistant", F.instr("assistant", " The DNA of "), F.length("assistant"))
    answer = F.concat("leaky", tail)
    checks = P.auto_checks(answer, F.col("passage"))
    return rounded(P.qc_summary(pairs.select(*[c.alias(n) for n, c in checks.items()])))


@query("e13_claim_summary", """WITH c AS (SELECT doc_id, CASE WHEN line LIKE '%z%' THEN 'contradicted' WHEN length(line) % 2 = 0 THEN 'supported' ELSE 'unsupported' END AS v FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))
    SELECT count(*) AS n_claims, count(*) FILTER (WHERE v = 'supported') AS supported, count(*) FILTER (WHERE v = 'unsupported') AS unsupported, count(*) FILTER (WHERE v = 'contradicted') AS contradicted,
    count(DISTINCT doc_id) FILTER (WHERE v = 'contradicted') AS pairs_contradicted, count(DISTINCT doc_id) AS n_pairs FROM c""")
def _(t: Tables) -> DataFrame:
    verdict = F.when(F.contains("line", F.lit("z")), "contradicted").when(F.length("line") % 2 == 0, "supported").otherwise("unsupported")
    return P.claim_summary(I.lines(t).select("doc_id", verdict.alias("verdict")), "doc_id", "verdict")


# dates of an order stand for the dates several sources give for an article
EVIDENCE_SQL = """SELECT o_orderkey, o_orderstatus, d AS earliest, src, CASE WHEN d IS NULL THEN 'AMBIGUOUS' WHEN d < DATE '1998-01-01' THEN 'EXCLUDE' ELSE 'INCLUDE' END AS decision,
    CASE WHEN d IS NULL THEN 'AMBIGUOUS_DATE' WHEN d < DATE '1998-01-01' AND src LIKE '%preprint%' THEN 'PRE_CUTOFF_PREPRINT' WHEN d < DATE '1998-01-01' THEN 'PRE_CUTOFF_EPUBLICATION' ELSE 'POST_CUTOFF_CONFIRMED' END AS reason,
    CASE WHEN d IS NULL THEN 'No date evidence from any source' ELSE concat_ws(' | ', 'index.firstPublicationDate=' || a, 'index.pubYear(day-imprecise)=' || b, 'registry.created=' || c, 'registry.preprint=' || p) END AS evidence
    FROM (SELECT *, least(a, b, c, p) AS d, CASE least(a, b, c, p) WHEN a THEN 'index.firstPublicationDate' WHEN b THEN 'index.pubYear(day-imprecise)' WHEN c THEN 'registry.created' WHEN p THEN 'registry.preprint' END AS src
    FROM (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderpriority[1] = '1' THEN CAST(o_orderdate AS DATE) END AS a, CASE WHEN o_orderpriority[1] = '2' THEN make_date(year(o_orderdate)::INT, 1, 1) END AS b, c,
    CASE WHEN o_orderstatus = 'P' THEN c - 400 END AS p FROM orders LEFT JOIN (SELECT l_orderkey, CAST(min(l_shipdate) AS DATE) AS c FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_orderkey) ON l_orderkey = o_orderkey))"""
ORDER_CUTOFF = "1998-01-01"


def dated_orders(t: Tables) -> DataFrame:
    shipped = t.lineitem.filter("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.min("l_shipdate")).alias("created"))
    rows = t.orders.join(shipped, "o_orderkey", "left")
    level = F.left("o_orderpriority", F.lit(1))
    published = F.when(level == "1", F.date_format("o_orderdate", "yyyy-MM-dd"))
    year = F.when(level == "2", F.year("o_orderdate"))
    sources = records.article_dates(published, year) + [
        ("registry.created", F.col("created")), ("registry.preprint", F.when(F.col("o_orderstatus") == "P", F.date_sub("created", 400))),
    ]
    return records.earliest_public(rows, sources, ORDER_CUTOFF)


@query("e14_earliest_date", with_(ev=EVIDENCE_SQL) + "SELECT o_orderkey, CAST(earliest AS VARCHAR) AS earliest, src, decision, reason, evidence FROM ev")
def _(t: Tables) -> DataFrame:
    return dated_orders(t).select("o_orderkey", F.col("earliest_public_date").cast("string").alias("earliest"), F.col("earliest_source").alias("src"), "decision", "reason", "evidence")


@query("b20_status_assignment", with_(ev=EVIDENCE_SQL) + """SELECT o_orderkey, CASE WHEN decision <> 'INCLUDE' THEN reason WHEN l.doc_id IS NULL THEN 'NO_LEGAL_FULLTEXT' WHEN quality = 0 THEN 'DUPLICATE' ELSE 'OK' END AS reason,
    CASE WHEN decision = 'INCLUDE' AND quality = 1 THEN 'accepted_downloaded' ELSE 'rejected' END AS status FROM ev LEFT JOIN labels l ON l.doc_id = o_orderkey""")
def _(t: Tables) -> DataFrame:
    joined = dated_orders(t).join(t.labels.withColumnRenamed("doc_id", "o_orderkey"), "o_orderkey", "left")
    done = records.assign_status(joined, F.col("quality").isNotNull(), F.coalesce(F.col("quality") == 0, F.lit(False)))
    return done.select("o_orderkey", "reason", "status")


@query("i7_cutoff_control", with_(ev=EVIDENCE_SQL) + "SELECT o_orderkey, CAST(earliest AS VARCHAR) AS earliest FROM ev WHERE decision = 'INCLUDE'")
def _(t: Tables) -> DataFrame:
    kept = dated_orders(t).filter("decision = 'INCLUDE'")
    return kept.select("o_orderkey", F.col("earliest_public_date").cast("string").alias("earliest"))


@query("e15_audit_totals", with_("pairs", audit_records=AUDIT_RECORDS_SQL, a=AUDIT_SQL) + f"""SELECT count(*) AS n, {', '.join(f'count(*) FILTER (WHERE {f}) AS {f}' for f in AUDIT_FLAGS)}, count(*) FILTER (WHERE {' OR '.join(AUDIT_FLAGS)}) AS n_flagged FROM a""")
def _(t: Tables) -> DataFrame:
    return P.audit_totals(audited(t), list(AUDIT_FLAGS))


@query("e16_answer_positions", with_("questions") + "SELECT correct, count(*) AS n, round(count(*) / (SELECT count(*) FROM questions), 6) AS share FROM questions GROUP BY correct")
def _(t: Tables) -> DataFrame:
    return rounded(E.position_shares(I.questions(t), "correct"))


_BOTH_SQL = "SELECT a.id, a.is_correct AS x, b.is_correct AS y, a.coherence - b.coherence AS gap FROM scored a JOIN scored b ON a.id = b.id AND a.cond = 'base' AND b.cond = 'retrieval'"


@query("e17_flip_table", with_("scored", z=_BOTH_SQL) + "SELECT count(*) AS n, count(*) FILTER (WHERE x AND y) AS both_right, count(*) FILTER (WHERE NOT x AND NOT y) AS both_wrong, count(*) FILTER (WHERE x AND NOT y) AS right_to_wrong, count(*) FILTER (WHERE NOT x AND y) AS wrong_to_right FROM z")
def _(t: Tables) -> DataFrame:
    return E.flip_table(I.scored(t), "base", "retrieval")


_HALF = "atan(abs(t) / sqrt(n - 1))"
_TERMS = f"list_sum(list_transform(range(0, ((n - 1) - (n - 1) % 2) // 2), lambda j: CASE (n - 1) % 2 WHEN 1 THEN exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)) * pow(cos({_HALF}), 2 * j + 1) ELSE exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) * pow(cos({_HALF}), 2 * j) END))"


# whole degrees of freedom have a finite series of cosines, the exact test a finite sum
@query("e18_paired_tests", with_("scored", z=_BOTH_SQL, s="SELECT count(*) FILTER (WHERE x AND NOT y) AS b, count(*) FILTER (WHERE NOT x AND y) AS c, count(gap) AS n, avg(gap) AS mean_gap, stddev_samp(gap) AS sd_gap FROM z", u="SELECT *, mean_gap / (sd_gap / sqrt(n)) AS t FROM s") + f"""SELECT b, c, n, round(mean_gap, 6) AS mean_gap, round(sd_gap, 6) AS sd_gap, round(greatest(abs(b - c) - 1, 0) * greatest(abs(b - c) - 1, 0) / (b + c), 6) AS mcnemar, round(t, 6) AS t,
    round(least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda k: exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2))))), 6) AS mcnemar_p,
    round(1 - CASE (n - 1) % 2 WHEN 1 THEN ({_HALF} + sin({_HALF}) * coalesce({_TERMS}, 0)) * 2 / pi() ELSE sin({_HALF}) * {_TERMS} END, 6) AS t_p FROM u""")
def _(t: Tables) -> DataFrame:
    return rounded(E.paired_tests(I.scored(t), "base", "retrieval", "coherence"))


@query("e19_accuracy_by_gate", with_("scored", vectors=VECTORS_SQL, hits=sql_hits(1)) + """SELECT s.cond, h.distance <= 0.9 AS used_context, count(*) AS n, round(avg(s.is_correct::INT), 6) AS accuracy FROM scored s JOIN hits h ON s.id = 'mcq_' || h.query_id GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    hits = retrieval.nearest(t.embeddings, t.embeddings, "vec_id", "embedding", 1, exclude_self=True)
    gates = hits.select(I.tag("mcq_", "query_id").alias("id"), (F.col("distance") <= 0.9).alias("used_context"))
    return rounded(E.accuracy_by(I.scored(t).join(gates, "id"), "cond", "used_context"))


@query("e20_gate_threshold", with_(vectors=VECTORS_SQL, hits=sql_hits(1)) + """SELECT round((SELECT median(distance) FROM hits), 6) AS threshold, tercile, count(*) AS n, round(min(distance), 6) AS low, round(max(distance), 6) AS high
    FROM (SELECT distance, ntile(3) OVER (ORDER BY distance, query_id) AS tercile FROM hits) GROUP BY tercile""")
def _(t: Tables) -> DataFrame:
    hits = retrieval.nearest(t.embeddings, t.embeddings, "vec_id", "embedding", 1, exclude_self=True)
    hits = stage(hits.select("query_id", "distance"), "hits")
    threshold = F.lit(ranking.exact_median(hits, "distance")).cast("double")
    cut = ranking.tiles(hits, "distance", "query_id", 3, "tercile")
    return rounded(cut.groupBy("tercile").agg(F.count("*").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high")).withColumn("threshold", threshold))


@query("e21_corpus_totals", with_("chunks", doc_chunks=DOC_CHUNKS_SQL, d=DECISIONS_SQL) + "SELECT count(*) AS documents, sum(n_chunks)::BIGINT AS chunks, count(*) FILTER (WHERE reason IS NULL) AS kept_documents, coalesce(sum(n_chunks) FILTER (WHERE reason IS NULL), 0)::BIGINT AS kept_chunks, count(*) FILTER (WHERE reason = 'NON_ENGLISH') AS non_english FROM d")
def _(t: Tables) -> DataFrame:
    kept = F.col("reason").isNull()
    return decisions(t).agg(
        F.count("*").alias("documents"), F.sum("n_chunks").alias("chunks"), F.count_if(kept).alias("kept_documents"),
        F.coalesce(F.sum(F.when(kept, F.col("n_chunks"))), F.lit(0)).alias("kept_chunks"), F.count_if(F.col("reason") == "NON_ENGLISH").alias("non_english"),
    )


@query("e23_completeness", "SELECT source, e.n AS n_expected, coalesce(f.n, 0) AS n_found, coalesce(f.n, 0) >= e.n AS complete FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) e LEFT JOIN (SELECT source, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source) f USING (source)")
def _(t: Tables) -> DataFrame:
    expected = t.documents.groupBy("source").agg(F.count("*").alias("n_expected"))
    return Q.completeness(t.documents.join(t.labels, "doc_id", "left_semi"), expected, "source")


# -- flagship --------------------------------------------------------------------------------


@query("corpus_preparation", with_("chunks", doc_chunks=DOC_CHUNKS_SQL, d=DECISIONS_SQL, kept=f"""SELECT c.ord, c.document_name, d.text FROM doc_chunks c JOIN d x USING (document_name) JOIN documents d ON d.doc_id = c.ord WHERE x.reason IS NULL
    QUALIFY row_number() OVER (PARTITION BY coalesce(nullif(regexp_replace(lower(d.text), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), ''), 'row ' || c.ord) ORDER BY c.ord) = 1""", held="SELECT document_name FROM (SELECT DISTINCT document_name FROM kept) ORDER BY md5('42|' || document_name), document_name LIMIT 3") + f"""
    SELECT CASE WHEN document_name IN (SELECT document_name FROM held) THEN 'eval' ELSE 'train' END AS split, count(DISTINCT document_name) AS documents, count(*) AS chunks, sum({sql_words('text')})::BIGINT AS words FROM kept GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    kept = Q.split_by_decision(doc_chunks(t), decisions(t), "document_name").filter("reason IS NULL")
    body = kept.withColumn("body", strip_header(F.col("text"))).select("ord", "document_name", "body")
    key = content_key(F.col("body"))
    distinct = drop_copies(body.withColumn("words", word_count(F.col("body"))).select("ord", "document_name", "words", key.alias("key")), "ord", F.col("key"))
    # the holdout reads the rows twice
    split = ranking.holdout_documents(stage(distinct.select("ord", "document_name", "words"), "distinct"), "document_name", 3)
    return split.groupBy("split").agg(F.count_distinct("document_name").alias("documents"), F.count("*").alias("chunks"), F.sum("words").alias("words"))
