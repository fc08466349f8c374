"""Landed service responses: article metadata, summaries, batch grading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftbook.functions import fixed
from siftbook.functions.grading import is_right, letter_or_null, penalised
from siftbook.functions.text import blank_to_null, canonical_doi, canonical_pmcid, last_segment, strip, title_key

WORK = (
    "ids struct<doi:string,pmid:string,pmcid:string>, "
    "authorships array<struct<author:struct<display_name:string>>>, "
    "primary_location struct<source:struct<display_name:string>,license:string>, "
    "title string, publication_year int, publication_date string"
)
SUMMARY = "result map<string,string>"
SUMMARY_DOC = "title string, authors array<struct<name:string>>"
RESPONSE = (
    "custom_id string, error string, response struct<body:struct<choices:array<struct<message:struct<content:string>>>>>"
)
SCORES = "predicted string, factual_accuracy int, coherence int, naturalness int, completeness int"


def normalise_work(raw: DataFrame, text: str) -> DataFrame:
    """Article columns of an open index's work record."""
    w = raw.withColumn("w", F.from_json(text, WORK))
    authors = F.transform(F.filter("w.authorships", lambda a: a["author"].isNotNull()), lambda a: F.coalesce(a["author"]["display_name"], F.lit("")))
    return w.withColumns({
        "doi": canonical_doi(F.col("w.ids.doi")),
        "pmid": last_segment(blank_to_null(F.col("w.ids.pmid"))),
        "pmcid": canonical_pmcid(last_segment(blank_to_null(F.col("w.ids.pmcid")))),
        "title": F.coalesce(F.col("w.title"), F.lit("")),
        "authors": F.coalesce(F.array_join(authors, ", "), F.lit("")),
        "journal": F.coalesce(F.col("w.primary_location.source.display_name"), F.lit("")),
        "pub_year": F.col("w.publication_year"),
        "pub_date": F.col("w.publication_date"),
        "license": F.col("w.primary_location.license"),
    }).drop("w", text)


def summary_documents(raw: DataFrame, text: str) -> DataFrame:
    """(uid, title, authors, title_key) of each document in a summary response."""
    entries = raw.select(F.explode(F.from_json(text, SUMMARY)["result"]).alias("uid", "doc")).filter(F.col("uid") != "uids")
    parsed = entries.select("uid", F.from_json("doc", SUMMARY_DOC).alias("d"))
    title = F.regexp_replace(strip(F.coalesce("d.title", F.lit(""))), r"\.+\z", "")
    authors = F.array_join(F.transform("d.authors", lambda a: F.coalesce(a["name"], F.lit(""))), "; ")
    return parsed.select("uid", title.alias("title"), F.coalesce(authors, F.lit("")).alias("authors"), title_key(title).alias("title_key"))


def batch_requests(df: DataFrame, key: str, system: str, prompt: Column, model: str) -> DataFrame:
    """One request line per row."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    body = F.struct(
        F.lit(model).alias("model"), F.array(turn("system", F.lit(system)), turn("user", prompt)).alias("messages"),
        F.lit(0.0).alias("temperature"), F.lit(100).alias("max_tokens"),
        F.struct(F.lit("json_object").alias("type")).alias("response_format"),
    )
    line = F.struct(
        F.col(key).cast("string").alias("custom_id"), F.lit("POST").alias("method"),
        F.lit("/v1/chat/completions").alias("url"), body.alias("body"),
    )
    return df.select(F.to_json(line).alias("value"))


def batch_scores(lines: DataFrame, text: str = "value") -> DataFrame:
    """Scores of each response line with a problem: 'error', 'malformed' or null."""
    parsed = lines.filter(F.trim(text) != "").select(F.from_json(text, RESPONSE).alias("r"))
    content = F.get("r.response.body.choices", 0)["message"]["content"]
    read = parsed.select("r.custom_id", "r.error", F.col("r.response.body").isNull().alias("_empty"), F.from_json(content, SCORES + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("s"))
    problem = (
        F.when(F.col("error").isNotNull() | F.col("_empty"), "error")
        .when(F.col("s").isNull() | F.col("s._bad").isNotNull(), "malformed")
    )
    return read.select("custom_id", problem.alias("problem"), "s.*").drop("_bad")


def scored_responses(scores: DataFrame, requests: DataFrame) -> DataFrame:
    """Good responses joined to their requests (id, correct_presented) and scored."""
    joined = scores.filter(F.col("problem").isNull()).join(requests, F.col("custom_id") == requests["id"])
    letter = joined.withColumn("predicted", letter_or_null(F.col("predicted")))
    return letter.withColumn("is_correct", is_right(F.col("predicted"), F.col("correct_presented"))).withColumn(
        "penalised", penalised(F.col("predicted"), F.col("correct_presented"))
    ).drop("custom_id", "problem")


def nested_reviews(reviews: DataFrame, note_chars: int | None = fixed.NOTE_CHARS) -> DataFrame:
    """Reviews (qid, reviewer, verdict, notes, ts) as one JSON object per question.

    Together the rows are the export document: each holds the reviewers of one question. Notes are cut to
    ``note_chars``, or kept whole if it is None.
    """
    notes = F.col("notes") if note_chars is None else F.left("notes", F.lit(note_chars)).alias("notes")
    entry = F.struct("verdict", notes, "ts")
    by_name = F.map_from_entries(F.array_sort(F.collect_list(F.struct("reviewer", entry.alias("e")))))
    return reviews.groupBy("qid").agg(F.to_json(by_name).alias("reviews"))
