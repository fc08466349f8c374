"""From raw documents to packed training sequences, one operator a stage.

Each stage gets what its predecessor kept and decides by ``doc_id`` and ``text``; all but the last return the
columns of their input unchanged, also if those share a name with what an operator computes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftbook.llm import decontamination, language, near_dedup, packing, quality, queries
from siftbook.session import stage

#: A text further than this from all learned languages has none of them.
LEAST_COSINE = 0.05


def _marked(docs: DataFrame) -> DataFrame:
    """The documents as one column beside what the operators read, so that no names clash."""
    return docs.select("doc_id", "text", *(["lang"] if "lang" in docs.columns else []), *(["source"] if "source" in docs.columns else []), F.struct("*").alias("_row"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those unlike every learned language."""
    profiles = language.learn(docs)
    rows = language.identify(_marked(docs), profiles, keep=["_row"])
    known = (F.col("lang_pred") != "und") & (F.col("score") >= LEAST_COSINE)
    return rows.filter(known).select("_row.*")


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules, or others on hosts that are not trusted."""
    return quality.judged(_marked(docs), keep=["_row"]).filter("kept").select("_row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies only the document with the lowest id stays, and one of rows that repeat an id."""
    copies = near_dedup.classes(docs).filter("NOT kept").select("doc_id").distinct()
    kept = docs.select("doc_id", F.struct("*").alias("_row")).join(copies, "doc_id", "left_anti")
    unnamed = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    return kept.withColumn("_unnamed", unnamed).dropDuplicates(["doc_id", "_unnamed"]).select("_row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a benchmark passage."""
    found = decontamination.find_passages(_marked(docs), queries.table(spark, sf_dir, "benchmark"), keep=["_row"])
    return found.filter("n_hit = 0").select("_row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document, placed in sequences of 4096."""
    return packing.pack(packing.token_pieces(docs, queries.vocabulary()))


STAGES = [
    ("language ID", identify_language),
    ("quality rules", judge_quality),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack_sequences),
]

#: Learned language profiles, tokens and packing are not SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
