"""JSON lines, JSON arrays, tab-separated tables, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    """One record per line; blank lines are skipped. ``path`` may be a glob or a list."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def parse_lines(lines: DataFrame, text: str, schema: str) -> DataFrame:
    """Parse JSON text; rows that do not parse keep their text in ``_corrupt``."""
    parsed = F.from_json(text, f"{schema}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT})
    rest = [c for c in lines.columns if c != text]
    return lines.filter(F.trim(text) != "").select(*rest, parsed.alias("_p")).select(*rest, "_p.*")


def read_jsonl_tolerant(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """As :func:`read_jsonl`, malformed lines are marked and not fatal."""
    return parse_lines(spark.read.text(path), "value", schema)


def read_json_array(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    """Files that hold one JSON array of records each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_tsv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Tab-separated file with a header and no quoting."""
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").csv(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def write_csv_report(df: DataFrame, path: str) -> None:
    """CSV with header; quotes inside fields are doubled."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def write_scores(df: DataFrame, path: str, key: str, score: str) -> None:
    """Scores by id; they are joined by id later, never by position."""
    df.select(key, score).write.mode("overwrite").parquet(path)


def sample_report(sample: DataFrame, category: Column, total: Column, number: Column, source: Column, user: Column, assistant: Column) -> DataFrame:
    """Text block of each numbered sample, with a heading in front of a category's first."""
    # fixed: the layout of the report
    rule = "=" * 80
    head = F.concat(F.lit(f"{rule}\nCATEGORY: "), category, F.lit("  ("), total.cast("string"), F.lit(f" total in dataset)\n{rule}\n\n"))
    body = F.concat(
        F.lit("--- example "), number.cast("string"), F.lit(" (source: "), source, F.lit(") ---\nUSER:\n"), user,
        F.lit("\n\nASSISTANT:\n"), assistant, F.lit("\n\n"),
    )
    return sample.withColumn("block", F.when(number == 1, F.concat(head, body)).otherwise(body))


def write_text_report(df: DataFrame, path: str, order: list[str], block: str = "block") -> None:
    """Text files whose parts follow the order."""
    df.sort(*order).select(block).write.mode("overwrite").text(path)


def read_conditions(spark: SparkSession, folder: str, scored: str, raw: str) -> DataFrame:
    """All ``<cond>_scored.jsonl`` results of a folder with the raw output of ``<cond>.jsonl``."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+?)(_scored)?\.jsonl(/[^/]*)?$", 1)
    graded = spark.read.schema(scored).json(f"{folder}/*_scored.jsonl").withColumn("cond", name)
    plain = spark.read.schema(raw).json(f"{folder}/*.jsonl").withColumn("cond", name)
    is_raw = ~F.col("_metadata.file_path").rlike(r"_scored\.jsonl")
    return graded.join(plain.filter(is_raw).select("cond", "id", "raw_output"), ["cond", "id"], "left")
