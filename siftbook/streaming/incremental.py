"""Incremental work over landed files.

Each job reads new files once, keeps its progress in a checkpoint and writes every micro-batch
under its own number, so that a batch that runs twice replaces itself.
"""

from __future__ import annotations

import os
import threading
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftbook.operators.dedup import first_seen_by_any_key, names_of
from siftbook.operators.records import upsert_view


def landed(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*", files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )


def _drain(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .foreachBatch(write).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def process_new(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append what has arrived since the last run; files seen before are not read again."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .option("path", out).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def append_log(stream: DataFrame, log: str, checkpoint: str) -> None:
    """Append every batch to an upsert log."""
    _drain(stream, checkpoint, lambda df, n: df.write.mode("overwrite").parquet(os.path.join(log, f"batch={n}")))


def read_log(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.option("basePath", log).parquet(log)


def upserted(spark: SparkSession, log: str, key: str, order: str, keep: list[str], replace: list[str]) -> DataFrame:
    """Current state of an upsert log."""
    return upsert_view(read_log(spark, log), key, order, keep, replace)


def _earlier(spark: SparkSession, log: str, batch: int) -> DataFrame | None:
    if not _batches(spark, log):
        return None
    return spark.read.option("basePath", log).parquet(log).filter(F.col("batch") < batch)


def keep_unseen(stream: DataFrame, log: str, checkpoint: str, order: str, keys: list[str]) -> None:
    """Keep rows that share none of ``keys`` with a row kept before, in this batch or an earlier one.

    Empty keys are shared with nobody, so the rows that stay do not depend on the batches.
    """

    def write(df: DataFrame, n: int) -> None:
        kept = _earlier(df.sparkSession, log, n)
        if kept is not None:
            taken = kept.select(F.explode(names_of(keys)).alias("name")).distinct()
            seen = df.select(order, F.explode(names_of(keys)).alias("name")).join(taken, "name", "left_semi").select(order).distinct()
            df = df.join(seen, order, "left_anti")
        fresh = first_seen_by_any_key(df, order, keys).filter(~F.col("is_copy")).drop("is_copy")
        fresh.write.mode("overwrite").parquet(os.path.join(log, f"batch={n}"))

    _drain(stream, checkpoint, write)


def running_counts(stream: DataFrame, status: str, out: str, checkpoint: str) -> None:
    """Count per status over everything so far.

    A batch counts its own rows, adds the totals of the batch before and writes a folder of its own, so it
    costs what it holds and no reader's folder changes. :func:`latest_counts` reads the newest totals.
    """
    _drain(stream, checkpoint, lambda df, n: _add_counts(df, n, status, out))


def _add_counts(df: DataFrame, n: int, status: str, out: str) -> None:
    counts = df.groupBy(status).agg(F.count("*").alias("n"))
    before = latest_counts(df.sparkSession, out, below=n)
    if before is not None:
        counts = counts.unionByName(before).groupBy(status).agg(F.sum("n").alias("n"))
    counts.coalesce(1).write.mode("overwrite").parquet(os.path.join(out, f"batch={n}"))


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that are wholly written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = spark._jvm.org.apache.hadoop.fs.Path
    if not files.exists(path):
        return []
    names = [f.getPath().getName() for f in files.listStatus(path)]
    return sorted(int(x.removeprefix("batch=")) for x in names if x.startswith("batch=") and files.exists(done(f"{folder}/{x}/_SUCCESS")))


def latest_counts(spark: SparkSession, out: str, below: int | None = None) -> DataFrame | None:
    """Totals after the newest batch (before number ``below``), none if there is no batch."""
    known = [n for n in _batches(spark, out) if below is None or n < below]
    return spark.read.parquet(os.path.join(out, f"batch={known[-1]}")) if known else None


def collect_until(stream: DataFrame, status: str, wanted: str, target: int, log: str, counts: str, checkpoint: str) -> bool:
    """Append what arrives to a log until ``target`` rows have the wanted status; tells whether they have.

    The query ends itself behind the batch that reaches the target, so later files stay unread. A run that
    starts again goes on with the totals of the last one and reads nothing if they are enough.
    """
    spark = stream.sparkSession

    def reached() -> bool:
        totals = latest_counts(spark, counts)
        row = totals.filter(F.col(status) == wanted).agg(F.sum("n").alias("n")).first() if totals is not None else None
        return row is not None and (row["n"] or 0) >= target

    enough = threading.Event()
    if reached():
        return True

    def write(df: DataFrame, n: int) -> None:
        if enough.is_set():
            raise StopCollecting
        df = df.persist()
        df.write.mode("overwrite").parquet(os.path.join(log, f"batch={n}"))
        _add_counts(df, n, status, counts)
        df.unpersist()
        if reached():
            enough.set()

    query = (
        stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .foreachBatch(write).trigger(availableNow=True).start()
    )
    try:
        while not query.awaitTermination(0.2) and not enough.is_set():
            pass
        query.stop()
    except StreamingQueryException:
        if not enough.is_set():
            raise
    return enough.is_set()


class StopCollecting(Exception):
    """Raised instead of taking a batch that comes after the target."""


def first_accepted(rows: DataFrame, status: str, wanted: str, order: str, target: int) -> DataFrame:
    """The first ``target`` rows with the wanted status, all of them while there are fewer."""
    return rows.filter(F.col(status) == wanted).orderBy(order).limit(target)


def target_reached(counts: DataFrame, status: str, wanted: str, target: int) -> DataFrame:
    """Whether enough rows have the wanted status."""
    n = F.coalesce(F.sum(F.when(F.col(status) == wanted, F.col("n"))), F.lit(0))
    return counts.agg(n.alias("n"), (n >= target).alias("reached"))
