"""Exact nearest neighbours, retrieved context, the distance gate and selection scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftbook.functions import fixed
from siftbook.operators import metric_index
from siftbook.session import scratch_path


def nearest(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, exclude_self: bool = False,
            cell_rows: int = metric_index.CELL_ROWS, block: int = 8192, share: int = 1024, seed: int = 42) -> DataFrame:
    """(query_id, neighbour_id, distance, place): the ``k`` nearest base rows of each query, by an index that is built for them.

    For a base that is searched more than once see :func:`siftbook.operators.metric_index.build`.
    """
    index = metric_index.build(base, key, vector, scratch_path(base.sparkSession, "index"), cell_rows=cell_rows, seed=seed)
    return metric_index.search(index, queries, key, vector, k, exclude_self, block, share)


def build_context(hits: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """Texts of the hits of each query in order of place, and the best distance."""
    named = hits.join(texts.select(F.col(key).alias("neighbour_id"), F.col(text).alias("_t")), "neighbour_id")
    parts = F.array_sort(F.collect_list(F.struct("place", "_t")))
    joined = F.array_join(F.transform(parts, lambda p: p["_t"]), fixed.CONTEXT_SEPARATOR)
    return named.groupBy("query_id").agg(joined.alias("context"), F.min("distance").alias("top_distance"))


def gate(contexts: DataFrame, threshold: float | Column = fixed.GATE_DISTANCE) -> DataFrame:
    """Use the context only where the best hit is close enough."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    used = F.coalesce(F.col("top_distance") <= limit, F.lit(False))
    return contexts.withColumn("used_context", used).withColumn("context", F.when(used, F.col("context")).otherwise(""))


def one_shot_context(samples: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Neighbour's turns in front of the sample's own: four messages per sample.

    ``samples`` has ``key``, user and assistant.
    """
    mine = samples.select(F.col(key).alias("query_id"), F.col("user").alias("_u"), F.col("assistant").alias("_a"))
    other = samples.select(F.col(key).alias("neighbour_id"), F.col("user").alias("_nu"), F.col("assistant").alias("_na"))
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    joined = hits.join(mine, "query_id").join(other, "neighbour_id")
    four = F.array(turn("user", "_nu"), turn("assistant", "_na"), turn("user", "_u"), turn("assistant", "_a"))
    return joined.select("query_id", "neighbour_id", four.alias("messages"))


def selection_score(with_neighbour: Column, without: Column) -> Column:
    """Loss of the answer with the neighbour in front minus the loss without it."""
    return with_neighbour - without
