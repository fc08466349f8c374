"""Query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftbook.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# narrow numbers are widened so that both engines report the same types
_WIDE = {T.ByteType: "long", T.ShortType: "long", T.IntegerType: "long", T.FloatType: "double"}


def widened(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{f.name}`").cast(_WIDE.get(type(f.dataType), f.dataType)).alias(f.name) for f in df.schema.fields])


TEXTS = ("documents", "pages", "conversations")  # much work per row


class Tables:
    """The given tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(df) if name in TEXTS else df


def query(name: str, sql: str | None = None):
    """Register a query taking :class:`Tables`."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = lambda spark, folder: widened(fn(Tables(spark, folder)))
        if sql is not None:
            SQL[name] = sql
        return fn

    return register
