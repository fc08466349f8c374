"""Duplicates by key, by content and by any of several keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftbook.operators.ranking import first_per_key
from siftbook.session import shared_folder


def mark_content_copies(df: DataFrame, key: str, digest: str) -> DataFrame:
    """'accepted' for the first row of each digest, 'DUPLICATE' for later copies; a row without a digest is no copy."""
    firsts = df.filter(F.col(digest).isNotNull()).groupBy(digest).agg(F.min(key).alias("first_key"))
    status = F.when(F.col("first_key").isNull() | (F.col(key) == F.col("first_key")), "accepted").otherwise("DUPLICATE")
    return df.join(firsts, digest, "left").withColumn("status", status)


def drop_copies(df: DataFrame, key: str, value: Column) -> DataFrame:
    """Keep the row with the lowest key of each value; rows without a value (null or '') all stay."""
    valued = df.withColumn("_v", F.when(value != "", value))
    return first_per_key(valued.withColumn("_own", F.when(F.col("_v").isNull(), F.col(key))), ["_v", "_own"], [key]).drop("_v", "_own")


def not_known(candidates: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Candidates whose key is not known; candidates without a key (null or '') stay."""
    return candidates.join(known.select(key).filter(F.col(key) != "").distinct(), key, "left_anti")


def names_of(names: list[str]) -> Column:
    """A row's names, each marked with the column it comes from; null and '' are none."""
    return F.array_compact(F.array(*[F.when(F.col(n) != "", F.concat(F.lit(f"{n}:"), F.col(n))) for n in names]))


def first_seen_by_any_key(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Walk the rows by ``key``; a row is a copy when an earlier kept row shares any of its names.

    Copies are not kept, so their other names hide nobody. A row waits for the earlier open rows under its
    names. In a round, rows that wait for none are kept, and rows sharing a name with them are copies. A
    row that waits for one row only is kept if that one is not; such rows form chains, and a chain of any
    length is followed to its end by doubling the steps. Decided rows leave, so other rows wait for fewer.
    A round is a few aggregations over (name, row) pairs and joins with one row for each name; neither
    pairs of rows nor connected components are ever formed or walked. Rows without any name are left out.
    """
    shared_folder(df.sparkSession)
    open_ = df.select(F.col(key).alias("k"), F.explode(names_of(names)).alias("name")).distinct().checkpoint()
    every = open_.select("k", F.lit(False).alias("is_copy")).limit(0)
    while not open_.isEmpty():
        kept = _kept(open_)
        taken = open_.join(kept, "k", "left_semi").select("name", F.col("k").alias("owner"))
        copies = open_.join(taken, "name").filter(F.col("k") != F.col("owner")).select("k").distinct()
        settled = kept.withColumn("is_copy", F.lit(False)).unionByName(copies.withColumn("is_copy", F.lit(True)))
        every = every.unionByName(settled).checkpoint()
        open_ = open_.join(every.select("k"), "k", "left_anti").checkpoint()
    return df.join(every, df[key] == every["k"]).drop("k")


def _kept(open_: DataFrame) -> DataFrame:
    """(k) of the open rows that are kept for sure: those that wait for none, and those at an even place behind them."""
    low = open_.groupBy("name").agg(F.min("k").alias("low"))
    marked = open_.join(low, "name")
    second = marked.filter("k > low").groupBy("name").agg(F.min("k").alias("second"))
    waits = marked.join(second, "name", "left").groupBy("k").agg(
        F.min(F.when(F.col("k") > F.col("low"), F.col("low"))).alias("first"), F.max(F.when(F.col("k") > F.col("low"), F.col("low"))).alias("last"),
        F.bool_or(F.col("k") > F.col("second")).alias("more"),
    ).checkpoint()
    free = waits.filter(F.col("first").isNull()).select("k")
    links = waits.filter((F.col("first") == F.col("last")) & ~F.coalesce("more", F.lit(False))).select("k", F.col("first").alias("to"), F.lit(True).alias("odd"))
    # a link to a row that has no link itself is at its end
    while True:
        ahead = links.select(F.col("k").alias("to"), F.col("to").alias("further"), F.col("odd").alias("flips"))
        longer = links.join(ahead, "to", "left").select("k", F.coalesce("further", "to").alias("to"), (F.col("odd") != F.coalesce("flips", F.lit(False))).alias("odd"), F.col("further").isNotNull().alias("_moved"))
        longer = longer.checkpoint()
        links = longer.drop("_moved")
        if longer.filter("_moved").isEmpty():
            break
    ends = free.select(F.col("k").alias("to"))
    return free.unionByName(links.filter(~F.col("odd")).join(ends, "to", "left_semi").select("k")).checkpoint()
