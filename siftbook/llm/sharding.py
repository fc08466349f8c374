"""Shards of near equal size that keep linked documents together: balanced label propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftbook.session import stage


def ranked(df: DataFrame, groups: list[str], order: list[Column], name: str, buckets: int) -> DataFrame:
    """0-based rank inside ``groups``, by a bucket of ``_order`` and then by ``order``.

    A task ranks one bucket; the sizes of the buckets before it, one row for each, are added.
    """
    split = df.withColumn("_bucket", F.pmod(F.col("_order"), F.lit(buckets)))
    sizes = split.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*groups).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*groups, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(W.partitionBy(*groups, "_bucket").orderBy("_order", *order))
    placed = split.withColumn("_local", local).join(offsets, [*groups, "_bucket"])
    return placed.select(*df.columns, (F.col("_before") + F.col("_local") - 1).cast("long").alias(name))


def bucket_count(rows: int, task_rows: int = 20_000) -> int:
    """Buckets for :func:`ranked`: so many that one holds about ``task_rows`` rows, 64 at least."""
    return max(64, -(-rows // task_rows))


def shards(docs: DataFrame, n_shards: int = 8, rounds: int = 6) -> DataFrame:
    """size, text_crc32, law, shard, slot and grown_shard of each row of ``docs`` (``doc_id``, ``text``).

    Rows with equal texts are linked. They start in the shard their id hashes to. In each round a row
    looks at the shards of its neighbours, which are counts for each text and shard, and wants the
    one that most of them are in, of those with room (the lower shard if two have as many); of those
    who want a shard, as many move as its quota of ``rows / n_shards`` leaves free. A text that is
    still split, though a shard could hold it, is then moved as a whole, and a text with more rows
    than a shard holds fills one shard after the other. Rows without links fill all shards, so that
    counts differ by one at most (law 'rows').

    Null texts have size 1, the checksum of nothing and no links. Repeated rows are rows of their
    own, ids that repeat or are null too. Every rank ends in a random number drawn once and stored.
    An empty table gives no rows.
    """
    known = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.unhex(F.md5("text")).alias("_text"),
    )
    # a number for each row, as equal rows must be told apart
    known = stage(known.withColumn("_row", F.monotonically_increasing_id()), "rows").withColumn("_order", F.xxhash64("doc_id", "_row"))
    copies = known.filter("_text IS NOT NULL").groupBy("_text").agg(F.count("*").alias("_copies")).filter("_copies > 1")
    rows = stage(known.join(copies, "_text", "left"), "linked")
    linked = rows.filter("_copies > 1").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(n_shards)).cast("int"))
    total = rows.count()
    quota, buckets = total // n_shards, bucket_count(total)

    for _ in range(rounds):
        loads = _loads(linked)
        free = {s: max(quota - loads.get(s, 0), 0) for s in range(n_shards)}
        counts = linked.groupBy("_text", "shard").agg(F.count("*").alias("_n")).withColumn("_near", F.struct("_n", -F.col("shard")))
        best = counts.filter(F.col("shard").isin([s for s, n in free.items() if n])).groupBy("_text").agg(F.max_by(F.struct("shard", "_near"), "_near").alias("_best"))
        wishes = linked.join(counts.select("_text", "shard", "_near"), ["_text", "shard"]).join(best, "_text")
        movers = wishes.filter(F.col("_best._near") > F.col("_near")).select("_row", "_order", F.col("_best.shard").alias("_to"))
        limit = F.element_at(F.create_map(*[F.lit(x) for pair in free.items() for x in pair]), F.col("_to"))
        moved = ranked(movers, ["_to"], [F.col("_row")], "_rank", buckets).filter(F.col("_rank") < limit).select("_row", F.col("_to").alias("_moved"))
        moved = stage(moved, "moves")
        if moved.isEmpty():
            break
        linked = stage(linked.join(moved, "_row", "left").withColumn("shard", F.coalesce("_moved", "shard")).drop("_moved"), "linked")
    final = {s: total // n_shards + (s < total % n_shards) for s in range(n_shards)}
    return _filled(rows, _gathered(linked, final, buckets), final, buckets)


def _running(texts: DataFrame, groups: list[str], buckets: int) -> DataFrame:
    """``_end``: rows of the texts of the group up to this one, texts with many copies first.

    Texts come in classes of a power of two copies, and a class in buckets; a task adds up one bucket.
    """
    sliced = texts.withColumn("_class", -F.floor(F.log2("_copies"))).withColumn("_bucket", F.pmod(F.xxhash64("_text"), F.lit(buckets)))
    sizes = sliced.groupBy(*groups, "_class", "_bucket").agg(F.sum("_copies").alias("_n"))
    before = W.partitionBy(*groups).orderBy("_class", "_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*groups, "_class", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    upto = W.partitionBy(*groups, "_class", "_bucket").orderBy("_text").rowsBetween(W.unboundedPreceding, 0)
    return sliced.withColumn("_local", F.sum("_copies").over(upto)).join(offsets, [*groups, "_class", "_bucket"]).select(*texts.columns, (F.col("_before") + F.col("_local")).alias("_end"))


def _gathered(linked: DataFrame, final: dict[int, int], buckets: int) -> DataFrame:
    """``linked`` with every text in one shard that fits into one; null where there is no room for it.

    Texts with more rows than a shard holds, fewer than there are shards, come first and fill the shards that most of
    them are in. A text that is in several shards, or in one that holds too much, gives up its places. The rooms that
    are then left are laid end to end, and these texts beside them; a text goes where it lies in one room.
    Fewer texts than shards lie across two rooms; the driver puts each into the smallest room it fits.
    """
    parts = stage(linked.groupBy("_text", "shard").agg(F.count("*").alias("_n")), "parts")
    texts = parts.groupBy("_text").agg(F.sum("_n").alias("_copies"), F.count("*").alias("_parts"), F.first("shard").alias("shard"))
    fits = F.col("_copies") <= min(final.values())
    left, home_of = dict(final), F.lit(None).cast("int")
    by_text = F.sort_array(F.collect_list(F.struct("_n", "shard")), asc=False).alias("_places")
    for row in parts.join(texts.filter(~fits).select("_text", "_copies"), "_text").groupBy("_text", "_copies").agg(by_text).orderBy(F.desc("_copies"), "_text").collect():
        first = [place["shard"] for place in row["_places"]]
        at = 0
        for s in first + [s for s in final if s not in first]:
            took = min(left[s], row["_copies"] - at)
            here = (F.col("_text") == F.lit(bytes(row["_text"]))) & F.col("_rank").between(at, at + took - 1)
            home_of = F.when(here, F.lit(s)).otherwise(home_of)
            at += took
            left[s] -= took
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in left.items() for x in pair]), F.col("shard"))
    whole = stage(_running(texts.filter(fits & (F.col("_parts") == 1)).select("_text", "_copies", "shard"), ["shard"], buckets).withColumn("_stays", F.col("_end") <= limit), "whole")
    for row in whole.filter("_stays").groupBy("shard").agg(F.sum("_copies").alias("_n")).collect():
        left[row["shard"]] -= row["_n"]
    loose = texts.filter(fits & (F.col("_parts") > 1)).select("_text", "_copies").unionByName(whole.filter("NOT _stays").select("_text", "_copies"))
    lined = _running(loose.withColumn("_all", F.lit(0)), ["_all"], buckets)
    inside, across, at = [], F.lit(False), 0
    for s, room in sorted(left.items(), key=lambda pair: -pair[1]):
        inside.append(F.when((F.col("_end") - F.col("_copies") >= at) & (F.col("_end") <= at + room), F.lit(s)))
        at += room
        across |= (F.col("_end") - F.col("_copies") < at) & (F.col("_end") > at)
    lined = stage(lined.select("_text", "_copies", F.coalesce(*inside).alias("_to"), across.alias("_across")), "lined")
    for row in lined.filter("_to IS NOT NULL").groupBy("_to").agg(F.sum("_copies").alias("_n")).collect():
        left[row["_to"]] -= row["_n"]
    # one text at most for each end of a room
    late = F.lit(None).cast("int")
    for row in sorted(lined.filter("_to IS NULL AND _across").collect(), key=lambda row: (-row["_copies"], row["_text"])):
        home = min((s for s, room in left.items() if room >= row["_copies"]), key=lambda s: (left[s], s), default=None)
        if home is not None:
            left[home] -= row["_copies"]
            late = F.when(F.col("_text") == F.lit(bytes(row["_text"])), F.lit(home)).otherwise(late)
    moved = lined.select("_text", F.coalesce("_to", late).alias("_to"), F.lit(True).alias("_moved"))
    placed = linked.filter(fits).join(moved, "_text", "left").withColumn("shard", F.when(F.col("_moved"), F.col("_to")).otherwise(F.col("shard")))
    vast = ranked(linked.filter(~fits), ["_text"], [F.col("_row")], "_rank", buckets).withColumn("shard", home_of)
    return stage(placed.select(*linked.columns).unionByName(vast.select(*linked.columns)), "gathered")


def _loads(placed: DataFrame) -> dict[int, int]:
    """Rows of each shard."""
    return {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}


def _filled(rows: DataFrame, linked: DataFrame, final: dict[int, int], buckets: int) -> DataFrame:
    """Move what is over a shard's final count out, and fill all shards with rows without links."""
    room = F.element_at(F.create_map(*[F.lit(x) for pair in final.items() for x in pair]), F.col("shard"))
    stay = stage(ranked(linked, ["shard"], [F.col("_row")], "_rank", buckets).withColumn("shard", F.when(F.col("_rank") < room, F.col("shard"))), "stay")
    placed = stay.filter("shard IS NOT NULL")
    loads = _loads(placed)
    over = stay.filter("shard IS NULL").select("_row")
    loose = rows.filter("_copies IS NULL").unionByName(rows.join(over, "_row", "left_semi"))
    numbered = ranked(loose.withColumn("_all", F.lit(0)), ["_all"], [F.col("_row")], "_rank", buckets)
    ends, at = [], 0
    for s in final:
        at += final[s] - loads.get(s, 0)
        ends.append(at)
    target = F.coalesce(*[F.when(F.col("_rank") < end, F.lit(s)) for s, end in enumerate(ends)])
    names = ["doc_id", "size", "text_crc32", "shard", "_row", "_order"]
    everything = stage(placed.select(*names).unionByName(numbered.withColumn("shard", target).select(*names)), "placed")
    slots = ranked(everything, ["shard"], [F.col("_row")], "slot", buckets)
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
