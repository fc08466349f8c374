"""Ranks, splits and samples that spread over the cluster.

A ``row_number`` without partition columns sorts the whole input in one task, and one over a few
large groups sorts each in one task. The two rank helpers avoid that:

* :func:`hash_rank` orders by an md5 of the key. The first hex digits are uniform buckets, so each
  task ranks one bucket and adds the size of the buckets before it.
* :func:`ordered_rank` orders by given columns. The sorted rows are checkpointed, which fixes their
  partitions; the row's place inside its partition plus the sizes of the partitions before it is
  the rank. Hot values are split because the sort key ends in a unique column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftbook.session import shared_folder, stage

Keys = tuple[str, ...] | list[str]


def hash_order(seed: int | str, *cols: str | Column) -> Column:
    """Seeded pseudo-random order of a key, the same on every run and engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c if isinstance(c, Column) else F.col(c) for c in cols]))


def _same(a: DataFrame, b: DataFrame, cols: Keys) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & a[c].eqNullSafe(b[c])
    return cond


def hash_rank(df: DataFrame, key: Keys, seed: int | str, within: Keys = (), name: str = "rank", digits: int = 3) -> DataFrame:
    """1-based rank in seeded hash order of ``key``, over all rows or inside each ``within`` group."""
    hashed = df.withColumn("_h", hash_order(seed, *key)).withColumn("_bucket", F.substring("_h", 1, digits))
    sizes = hashed.groupBy(*within, "_bucket").agg(F.count("*").alias("_n"))
    # at most 16**digits rows per group
    before = W.partitionBy(*within).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*within, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(W.partitionBy(*within, "_bucket").orderBy("_h", *key))
    ranked = hashed.withColumn("_local", local)
    offsets = offsets.withColumnsRenamed({c: f"_o_{c}" for c in (*within, "_bucket")})
    cond = ranked["_bucket"] == offsets["_o__bucket"]
    for c in within:
        cond = cond & ranked[c].eqNullSafe(offsets[f"_o_{c}"])
    return (
        ranked.join(offsets, cond)
        .withColumn(name, (F.col("_before") + F.col("_local")).cast("long"))
        .select(*df.columns, name)
    )


def ordered_rank(df: DataFrame, order: list[Column], within: Keys = (), name: str = "rank") -> DataFrame:
    """1-based rank in the given order, over all rows or inside each ``within`` group.

    ``order`` must end in a column that is unique inside the group.
    """
    shared_folder(df.sparkSession)
    placed = df.sort(*[F.col(c) for c in within], *order).checkpoint().withColumn("_at", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftrightunsigned("_at", 33))
    # one row per partition and group that touches it
    runs = placed.groupBy("_part", *within).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = W.partitionBy(*within).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    runs = runs.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_o_{c}") for c in within], "_first", "_before")
    cond = placed["_part"] == runs["_p"]
    for c in within:
        cond = cond & placed[c].eqNullSafe(runs[f"_o_{c}"])
    rank = F.col("_before") + F.col("_at") - F.col("_first") + 1
    return placed.join(runs, cond).select(*[placed[c] for c in df.columns], rank.cast("long").alias(name))


def top_per_group(df: DataFrame, group: Keys, order: list[Column], k: int | Column, bound: int, salts: int = 1024) -> DataFrame:
    """First ``k`` rows of each group; ``bound`` is the largest ``k`` can be.

    Two steps: the best ``bound`` rows of each salted part, then of the group. No task sees more
    than ``salts * bound`` rows of one group at the end, and a bound up to 1000 is already applied
    before the first shuffle.
    """
    hashable = [c for c, kind in df.dtypes if "map<" not in kind]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*hashable), F.lit(salts)))
    part = salted.withColumn("_r", F.row_number().over(W.partitionBy(*group, "_salt").orderBy(*order)))
    part = part.filter(F.col("_r") <= bound)
    best = part.withColumn("_r", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    return best.filter(F.col("_r") <= k).withColumn("pick", F.col("_r").cast("long")).select(*df.columns, "pick")


def latest_per_key(df: DataFrame, key: Keys, order: list[str]) -> DataFrame:
    """Last write of each key. Aggregated, so a hot key is combined before the shuffle."""
    return _pick(df, key, F.max_by, order)


def first_per_key(df: DataFrame, key: Keys, order: list[str]) -> DataFrame:
    """First write of each key."""
    return _pick(df, key, F.min_by, order)


def _pick(df: DataFrame, key: Keys, chooser, order: list[str]) -> DataFrame:
    row = chooser(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*[F.col(c).alias(f"_k_{c}") for c in key]).agg(row.alias("_row")).select("_row.*")


def row_total(df: DataFrame) -> Column:
    """Number of rows as a scalar subquery."""
    return df.agg(F.count("*").alias("n")).scalar()


# -- splits ----------------------------------------------------------------------------------

def hash_cut(df: DataFrame, key: Keys, wanted: Callable[[int], int], seed: int | str, digits: int = 4) -> Column:
    """Condition that holds for the first ``wanted(number of rows)`` rows in seeded hash order of ``key``.

    Rows are counted by the first digits of their hash, and only the bucket that the cut falls into
    is sorted for the last key inside. All rows are then decided by comparison, without a shuffle.
    """
    order = hash_order(seed, *key)
    bucket = F.substring(order, 1, digits)
    sizes = sorted(map(tuple, df.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()))
    left = min(wanted(sum(n for _, n in sizes)), sum(n for _, n in sizes))
    if left <= 0:
        return F.lit(False)
    for name, n in sizes:
        if left <= n:
            break
        left -= n
    last = df.filter(bucket == name).select(order.alias("_h"), *key).orderBy("_h", *key).offset(left - 1).limit(1).first()
    kinds = dict(df.dtypes)
    return F.struct(order, *key) <= F.struct(F.lit(last["_h"]), *[F.lit(last[c]).cast(kinds[c]) for c in key])


def holdout_documents(df: DataFrame, document: str, n: int, seed: int = 42) -> DataFrame:
    """Mark every row 'eval' or 'train' by document; ``n`` documents are held out."""
    names = df.select(document).filter(F.col(document).isNotNull()).distinct()
    held = hash_cut(names, [document], lambda total: n, seed) & F.col(document).isNotNull()
    return df.withColumn("split", F.when(held, "eval").otherwise("train"))


def train_validation(df: DataFrame, key: Keys, fraction: float, seed: int = 42) -> DataFrame:
    """Mark rows 'val' for the first ``max(1, int(n * fraction))`` in hash order, else 'train'."""
    held = hash_cut(df.select(*key), key, lambda total: max(1, int(total * fraction)), seed)
    return df.withColumn("split", F.when(held, "val").otherwise("train"))


def shard(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Round-robin shard number by position."""
    return ordered_rank(df, order).withColumn("shard", F.pmod(F.col("rank") - 1, F.lit(n))).drop("rank")


def assign_categories(df: DataFrame, key: Keys, categories: list[str], seed: int = 42) -> DataFrame:
    """Give every row a category so that counts differ by at most one."""
    names = F.array(*[F.lit(c) for c in sorted(categories)])
    ranked = hash_rank(df, key, seed)
    pick = F.element_at(names, (F.pmod(F.col("rank") - 1, F.lit(len(categories))) + 1).cast("int"))
    return ranked.withColumn("category", pick).drop("rank")


# -- samples ---------------------------------------------------------------------------------

def fill_quota(df: DataFrame, level: str, order: list[Column], total: int, levels: list[str], existing: dict[str, int] | None = None) -> DataFrame:
    """At most ``total // len(levels)`` rows per level, in order, less what a level already has."""
    quota = total // len(levels)
    have = F.lit(0)
    for name, count in (existing or {}).items():
        have = F.when(F.col(level) == name, F.lit(count)).otherwise(have)
    known = df.filter(F.col(level).isin(*levels))
    return top_per_group(known, [level], order, F.lit(quota) - have, bound=quota)


def fill_categories(df: DataFrame, key: Keys, categories: list[str], n: int, seed: int = 42) -> DataFrame:
    """Walk the rows in hash order and fill one category after the other with ``n`` rows each."""
    ranked = hash_rank(df, key, seed).filter(F.col("rank") <= n * len(categories))
    names = F.array(*[F.lit(c) for c in categories])
    return ranked.withColumn("category", F.element_at(names, (F.floor((F.col("rank") - 1) / n) + 1).cast("int")))


def stratified_sample(df: DataFrame, category: str, key: Keys, n: int, seed: int = 1) -> DataFrame:
    """ceil(n / k) rows of each of the k categories, then the first ``n`` in hash order."""
    per = -(-n // max(df.agg(F.count_distinct(category).alias("k")).first()["k"], 1))
    picked = top_per_group(df, [category], [hash_order(seed, *key), *map(F.col, key)], F.lit(per), bound=per).drop("pick")
    return picked.orderBy(hash_order(f"{seed}-all", *key), *key).limit(n)


def sample_per_category(df: DataFrame, category: str, key: Keys, n: int, seed: int = 7) -> DataFrame:
    """``n`` rows of each category with the category's total."""
    totals = df.groupBy(category).agg(F.count("*").alias("total"))
    picked = top_per_group(df, [category], [hash_order(seed, *key), *map(F.col, key)], F.lit(n), bound=n)
    return picked.join(totals, category)


def select_nth(df: DataFrame, value: Column, n: int, buckets: int = 4096, small: int = 10_000) -> tuple:
    """The ``n``-th smallest of numbers without null and NaN, and its place among those equal to it.

    In each round the numbers between two bounds are counted in equal steps, with the least and the greatest
    of each step; the step that holds the ``n``-th gives the next bounds. Only counts are shuffled, at most
    ``buckets`` rows reach the driver, and numbers are sorted once no more than ``small`` are left.
    """
    rows = df.select(value.alias("_x"))
    low, high, count = rows.agg(F.min("_x"), F.max("_x"), F.count("_x")).first()
    while low != high and count > small:
        inside = rows.filter(F.col("_x").between(low, high)).groupBy(_step(F.col("_x"), low, high, buckets).alias("step"))
        for _, least, most, held in sorted(map(tuple, inside.agg(F.min("_x"), F.max("_x"), F.count("*")).collect())):
            if n <= held:
                low, high, count = least, most, held
                break
            n -= held
    if low == high:
        return low, n
    left = rows.filter(F.col("_x").between(low, high))
    found = left.orderBy("_x").offset(n - 1).limit(1).first()[0]
    return found, n - left.filter(F.col("_x") < F.lit(found)).count()


def _step(x: Column, low: float, high: float, buckets: int) -> Column:
    """A number that never falls as x grows from ``low`` to ``high``, with few values and two at least."""
    if isinstance(low, int):
        above = x.cast("decimal(20,0)") - F.lit(low)
        return above - above % F.lit((high - low) // (buckets - 1) + 1)
    if width := high / 2 - low / 2:  # halves, as the difference of two doubles may be too large for one
        return F.floor((x.cast("double") / 2 - F.lit(low / 2)) / F.lit(width) * (buckets - 1))
    return F.when(x > F.lit(low), 1).otherwise(0)


def first_rows(df: DataFrame, value: Column, key: str, n: int) -> Column:
    """Condition that holds for the first ``n`` rows by (value, key), both numbers; no row is moved for it."""
    if n <= 0:
        return F.lit(False)
    last, place = select_nth(df, value, n)
    ties = df.filter(value == F.lit(last))
    last_key, _ = select_nth(ties, F.col(key), place)
    return (value < F.lit(last)) | ((value == F.lit(last)) & (F.col(key) <= F.lit(last_key)))


def top_fraction(df: DataFrame, score: str, key: str, fraction: float) -> DataFrame:
    """The ``int(n * fraction)`` highest scores, ties to the lower key. NaN and null never count or get chosen."""
    scored = df.filter(F.col(score).isNotNull() & ~F.isnan(score))
    narrow = stage(scored.select((-F.col(score)).alias("_s"), F.col(key).alias("_k")), "scores")
    return scored.withColumns({"_s": -F.col(score), "_k": F.col(key)}).filter(first_rows(narrow, F.col("_s"), "_k", int(narrow.count() * fraction))).drop("_s", "_k")


def usable_sample(df: DataFrame, usable: Column, key: Keys, n: int, seed: int = 42) -> DataFrame:
    """The first ``n`` usable rows in hash order; fewer only if fewer are usable."""
    return df.filter(usable).orderBy(hash_order(seed, *key), *map(F.col, key)).limit(n)


def sequence_ids(df: DataFrame, group: Keys, order: list[Column], prefix: Column, width: int, start: Column | None = None, name: str = "id") -> DataFrame:
    """Zero-based running ids per group, continuing after ``start`` existing rows."""
    ranked = ordered_rank(df, order, within=group, name="_rank")
    number = F.col("_rank") - 1 + (start if start is not None else F.lit(0))
    return ranked.withColumn(name, F.concat(prefix, F.format_string(f"%0{width}d", number))).drop("_rank")


def tiles(df: DataFrame, value: str, key: str, n: int, name: str = "tile") -> DataFrame:
    """``ntile`` over all rows by (value, key): sizes differ by at most one, larger tiles first.

    The last row of each tile is selected, then every row is compared with those; nothing is sorted.
    """
    total, place, before = df.count(), 0, F.lit(1)
    for tile in range(n - 1):
        place += total // n + (tile < total % n)
        before = before + F.when(first_rows(df, F.col(value), key, place), 0).otherwise(1)
    return df.withColumn(name, before.cast("long"))


def exact_median(df: DataFrame, value: str) -> float | None:
    """Median of a column, from the one or two middle values; null if there are none."""
    known = df.filter(F.col(value).isNotNull())
    n = known.count()
    middle = {(n + 1) // 2, n // 2 + 1} if n else ()
    found = [select_nth(known, F.col(value), i)[0] for i in middle]
    return sum(found) / len(found) if found else None


def few_shot(records: DataFrame, seeds: DataFrame, record_key: str, seed_key: str, category: str, n: int = 8, seed: int = 42) -> DataFrame:
    """Up to ``n`` seeds of the record's category.

    Seeds are numbered in hash order inside their category; a record takes ``n`` neighbours on that
    circle from a hashed start, so each record meets ``n`` seeds and not its whole category.
    """
    numbered = hash_rank(seeds, [seed_key], seed, within=[category], name="_at")
    # one entry per category
    sizes = seeds.groupBy(category).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct(category, "n"))).alias("m")).scalar()
    start = F.conv(F.substring(hash_order(f"{seed}-start", record_key), 1, 8), 16, 10).cast("long")
    wanted = (
        records.withColumn("_m", F.try_element_at(sizes, F.col(category)))
        .withColumn("_i", F.explode(F.sequence(F.lit(1), F.least(F.lit(n).cast("long"), F.col("_m")))))
        .withColumn("_at", F.pmod(start + F.col("_i") - 1, F.col("_m")) + 1)
    )
    return wanted.join(numbered, [category, "_at"]).withColumnRenamed("_i", "shot").drop("_at", "_m")
