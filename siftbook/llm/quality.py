"""Quality rules on documents and on the hosts they come from, in built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftbook.session import stage

#: White space between words, what is no symbol, words of a repeated run, least words, most repeated words in percent.
SPACE, NO_SYMBOL, RUN, LEAST_WORDS, MOST_REPEATED = r"[\x20\x09-\x0D]+", r"[^#*$%&|<>]+", 3, 50, 50

#: Rules beside the base ones: a document fails when part > limit * whole.
RULES = {"symbols": ("n_symbols", "n_words", 0.1), "repeated_lines": ("n_dup_lines", "n_lines", 0.5), "capitals": ("n_capitals", "word_chars", 0.5)}
#: A host is trusted while its shrunk rate of documents that fail a rule is at most this.
HOST_LIMIT = 0.1


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of each whole text; null and empty texts have zeros.

    Runs of three words are compared by 64-bit hash inside the row: after a sort equal hashes are
    neighbours, and each run with an equal neighbour marks its three words. Nothing is exploded and
    no row leaves its task; a task holds the words of one document at a time.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns({
        "_words": F.array_remove(F.split(whole, SPACE), ""),
        "_lines": F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    })
    hashes = f"transform(sequence(0, size(_words) - {RUN}), i -> struct(xxhash64(_words[i], _words[i + 1], _words[i + 2]) AS h, i AS i))"
    out = out.withColumn("_runs", F.expr(f"CASE WHEN size(_words) > {RUN} THEN array_sort({hashes}) END"))
    twice = F.expr("transform(filter(_runs, (x, k) -> (k > 0 AND _runs[k - 1].h = x.h) OR (k < size(_runs) - 1 AND _runs[k + 1].h = x.h)), x -> x.i)")
    marked = f"aggregate(array_sort(_twice), struct(-{RUN} AS last, 0L AS n), (a, i) -> struct(i AS last, a.n + least({RUN}, i - a.last) AS n), a -> a.n)"
    return out.withColumn("_twice", twice).withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(whole, NO_SYMBOL, "")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(F.expr(marked), F.lit(0)).cast("long"),
        "n_capitals": F.length(F.regexp_replace(whole, "[^A-Z]+", "")).cast("long"),
    }).drop("_words", "_lines", "_runs", "_twice")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def n_failed() -> Column:
    """How many of ``RULES`` a measured document fails."""
    return sum((F.col(part) > limit * F.col(whole)).cast("int") for part, whole, limit in RULES.values())


def host_rates(measured_: DataFrame, host: str) -> DataFrame:
    """Rate of failing documents of each host, shrunk towards all hosts.

    A document fails by the base rules or any other. The prior is a beta distribution with the mean
    and the variance of the hosts' rates; a host with few documents stays close to the mean. Null
    hosts have no rate. Counts combine before the shuffle, so a hot host is no burden.
    """
    failed = (base_failed() | (n_failed() > 0)).cast("long")
    hosts = measured_.filter(F.col(f"`{host}`").isNotNull()).groupBy(F.col(f"`{host}`").alias("host")).agg(F.count("*").alias("n"), F.sum(failed).alias("failed"))
    hosts = stage(hosts, "hosts")
    prior = hosts.agg(F.avg(F.expr("failed / n")).alias("mean"), F.var_pop(F.expr("failed / n")).alias("spread")).first()
    mean, spread = prior["mean"] or 0.0, prior["spread"] or 0.0
    strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6) if spread > 0 else 1e6
    return hosts.withColumn("rate", (F.col("failed") + mean * strength) / (F.col("n") + strength))


def judged(docs: DataFrame, host: str = "source", keep: list[str] | None = None) -> DataFrame:
    """Add the counts of :func:`measured`, ``base_failed``, the ``host_rate`` and ``kept``.

    Kept are documents that pass the base rules and, if their host is not trusted, all others; a
    trusted or unknown host is forgiven one failed rule. A document that fails nothing is never lost
    for its host. Repeated rows count as often as they occur; an empty table gives no rows. ``keep``
    names the columns that stay beside the counts; a count replaces a column of its name.

    The measured rows are written once. The hosts come back from a table whose size Spark knows: it
    sends them to all tasks while they are few and shuffles by host beyond.
    """
    keep = docs.columns if keep is None else keep
    needed = list(dict.fromkeys([*keep, host, "text"]))
    rows = measured(docs.select(*[F.col(f"`{c}`") for c in needed]).withColumn("_host", F.col(f"`{host}`")))
    kept = [c for c in keep if c in rows.columns]
    counts = [c for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals") if c not in kept]
    rows = stage(rows.select("_host", *[F.col(f"`{c}`") for c in [*kept, *counts]]), "measured")
    rates = stage(host_rates(rows, "_host").select(F.col("host").alias("_host"), F.col("rate").alias("host_rate")), "rates")
    strict = F.coalesce(F.col("host_rate") > HOST_LIMIT, F.lit(False))
    out = rows.drop("base_failed", "kept", "host_rate").join(rates, "_host", "left").withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (n_failed() <= F.when(strict, 0).otherwise(1))).drop("_host")
