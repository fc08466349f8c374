"""Article records: earliest public date, status, patches, quarantine, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftbook.functions import fixed
from siftbook.functions.dates import iso_date
from siftbook.operators.ranking import ordered_rank


def earliest_public(df: DataFrame, sources: list[tuple[str, Column]], cutoff: str = fixed.CUTOFF) -> DataFrame:
    """Earliest date over several sources and the decision that follows from it.

    ``sources`` are (label, date) in the order that settles ties; a label with 'preprint' in it
    names a preprint. Adds decision, reason, earliest_public_date, earliest_source and evidence.
    """
    # a plain array of structs keeps the smallest by date, then by position
    dated = F.array(*[F.struct(d.cast("date").alias("d"), F.lit(i).alias("i"), F.lit(s).alias("source")) for i, (s, d) in enumerate(sources)])
    known = F.filter(dated, lambda e: e["d"].isNotNull())
    first = F.array_min(known)
    before = first["d"] < F.lit(cutoff).cast("date")
    preprint = F.contains(first["source"], F.lit("preprint"))
    decision = F.when(first.isNull(), "AMBIGUOUS").when(before, "EXCLUDE").otherwise("INCLUDE")
    reason = (
        F.when(first.isNull(), "AMBIGUOUS_DATE").when(before & preprint, "PRE_CUTOFF_PREPRINT")
        .when(before, "PRE_CUTOFF_EPUBLICATION").otherwise("POST_CUTOFF_CONFIRMED")
    )
    lines = F.transform(known, lambda e: F.concat_ws("=", e["source"], e["d"].cast("string")))
    evidence = F.when(F.size(lines) == 0, F.array(F.lit("No date evidence from any source"))).otherwise(lines)
    return df.withColumns({
        "decision": decision, "reason": reason, "earliest_public_date": first["d"],
        "earliest_source": first["source"], "evidence": F.array_join(evidence, " | "),
    })


def article_dates(first_published: Column, year: Column) -> list[tuple[str, Column]]:
    """An index's own date, or January 1 of its year when it has no date."""
    exact = iso_date(first_published)
    only_year = F.when(F.coalesce(first_published, F.lit("")) == "", F.make_date(year, F.lit(1), F.lit(1)))
    return [("index.firstPublicationDate", exact), ("index.pubYear(day-imprecise)", only_year)]


def assign_status(df: DataFrame, has_text: Column, is_copy: Column) -> DataFrame:
    """Status and reason in fixed order: date decision, full text, duplicate, accepted."""
    reason = (
        F.when(F.col("decision") != "INCLUDE", F.col("reason")).when(~has_text, "NO_LEGAL_FULLTEXT")
        .when(is_copy, "DUPLICATE").otherwise("OK")
    )
    return df.withColumn("reason", reason).withColumn("status", F.when(F.col("reason") == "OK", "accepted_downloaded").otherwise("rejected"))


def discoverable(source: Column, pmcid: Column, retracted: Column, language: Column, open_access: Column, year: Column, first: int, last: int) -> Column:
    """Open, peer-reviewed, not retracted, English, with an identifier and in the year range."""
    return (
        (F.coalesce(pmcid, F.lit("")) != "") & (source != "PPR") & ~retracted & (language == "en") & open_access & year.between(first, last)
    )


def unique_names(df: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """Suffix _1, _2 ... for later files of the same name."""
    ranked = ordered_rank(df, order, within=[name], name="_rank")
    numbered = F.regexp_replace(F.col(name), r"(\.[^.]*)\z", F.concat(F.lit("_"), (F.col("_rank") - 1).cast("string"), F.lit("$1")))
    return ranked.withColumn("local_filename", F.when(F.col("_rank") == 1, F.col(name)).otherwise(numbered)).drop("_rank")


def upsert_view(log: DataFrame, key: str, order: str, keep: list[str], replace: list[str]) -> DataFrame:
    """State behind an upsert log: first values of ``keep``, last values of ``replace``."""
    ends = {"_f": (F.min_by, keep), "_l": (F.max_by, replace)}
    used = {name: pick(F.struct(*cols), F.col(order)).alias(name) for name, (pick, cols) in ends.items() if cols}
    return log.groupBy(key).agg(*used.values()).select(key, *[f"{name}.*" for name in used])


def patch(records: DataFrame, patches: DataFrame, key: str, replace: list[str], fragments: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Apply a patch table; a patched key or fragment that does not exist fails the job.

    ``replace`` columns of the patch (named ``new_<column>``) win where not null; ``fragments``
    maps a column to the patch's (old, new) columns for a replacement inside its text.
    """
    # a patch without a record stops the job that writes the result
    named = records.withColumn("_known", F.lit(True)).join(patches, key, "full")
    lost = F.concat(F.lit("patched key without a record: "), F.col(key).cast("string"))
    joined = named.filter(F.when(F.col("_known").isNull(), F.raise_error(lost).cast("boolean")).otherwise(True)).drop("_known")
    for column, (old, new) in (fragments or {}).items():
        absent = F.col(old).isNotNull() & ~F.coalesce(F.contains(F.col(column), F.col(old)), F.lit(False))
        error = F.raise_error(F.concat(F.lit(f"fragment not found in {column}: "), F.col(key).cast("string")))
        patched = F.when(absent, error.cast("string")).when(F.col(old).isNotNull(), F.replace(F.col(column), F.col(old), F.col(new)))
        joined = joined.withColumn(column, patched.otherwise(F.col(column)))
    for column in replace:
        joined = joined.withColumn(column, F.coalesce(f"new_{column}", column))
    return joined.select(*records.columns)


def quarantine(records: DataFrame, reasons: DataFrame, key: str, notes: str = "notes") -> tuple[DataFrame, DataFrame]:
    """(active, quarantined): rows with a reason leave the pool, the reason joins their notes."""
    active = records.join(reasons.select(key), key, "left_anti")
    note = F.concat_ws(" | ", F.nullif(F.col(notes), F.lit("")), F.concat(F.lit("QUARANTINED: "), F.col("reason")))
    moved = records.join(reasons.select(key, "reason"), key).withColumn(notes, note)
    return active, moved.select(*records.columns)
