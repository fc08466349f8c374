"""Document-level quality: regrouping, language, topic mentions, keep or drop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftbook.functions import fixed
from siftbook.functions.text import mentions, strip, strip_header
from siftbook.operators import languages


def regroup(df: DataFrame, document: str, order: str, text: str, sep: str = " ") -> DataFrame:
    """One row per document with its parts joined in order.

    The full text is the result, so a document has to fit one string. Decisions about documents
    do not need it: see :func:`decide_documents`.
    """
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    joined = F.array_join(F.transform(parts, lambda p: p["t"]), sep)
    return df.groupBy(document).agg(joined.alias("full_text"), F.count("*").alias("n_chunks"))


LETTERS = "a-zà-öø-ÿ"


def language_votes(c: Column, stop_words: dict[str, tuple[str, ...]] | None = None) -> dict[str, Column]:
    """Stop words of each language in a whole text."""
    words, low = stop_words or fixed.STOP_WORDS, F.lower(c)
    return {lang: F.regexp_count(low, F.lit(rf"(?<![{LETTERS}])(?:{'|'.join(words[lang])})(?![{LETTERS}])")) for lang in sorted(words)}


def elected(votes: dict[str, Column], characters: Column) -> Column:
    """Language with most votes, the earlier name if two have as many; short or unmatched text is 'unknown'."""
    # 'unknown' stands between one vote and none
    nobody = F.struct(F.lit(-0.5).alias("v"), F.lit("unknown").alias("lang"))
    ballots = [F.struct((-n).cast("double").alias("v"), F.lit(lang).alias("lang")) for lang, n in votes.items()]
    return F.when(characters > 20, F.array_min(F.array(nobody, *ballots))["lang"]).otherwise("unknown")


def detect_language(c: Column, stop_words: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Language with most stop words in the whole text."""
    return elected(language_votes(c, stop_words), F.length(F.trim(c)))


def decide_documents(chunks: DataFrame, document: str, text: str, language: str = "en", topic: str = fixed.TOPIC,
                     least: int = fixed.MIN_MENTIONS, stop_words: dict[str, tuple[str, ...]] | None = None, profiles: DataFrame | None = None) -> DataFrame:
    """Reason to drop each document, null to keep it; language is judged first.

    Mentions and language votes of all chunks are added up in one aggregate, so no document is put
    together in one place. Chunks without a document name are judged together. With ``profiles`` of
    :func:`siftbook.operators.languages.learn` these decide the language instead of stop words.
    """
    body = chunks.select(document, strip_header(F.col(text)).alias("_body"))
    if profiles is not None:
        counts = body.groupBy(document).agg(F.coalesce(F.sum(mentions(F.col("_body"), topic)), F.lit(0)).alias("mentions"), F.count("*").alias("n_chunks"))
        found = languages.detect(body, document, "_body", profiles).withColumnRenamed(document, "_found")
        judged = counts.join(found, counts[document].eqNullSafe(found["_found"]))
        return judged.select(document, _reason(language, least).alias("reason"), "detected_lang", "mentions", "n_chunks")
    votes = language_votes(F.col("_body"), stop_words)
    parts = body.select(document, mentions(F.col("_body"), topic).alias("_mentions"), F.length("_body").alias("_chars"), *[n.alias(f"_votes_{lang}") for lang, n in votes.items()])
    # as long as the bodies joined by blanks
    characters = F.sum(F.when(F.col("_chars") > 0, F.col("_chars") + 1)) - 1
    counts = parts.groupBy(document).agg(
        F.sum("_mentions").alias("mentions"), F.count("*").alias("n_chunks"), F.coalesce(characters, F.lit(0)).alias("_chars"),
        *[F.sum(f"_votes_{lang}").alias(f"_votes_{lang}") for lang in votes],
    )
    judged = counts.withColumn("detected_lang", elected({lang: F.coalesce(f"_votes_{lang}", F.lit(0)) for lang in votes}, F.col("_chars")))
    return judged.select(document, _reason(language, least).alias("reason"), "detected_lang", "mentions", "n_chunks")


def _reason(language: str, least: int) -> Column:
    return F.when(F.col("detected_lang") != language, "NON_ENGLISH").when(F.coalesce("mentions", F.lit(0)) < least, "OFF_TOPIC_LOW_MENTIONS")


def split_by_decision(chunks: DataFrame, decisions: DataFrame, document: str) -> DataFrame:
    """Every chunk follows its document, those without a name as well."""
    reasons = decisions.select(F.col(document).alias("_document"), "reason")
    return chunks.join(reasons, chunks[document].eqNullSafe(reasons["_document"])).drop("_document")


def drop_repeated(blocks: DataFrame, document: str, text: str) -> DataFrame:
    """Drop short blocks that a document repeats, such as running heads; blanks around them do not count.

    Only short blocks are counted and compared, longer ones are not shuffled.
    """
    stripped = blocks.withColumn("_text", strip(F.col(text)))
    short = F.length("_text") < fixed.REPEAT_CHARS
    shorts, others = stripped.filter(short), blocks.filter(F.coalesce(F.length(strip(F.col(text))) >= fixed.REPEAT_CHARS, F.lit(True)))
    counts = shorts.groupBy(F.col(document).alias("_document"), F.col("_text").alias("_block")).agg(F.count("*").alias("_times"))
    noisy = counts.filter(F.col("_times") > fixed.REPEAT_LIMIT)
    same = shorts[document].eqNullSafe(noisy["_document"]) & (shorts["_text"] == noisy["_block"])
    return shorts.join(noisy, same, "left_anti").drop("_text").unionByName(others)


def upper_median(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Element n // 2 of the sorted values, the default size for a group without any.

    Taken as the discrete median in falling order: counts per distinct value are combined before
    the shuffle.
    """
    usable = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN {value} > 0 THEN {value} END DESC)")
    return df.groupBy(*group).agg(F.coalesce(usable, F.lit(fixed.DEFAULT_FONT_SIZE)).alias("median_size"))


def block_style(spans: DataFrame, block: list[str], text: str, size: str, mono: str, bold: str) -> DataFrame:
    """Character-weighted size, share of monospace text and dominant bold of each block."""
    n = F.length(text)
    sized = F.when(F.col(size) > 0, n)
    total = F.sum(n)
    return spans.groupBy(*block).agg(
        F.coalesce(F.try_divide(F.sum(F.col(size) * sized), F.sum(sized)), F.lit(0.0)).alias("avg_size"),
        F.coalesce(F.round(F.try_divide(F.sum(F.when(F.col(mono), n).otherwise(0)), total), 3), F.lit(0.0)).alias("mono_ratio"),
        F.coalesce(F.try_divide(F.sum(F.when(F.col(bold), n).otherwise(0)), total) > fixed.BOLD_SHARE, F.lit(False)).alias("is_bold"),
    )


def completeness(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Rows per key against the expected number."""
    counts = found.groupBy(key).agg(F.count("*").alias("n_found"))
    joined = expected.join(counts, key, "left").withColumn("n_found", F.coalesce("n_found", F.lit(0)))
    return joined.withColumn("complete", F.col("n_found") >= F.col("n_expected"))
