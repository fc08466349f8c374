"""Instruction pairs: parsing, building, auditing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftbook.functions import fixed
from siftbook.functions.text import blank_to_null, entities, let, meta_leak, shares_substring, strip, word_count


def parse_numbered(df: DataFrame, text: str) -> DataFrame:
    """Instruction, input and output of each numbered block; incomplete blocks are dropped."""
    blocks = df.withColumn("_block", F.explode(F.split(strip(F.col(text)), fixed.BLOCK_START)))

    def part(pattern: str) -> Column:
        return blank_to_null(strip(F.regexp_extract("_block", pattern, 1)))

    parts = blocks.withColumns({
        "instruction": part(fixed.INSTRUCTION_PART),
        "input": F.coalesce(part(fixed.INPUT_PART), F.lit("")),
        "output": part(fixed.OUTPUT_PART),
    })
    return parts.filter(F.col("instruction").isNotNull() & F.col("output").isNotNull()).drop("_block")


def chat_messages(instruction: Column, extra: Column, output: Column) -> Column:
    """User and assistant turn; extra input follows the instruction after a blank line."""
    user = F.when(F.coalesce(extra, F.lit("")) == "", instruction).otherwise(F.concat(instruction, F.lit("\n\n"), extra))
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("user", user), turn("assistant", output))


def content_of(messages: Column, role: str, last: bool = False) -> Column:
    """Content of the first (or last) message with a role."""
    said = F.filter(messages, lambda m: m["role"] == role)
    return F.try_element_at(said, F.lit(-1 if last else 1))["content"]


def to_messages(turns: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """Message array per conversation in order of turns."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.col(text).alias("content"))))
    return turns.groupBy(key).agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def auto_checks(answer: Column, passage: Column, listed: int | None = fixed.UNGROUNDED_LISTED) -> dict[str, Column]:
    """Quality columns of an answer against its passage; names not in it are listed up to ``listed``, all if it is None."""
    found = entities(answer)
    grounded = let(F.lower(passage), lambda p: F.filter(found, lambda e: F.contains(p, F.lower(e))))
    ratio = F.round(F.size(grounded) / F.size(found), 2)
    missing = F.array_sort(F.array_except(found, grounded))
    return {
        "words": word_count(answer),
        "meta_leak": meta_leak(answer),
        "n_entities": F.size(found).cast("long"),
        "entity_grounding": F.when(F.size(found) > 0, ratio),
        "ungrounded_entities": missing if listed is None else F.slice(missing, 1, listed),
    }


def qc_summary(checked: DataFrame) -> DataFrame:
    """Totals over checked pairs."""
    low, high = fixed.QC_WORDS
    return checked.agg(
        F.count("*").alias("n_pairs"), F.count_if("meta_leak").alias("n_leaks"),
        F.count_if(~F.col("words").between(low, high)).alias("n_outside_words"),
        F.avg("entity_grounding").alias("mean_grounding"),
        F.count_if(F.col("entity_grounding") < 0.5).alias("n_low_grounding"),
    )


def claim_summary(claims: DataFrame, pair: str, verdict: str) -> DataFrame:
    """Claim verdicts and pairs with a contradiction, from one row per claim."""
    per_pair = claims.groupBy(pair).agg(
        *[F.count_if(F.col(verdict) == v).alias(v) for v in ("supported", "unsupported", "contradicted")], F.count("*").alias("n")
    )
    return per_pair.agg(
        F.sum("n").alias("n_claims"), F.sum("supported").alias("supported"), F.sum("unsupported").alias("unsupported"),
        F.sum("contradicted").alias("contradicted"), F.count_if(F.col("contradicted") > 0).alias("pairs_contradicted"), F.count("*").alias("n_pairs"),
    )


def audit_flags(instruction: Column, extra: Column, output: Column, category: Column) -> dict[str, Column]:
    """Problem flags of an instruction record."""
    facts = (
        instruction.rlike("(?U)" + fixed.AUDIT_GENE) | instruction.rlike(fixed.AUDIT_MEASURE)
        | F.contains(instruction, F.lit("Passage:")) | instruction.rlike("(?U)" + fixed.AUDIT_FIRST_PERSON)
    )
    fits = (word_count(output) >= fixed.AUDIT_MIN_WORDS) & output.rlike(fixed.AUDIT_ALTERNATIVE) & output.rlike(fixed.AUDIT_ACTION)
    return {
        "instruction_contains_facts": facts,
        "instruction_output_mismatch": instruction.rlike(fixed.AUDIT_TRIGGER) & ~fits,
        "output_copies_input": shares_substring(extra, output),
        "output_too_short": (category != "structured_extraction") & (word_count(output) < fixed.AUDIT_SHORT_WORDS),
    }


def audit_totals(flagged: DataFrame, flags: list[str]) -> DataFrame:
    """Records per flag and records with any flag."""
    any_flag = F.lit(False)
    for f in flags:
        any_flag = any_flag | F.col(f)
    return flagged.agg(F.count("*").alias("n"), *[F.count_if(f).alias(f) for f in flags], F.count_if(any_flag).alias("n_flagged"))
