"""Answer parsing and scoring expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftbook.functions import fixed
from siftbook.functions.text import blank_to_null, strip


def answer_letter(raw: Column) -> Column:
    """Letter of the first pattern that matches, null when none does."""
    # ^ and $ at \n only, word borders for any script
    found = [blank_to_null(F.regexp_extract(raw, f"(?imdU){p}", 1)) for p in fixed.ANSWER_PATTERNS]
    return F.upper(F.coalesce(*found))


def letter_or_null(c: Column) -> Column:
    up = strip(F.upper(c))
    return F.when(up.isin(*fixed.LETTERS), up)


def is_right(predicted: Column, correct: Column) -> Column:
    return F.coalesce(predicted == correct, F.lit(False))


def penalised(predicted: Column, correct: Column) -> Column:
    return (
        F.when(predicted.isNull(), F.lit(0.0))
        .when(predicted == correct, F.lit(1.0))
        .otherwise(F.lit(fixed.WRONG_PENALTY))
    )


def shuffled_letters(key: Column, seed: int) -> Column:
    """The four letters in hash order of the key, e.g. 'CABD'."""
    tagged = F.array(*[F.concat(F.md5(F.concat_ws("|", F.lit(str(seed)), key, F.lit(x))), F.lit(x)) for x in fixed.LETTERS])
    return F.array_join(F.transform(F.array_sort(tagged), lambda t: F.right(t, F.lit(1))), "")


def letter_at(order: Column, original: Column) -> Column:
    """Presented letter of an original letter under an order."""
    return F.substring(F.lit("ABCD"), F.instr(order, original), F.lit(1))


def original_letter(order: Column, presented: Column) -> Column:
    """Original letter behind a presented one."""
    return blank_to_null(F.substring(order, F.instr(F.lit("ABCD"), presented), F.lit(1)))


def present_choices(choices: Column, order: Column) -> Column:
    """Choice map relabelled by an order."""
    texts = [choices[F.substring(order, i + 1, 1)] for i in range(4)]
    return F.map_from_arrays(F.array(*[F.lit(x) for x in fixed.LETTERS]), F.array(*texts))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.transform(powers, lambda x: x / total)


def argmax_letter(values: Column) -> Column:
    """Letter of the largest value; the first one wins ties."""
    return F.substring(F.lit("ABCD"), F.array_position(values, F.array_max(values)).cast("int"), F.lit(1))


# -- item validators -------------------------------------------------------------------------

def _four_choices(choices: Column) -> Column:
    return F.array_sort(F.map_keys(choices)) == F.array(*[F.lit(x) for x in fixed.LETTERS])


def _long_choices(choices: Column) -> Column:
    return F.forall(F.map_values(choices), lambda v: F.length(strip(v)) >= fixed.MIN_CHOICE_CHARS)


def _all_present(*cols: Column) -> Column:
    ok = F.lit(True)
    for c in cols:
        ok = ok & c.isNotNull()
    return ok


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def valid_question(question: Column, choices: Column, correct: Column, explanation: Column,
                   level: Column, topic: Column) -> Column:
    return _sure(
        _all_present(question, choices, correct, explanation, level, topic)
        & _four_choices(choices) & correct.isin(*fixed.LETTERS)
        & (F.length(strip(question)) >= fixed.MIN_QUESTION_CHARS)
        & level.isin(*fixed.LEVELS) & topic.isin(*fixed.TOPICS)
    )


def valid_aligned(question: Column, choices: Column, correct: Column, explanation: Column, topic: Column) -> Column:
    return _sure(
        _all_present(question, choices, correct, explanation, topic)
        & _four_choices(choices) & correct.isin(*fixed.LETTERS)
        & (F.length(strip(question)) >= fixed.MIN_QUESTION_CHARS)
        & topic.isin(*fixed.TOPICS) & _long_choices(choices)
    )


def valid_verified(verdict: Column, choices: Column, correct: Column, explanation: Column) -> Column:
    return _sure(
        _all_present(verdict, choices, correct, explanation)
        & verdict.isin(*fixed.VERDICTS) & _four_choices(choices)
        & correct.isin(*fixed.LETTERS) & _long_choices(choices)
    )
