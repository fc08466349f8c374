"""Grading, leaderboards, consensus and review state.

``scored`` rows are (cond, id, predicted, correct_presented, is_correct, penalised, judge scores).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftbook.functions.stats import sign_p, student_p
from siftbook.functions import fixed
from siftbook.functions.grading import (
    answer_letter, is_right, letter_at, original_letter, penalised, present_choices, shuffled_letters,
)
from siftbook.operators.ranking import hash_order


def shuffle_questions(questions: DataFrame, key: str = "id", seed: int = 42) -> DataFrame:
    """Hash-ordered choices per question and the letter the key moves to."""
    ordered = questions.withColumn("letter_order", shuffled_letters(F.col(key), seed))
    if "choices" in questions.columns:
        ordered = ordered.withColumn("choices", present_choices(F.col("choices"), F.col("letter_order")))
    return ordered.withColumn("correct_presented", letter_at(F.col("letter_order"), F.col("correct")))


def grade(results: DataFrame) -> DataFrame:
    """Parse the letter out of the raw output and score it."""
    read = results.withColumn("predicted", answer_letter(F.col("raw_output")))
    return read.withColumn("is_correct", is_right(F.col("predicted"), F.col("correct_presented"))).withColumn(
        "penalised", penalised(F.col("predicted"), F.col("correct_presented"))
    )


def verify_order(results: DataFrame, questions: DataFrame, seed: int = 42) -> DataFrame:
    """Order of the choices as each condition showed them.

    A condition counts as shuffled when any of its answers has another key letter than the
    question. Its replayed order is only trusted where the recorded letter agrees; otherwise the
    order is null. A condition that was not shuffled shows the choices as they are.
    """
    return _replayed(results, questions.select("id", "correct"), seed).drop("correct")


def _replayed(results: DataFrame, questions: DataFrame, seed: int) -> DataFrame:
    joined = results.join(questions, "id").withColumn("_order", shuffled_letters(F.col("id"), seed))
    # a set of condition names, so the answers are not shuffled by a handful of keys
    moved = F.collect_set(F.when(F.col("correct_presented") != F.col("correct"), F.col("cond")))
    randomised = F.array_contains(joined.agg(moved.alias("conds")).scalar(), F.col("cond"))
    joined = joined.withColumn("randomised", randomised)
    agrees = F.col("correct_presented") == letter_at(F.col("_order"), F.col("correct"))
    order = F.when(~F.col("randomised"), "ABCD").when(agrees, F.col("_order"))
    return joined.withColumn("letter_order", order).drop("_order")


def condition_view(scored: DataFrame, questions: DataFrame, raw: DataFrame, seed: int = 42) -> DataFrame:
    """Each answer with the text it picked, that text's original letter and the raw output."""
    seen = _replayed(scored, questions.select("id", "correct", "choices"), seed)
    picked = original_letter(F.col("letter_order"), F.col("predicted"))
    joined = seen.join(raw.select("cond", "id", "raw_output"), ["cond", "id"], "left")
    # the letter is tracked through the order, so that equal texts keep their letters apart
    view = joined.withColumn("_slot", picked).withColumn("picked_text", F.try_element_at("choices", "_slot"))
    letter = F.when(F.col("picked_text").isNotNull(), F.col("_slot"))
    return view.withColumn("picked_letter", letter).withColumn("order_verified", F.col("letter_order").isNotNull()).drop("_slot")


def question_difficulty(views: DataFrame, questions: DataFrame) -> DataFrame:
    """How the conditions did on each question, and keys that most picks contradict."""
    per_pick = views.filter(F.col("picked_letter").isNotNull()).groupBy("id", "picked_letter").agg(F.count("*").alias("votes"), F.min("cond").alias("_first"))
    # most votes, then the pick that came first
    best = F.min_by(F.struct("picked_letter", "votes"), F.struct(-F.col("votes"), F.col("_first")))
    modal = per_pick.groupBy("id").agg(best.alias("top"), F.sum("votes").alias("picks"))
    named = lambda ok: F.array_join(F.array_sort(F.collect_list(F.when(F.col("is_correct") == ok, F.col("cond")))), ",")
    tally = views.groupBy("id").agg(
        F.count("*").alias("n_cond"), F.count_if("is_correct").alias("n_correct"),
        named(True).alias("right_in"), named(False).alias("wrong_in"),
    )
    joined = questions.join(tally, "id").join(modal, "id", "left")
    suspect = F.coalesce(
        (F.col("top.picked_letter") != F.col("correct")) & (F.col("top.votes") >= F.greatest(F.lit(3.0), 0.6 * F.col("picks"))), F.lit(False)
    )
    return joined.withColumn("key_suspect", suspect).withColumn("suspect_letter", F.when(suspect, F.col("top.picked_letter"))).drop("top", "picks")


def review_list(difficulty: DataFrame, level: str | None = None, topic: str | None = None, wrong_in: str | None = None,
                right_in: str | None = None, review: str | None = None, text: str | None = None, result: str | None = None) -> DataFrame:
    """Questions that satisfy every given condition of the review list."""
    c = F.lit(True)
    if level:
        c = c & (F.col("cognitive_level") == level)
    if topic:
        c = c & (F.col("topic") == topic)
    if wrong_in:
        c = c & F.array_contains(F.split("wrong_in", ","), wrong_in)
    if right_in:
        c = c & F.array_contains(F.split("right_in", ","), right_in)
    if review:
        c = c & (F.col("review") == review)
    if text:
        c = c & F.contains(F.lower(F.concat_ws(" ", "question", "document_name")), F.lit(text.lower()))
    n, right = F.col("n_cond"), F.col("n_correct")
    outcomes = {
        "allright": (n > 0) & (right == n), "allwrong": (n > 0) & (right == 0),
        "mixed": (right > 0) & (right < n), "suspect": F.col("key_suspect"),
    }
    if result:
        c = c & outcomes[result]
    return difficulty.filter(c)


def grading_summary(scored: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy per condition; a missing judge score counts as 0."""
    scores = [F.avg(F.coalesce(F.col(m), F.lit(0))).alias(f"avg_{m}") for m in fixed.METRICS]
    n_none = F.count_if(F.col("predicted").isNull())
    return scored.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if("is_correct").alias("n_correct"), n_none.alias("n_no_answer"),
        (F.count("*") - F.count_if("is_correct") - n_none).alias("n_wrong"),
        F.avg(F.col("is_correct").cast("int")).alias("accuracy"), F.avg("penalised").alias("penalised_accuracy"), *scores,
    )


def leaderboard(scored: DataFrame, questions: DataFrame, flagged: DataFrame, levels: tuple[str, ...] = fixed.LEVELS) -> DataFrame:
    """One row per condition: overall, without flagged questions, per level; missing scores ignored."""
    marks = flagged.select("id").distinct().withColumn("_flag", F.lit(True))
    joined = scored.join(questions.select("id", F.col("cognitive_level")), "id").join(marks, "id", "left")
    hit = F.col("is_correct").cast("int")
    return joined.groupBy("cond").agg(
        F.avg(hit).alias("overall"), F.avg(F.when(F.col("_flag").isNull(), hit)).alias("excluding_flagged"),
        F.count_if(F.col("_flag").isNull()).alias("n_excluding_flagged"),
        *[F.avg(F.when(F.col("cognitive_level") == x, hit)).alias(f"level_{x}") for x in levels],
        F.count_if(F.col("predicted").isNull()).alias("no_answer"),
        *[F.avg(m).alias(f"judge_{m}") for m in fixed.METRICS],
    )


def valid_reviews(reviews: DataFrame, questions: DataFrame, note_chars: int | None = fixed.NOTE_CHARS) -> DataFrame:
    """Reviews of known questions by a named reviewer with a known verdict; notes are cut to ``note_chars``, unless it is None."""
    named = F.trim(F.coalesce("reviewer", F.lit(""))) != ""
    ok = reviews.filter(named & F.col("verdict").isin(*fixed.REVIEW_VERDICTS))
    notes = F.coalesce("notes", F.lit(""))
    notes = notes if note_chars is None else F.left(notes, F.lit(note_chars))
    return ok.join(questions.select("qid").distinct(), "qid", "left_semi").withColumn("notes", notes)


def review_state(reviews: DataFrame, key: str = "qid", verdict: str = "verdict") -> DataFrame:
    """'good' when every verdict is, else 'flagged'."""
    good = F.bool_and(F.col(verdict) == "good")
    return reviews.groupBy(key).agg(F.count("*").alias("n_reviews"), F.when(good, "good").otherwise("flagged").alias("review"))


def win_tally(verdicts: DataFrame) -> DataFrame:
    """Wins, losses and ties with the order shown, so that position bias is visible."""
    return verdicts.groupBy("winner", "a_shown_first").agg(F.count("*").alias("n"))


def show_in_random_order(pairs: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Decide by hash which answer is shown first."""
    first = F.pmod(F.conv(F.substring(hash_order(seed, key), 1, 1), 16, 10).cast("int"), F.lit(2)) == 0
    return pairs.withColumn("a_shown_first", first).withColumns({
        "first_shown": F.when(first, F.col("a")).otherwise(F.col("b")),
        "second_shown": F.when(first, F.col("b")).otherwise(F.col("a")),
    })


def resolve_winner(judged: DataFrame, a_name: str = "a", b_name: str = "b") -> DataFrame:
    """Name behind a '1', '2' or 'tie' verdict; other verdicts are dropped."""
    first_is_a = F.col("a_shown_first") == (F.col("verdict") == "1")
    winner = F.when(F.col("verdict") == "tie", "tie").when(first_is_a, a_name).otherwise(b_name)
    return judged.filter(F.col("verdict").isin("1", "2", "tie")).withColumn("winner", winner)


def _both(scored: DataFrame, one: str, two: str, columns: list[str]) -> DataFrame:
    side = lambda cond, tag: scored.filter(F.col("cond") == cond).select("id", *[F.col(c).alias(f"{c}_{tag}") for c in columns])
    return side(one, "1").join(side(two, "2"), "id")


def flip_table(scored: DataFrame, one: str, two: str) -> DataFrame:
    """How answers change from one condition to the other."""
    a, b = F.col("is_correct_1"), F.col("is_correct_2")
    return _both(scored, one, two, ["is_correct"]).agg(
        F.count("*").alias("n"), F.count_if(a & b).alias("both_right"), F.count_if(~a & ~b).alias("both_wrong"),
        F.count_if(a & ~b).alias("right_to_wrong"), F.count_if(~a & b).alias("wrong_to_right"),
    )


def paired_tests(scored: DataFrame, one: str, two: str, metric: str) -> DataFrame:
    """McNemar statistic on changed answers and paired t statistic on one judge score, each with its p-value.

    The p-value of the changes is the exact binomial one, that of the gap is two-sided for Student's t.
    """
    a, b = F.col("is_correct_1"), F.col("is_correct_2")
    gap = F.col(f"{metric}_1") - F.col(f"{metric}_2")
    sums = _both(scored, one, two, ["is_correct", metric]).agg(
        F.count_if(a & ~b).alias("b"), F.count_if(~a & b).alias("c"),
        F.count(gap).alias("n"), F.avg(gap).alias("mean_gap"), F.stddev_samp(gap).alias("sd_gap"),
    )
    changed = F.col("b") + F.col("c")
    margin = F.greatest(F.abs(F.col("b") - F.col("c")) - 1, F.lit(0))
    tested = sums.withColumn("mcnemar", F.try_divide(margin * margin, changed)).withColumn(
        "t", F.try_divide(F.col("mean_gap"), F.col("sd_gap") / F.sqrt("n"))
    )
    return tested.withColumns({"mcnemar_p": sign_p(F.col("b"), F.col("c")), "t_p": student_p(F.col("t"), F.col("n") - 1)})


def accuracy_by(scored: DataFrame, *keys: str | Column) -> DataFrame:
    """Accuracy per group, such as gate decision and condition."""
    return scored.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col("is_correct").cast("int")).alias("accuracy"))


def position_shares(questions: DataFrame, letter: str) -> DataFrame:
    """Share of each answer position; a working shuffle gives about a quarter each."""
    total = questions.agg(F.count("*").alias("n")).scalar()
    return questions.groupBy(letter).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / total)
