"""Expressions on edge values."""

import datetime

import pytest
from pyspark.sql import functions as F

from siftbook.functions import dates, fixed, grading, layout
from siftbook.functions import text as X
from siftbook.operators.pairs import parse_numbered
from siftbook.operators.quality import detect_language


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("text, kept, cut", [
    ("[Document: a | Chapter: b]\n\nbody\n\nmore ", "body\n\nmore", "body\n\nmore "),
    ("no header\n\nbody", "no header\n\nbody", "body"),
    ("one line ", "one line", "one line "),
    ("[Document: a\nb]\n\nx", "x", "x"),
    ("", "", ""),
])
def test_headers(spark, text, kept, cut):
    assert value(spark, X.strip_header(F.lit(text))) == kept
    assert value(spark, X.cut_header(F.lit(text))) == cut


@pytest.mark.parametrize("text", ["", "   ", "a b c", " x　", "\x1ca b\n", "a  b\t\nc\r\n"])
def test_whitespace_as_in_python(spark, text):
    assert value(spark, X.strip(F.lit(text))) == text.strip()
    assert value(spark, X.collapse(F.lit(text))) == " ".join(text.split())
    assert value(spark, X.word_count(F.lit(text))) == len(text.split())


def test_keep_indent(spark):
    assert value(spark, X.keep_indent(F.lit("\n  \n  a  \n\n b \n \n"))) == "  a\n\n b"


@pytest.mark.parametrize("raw, letter", [
    ("Answer: B", "B"), ("I say the answer is option c.", "C"), ("the correct answer is D", "D"), ("we choose option a here", "A"),
    ("select B", "B"), ("x\nC) because", "C"), ("so B is the correct one", "B"), ("option D is correct", "D"), ("well\n  A  \n", "A"),
    ("the answer is a long story", "A"), ("no idea", None), ("Answer: E", None), ("", None), ("Answer: Bé", None),
])
def test_answer_letter(spark, raw, letter):
    assert value(spark, grading.answer_letter(F.lit(raw))) == letter


def test_penalty(spark):
    score = lambda p: value(spark, grading.penalised(F.lit(p).cast("string"), F.lit("B")))
    assert (score(None), score("B"), score("C")) == (0.0, 1.0, -0.5)


def test_shuffle_tracks_letters_not_texts(spark):
    order = value(spark, grading.shuffled_letters(F.lit("q1"), 42))
    assert sorted(order) == list("ABCD")
    for letter in "ABCD":
        shown = value(spark, grading.letter_at(F.lit(order), F.lit(letter)))
        assert value(spark, grading.original_letter(F.lit(order), F.lit(shown))) == letter


def test_dates(spark):
    made = lambda *p: value(spark, dates.date_from_parts(*[F.lit(x).cast("int") for x in p]))
    assert made(2024, 2, 31) == datetime.date(2024, 1, 1)
    assert made(2024, None, None) == datetime.date(2024, 1, 1)
    assert made(2024, 2, 29) == datetime.date(2024, 2, 29)
    assert made(None, 1, 1) is None


def test_headings(spark):
    rule = lambda text, size, bold: value(spark, layout.is_heading(F.lit(text), F.lit(size), F.lit(10.0), F.lit(bold)))
    assert rule("Methods", 14.0, False) and rule("Methods", 9.0, True)
    assert not rule("Methods", 13.0, False) and not rule("Methods", 8.0, True)
    assert not rule("12.3 -", 20.0, True) and not rule("ab", 20.0, True) and not rule("x" * 121, 20.0, True)
    assert value(spark, layout.chapter_of(F.lit("3. Results"))) == "Chapter 3"
    assert value(spark, layout.chapter_of(F.lit("chapter 12 end"))) == "Chapter 12"
    assert value(spark, layout.chapter_of(F.lit("Results"))) == "Unknown Chapter"


def test_validators(spark):
    choices = {x: x * 50 for x in "ABCD"}
    def valid(**change):
        row = {"question": "What is being asked here?", "choices": choices, "correct": "A", "explanation": "e", "level": "recall", "topic": "vaccine"} | change
        made = F.create_map(*[F.lit(y) for item in row["choices"].items() for y in item])
        cols = [made if k == "choices" else F.lit(row[k]).cast("string") for k in ("question", "choices", "correct", "explanation", "level", "topic")]
        return value(spark, grading.valid_question(*cols)), value(spark, grading.valid_aligned(*cols[:4], cols[5]))
    assert valid() == (True, True)
    assert valid(choices={**choices, "D": "short"}) == (True, False)
    assert valid(choices={x: "y" * 40 for x in "ABC"}) == (False, False)
    assert valid(correct="E") == valid(question=" short ") == valid(topic=None) == (False, False)
    assert valid(level="other") == (False, True)


def test_numbered_blocks(spark):
    raw = "intro\n1. **Instruction:** Do\nit\n**Input:** this\n**Output:** that\n2) Instruction: Only\nInput: x\n3. instruction: A\ninput: B\noutput: C"
    rows = parse_numbered(spark.createDataFrame([(raw,)], "raw string"), "raw").drop("raw").collect()
    assert sorted(map(tuple, rows)) == [("A", "B", "C"), ("Do\nit", "this", "that")]


def test_language(spark):
    lang = lambda s: value(spark, detect_language(F.lit(s)))
    assert lang("the house of the man is in the town and that is it") == "en"
    assert lang("der Hund und die Katze sind nicht in dem Haus") == "de"
    assert lang("the of and") == "unknown" and lang("xyz " * 20) == "unknown"


def test_shared_substring(spark):
    a = "x" * 20 + "the quick brown fox jumps over the lazy dog again and again"
    shares = lambda p, q: value(spark, X.shares_substring(F.lit(p), F.lit(q)))
    assert shares(a, "Then THE QUICK BROWN FOX JUMPS OVER THE LAZY DOG again and again.")
    assert not shares(a, "the quick brown fox") and not shares("short", "short")


def test_entities(spark):
    text = "The DNA of Rv0001c and katG, ESX-1 or PknB; HIV éSSeungé"
    assert value(spark, F.array_sort(X.entities(F.lit(text)))) == ["ESX-1", "PknB", "Rv0001c", "katG"]


def test_full_entity_table(spark):
    assert value(spark, X.clean_markup_full(F.lit("&lt;i&gt;M.&lt;/i&gt; <b>x</b>&alpha;&#945;&eacute;"))) == "M. xααé"


def test_entities_without_semicolon(spark):
    raw = F.lit("a &ampThe &ampp; &amp{x} &copyb &amp;lt; &lt;b&gt; &#945; &#x3b1; &eacute;")
    assert value(spark, X.clean_markup_full(raw, closed_only=True)) == "a &ampThe &ampp; &amp{x} &copyb &lt;  α α é"
    assert value(spark, X.clean_markup_full(raw)) == "a &The &p; &{x} ©b &lt;  α α é"


def test_published_counts():
    assert 607 + 120 + 167 + 66 == 960
    assert round((607 + 167) / 960, 4) == 0.8063 and round((607 + 66) / 960, 4) == 0.7010
    # 774 right, 184 wrong, 2 without an answer
    assert round((774 + fixed.WRONG_PENALTY * 184) / 960, 4) == 0.7104
