"""Operators against brute force on small fixtures with hot groups and copies."""

import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftbook.functions import fixed, stats
from siftbook.functions.text import content_key
from siftbook.operators import chunk_splits, dedup, evaluation, languages, lookups, metric_index, packing, quality, ranking, records, retrieval
from siftbook.session import scratch_path
from siftbook.sources import landed
from siftbook.streaming import incremental


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one group."""
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 == 0 else f"g{rng.randrange(30)}", float(rng.randrange(50))) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, g string, v double").repartition(8).cache()


def pairs(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=lambda r: [(v is not None, v) for v in r])


@pytest.mark.parametrize("within", [[], ["g"]])
def test_ranks_equal_window_ranks(skewed, within):
    plain = W.partitionBy(*within).orderBy(ranking.hash_order(7, "id"), "id")
    expected = skewed.withColumn("rank", F.row_number().over(plain).cast("long"))
    assert pairs(ranking.hash_rank(skewed, ["id"], 7, within), "id", "rank") == pairs(expected, "id", "rank")
    expected = skewed.withColumn("rank", F.row_number().over(W.partitionBy(*within).orderBy(F.desc("v"), "id")).cast("long"))
    assert pairs(ranking.ordered_rank(skewed, [F.desc("v"), F.col("id")], within), "id", "rank") == pairs(expected, "id", "rank")


def test_tiles_equal_ntile(skewed):
    expected = skewed.withColumn("tile", F.ntile(7).over(W.orderBy("v", "id")).cast("long"))
    assert pairs(ranking.tiles(skewed, "v", "id", 7), "id", "tile") == pairs(expected, "id", "tile")


def test_top_per_group(skewed):
    expected = skewed.withColumn("r", F.row_number().over(W.partitionBy("g").orderBy("v", "id"))).filter("r <= 11")
    assert pairs(ranking.top_per_group(skewed, ["g"], [F.col("v"), F.col("id")], F.lit(11), 11), "id") == pairs(expected, "id")


def test_samples_have_their_sizes(skewed):
    split = ranking.train_validation(skewed, ["id"], 0.02).groupBy("split").count().collect()
    assert {r[0]: r[1] for r in split} == {"val": 60, "train": 2940}
    assert ranking.stratified_sample(skewed, "g", ["id"], 50).count() == 50
    shards = ranking.shard(skewed, [F.col("id")], 16).groupBy("shard").count().collect()
    assert len(shards) == 16 and max(r[1] for r in shards) - min(r[1] for r in shards) <= 1
    kinds = ranking.assign_categories(skewed, ["id"], ["a", "b", "c"]).groupBy("category").count().collect()
    assert sorted(r[1] for r in kinds) == [1000, 1000, 1000]


def test_top_fraction_ignores_nan(spark):
    df = spark.createDataFrame([(i, float("nan") if i % 2 else float(i)) for i in range(100)], "id long, s double")
    assert pairs(ranking.top_fraction(df, "s", "id", 0.1), "id") == [(i,) for i in (90, 92, 94, 96, 98)]


def test_median(spark):
    df = spark.createDataFrame([(i, float(i * i)) for i in range(10)], "id long, v double")
    assert ranking.exact_median(df, "v") == (16 + 25) / 2
    assert ranking.exact_median(df.filter("id < 9"), "v") == 16


def test_selection_without_a_sort(spark):
    """Outliers, hot values, long numbers and few steps a round, against sorted lists; the plan of the result moves no rows."""
    rng = random.Random(9)
    rows = [(i, rng.choice([0.0, -1e308, 1e308, 5e-324, 2.5, 2.5, 2.5, rng.gauss(0, 1)])) for i in range(600)]
    rows += [(2**62 + i, 2.5) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, v double").repartition(5).cache()
    ordered = sorted((v, i) for i, v in rows)
    for n in (1, 7, 300, 451, 620):
        value, place = ranking.select_nth(df, F.col("v"), n, buckets=5, small=3)
        assert value == ordered[n - 1][0] and place == n - sum(v < value for v, _ in ordered)
        assert ranking.select_nth(df, F.col("id"), n, buckets=5, small=3) == (sorted(i for i, _ in rows)[n - 1], 1)
        assert pairs(df.filter(ranking.first_rows(df, F.col("v"), "id", n)), "v", "id") == ordered[:n]
    best = ranking.top_fraction(df, "v", "id", 0.3)
    assert pairs(best, "id") == sorted((i,) for _, i in sorted((-v, i) for i, v in rows)[:186])
    assert "Exchange" not in best._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert ranking.top_fraction(df.limit(0), "v", "id", 0.3).count() == 0


def test_few_shot(spark):
    seeds = spark.createDataFrame([(i, "a" if i < 20 else "b") for i in range(25)], "sid long, c string")
    records_ = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "rid long, c string")
    got = ranking.few_shot(records_, seeds, "rid", "sid", "c").collect()
    for rid in range(40):
        mine = [r["sid"] for r in got if r["rid"] == rid]
        assert len(mine) == len(set(mine)) == (5 if rid % 2 else 8)
        assert all((s >= 20) == bool(rid % 2) for s in mine)


def greedy_first_seen(rows):
    seen, out = set(), []
    for key, *names in sorted(rows):
        named = {(i, n) for i, n in enumerate(names) if n}
        if named:
            out.append((key, bool(named & seen)))
            if not named & seen:
                seen |= named
    return out


def test_any_key_duplicates(spark):
    rng = random.Random(3)
    pick = lambda n: rng.choice([None, "", *[str(rng.randrange(n)) for _ in range(3)]])
    rows = [(i, pick(40), pick(60), "same" if i % 3 == 0 else pick(80)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string")
    assert pairs(dedup.first_seen_by_any_key(df, "id", ["a", "b", "c"]), "id", "is_copy") == greedy_first_seen(rows)


def test_any_key_duplicates_along_a_chain(spark):
    """Each row shares a name with the next one only, so every second row is kept."""
    even, own, after = F.col("id") % 2 == 0, F.concat(F.lit("n"), F.col("id")), F.concat(F.lit("n"), F.col("id") + 1)
    chained = spark.range(5000).select("id", F.when(even, own).otherwise(after).alias("a"), F.when(even, after).otherwise(own).alias("b"))
    got = {r["id"]: r["is_copy"] for r in dedup.first_seen_by_any_key(chained, "id", ["a", "b"]).collect()}
    assert got == {i: i % 2 == 1 for i in range(5000)}


def test_any_key_duplicates_in_one_large_component(spark):
    """Chains, rows that wait for several rows and a name that a third of all rows have, all connected."""
    rng = random.Random(11)
    rows = [(i, f"n{i // 2}", f"m{(i + 1) // 2}", "hot" if i % 3 == 2 and i > 40 else f"h{rng.randrange(150)}") for i in range(400)]
    rows += [rows[7], (500, None, "", None), (501, "", None, "hot")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, a string, b string, c string")
    got = {r["id"]: r["is_copy"] for r in dedup.first_seen_by_any_key(df, "id", ["a", "b", "c"]).collect()}
    assert got == dict(greedy_first_seen(sorted(set(rows), key=lambda r: r[0])))
    assert dedup.first_seen_by_any_key(df.limit(0), "id", ["a", "b", "c"]).count() == 0


def test_shared_substrings_equal_all_pairs(spark):
    """Slices in texts without blanks, in other scripts, at both ends, short and null texts, many copies of one text."""
    rng = random.Random(12)
    letters = "ab 漢字é\U0001f600"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    probes = [(i, text(rng.randrange(0, 60))) for i in range(25)] + [(90, None), (91, ""), (92, "A" * 45)]
    cut = lambda p: p[rng.randrange(0, 3) * 5:][: rng.randrange(8, 30)]
    texts = [(i, text(rng.randrange(0, 30)) + cut(rng.choice(probes[:25])[1]).upper() + text(rng.randrange(0, 30))) for i in range(80)]
    texts += [(100 + i, "a" * 30) for i in range(40)] + [(200, None), (201, "")]
    p, t = spark.createDataFrame(probes, "p long, text string"), spark.createDataFrame(texts, "t long, text string").repartition(5)
    slices = {i: {x.lower()[k : k + 8] for k in range(0, len(x) - 7, 5)} for i, x in probes if x}
    expected = sorted((i, j) for i, own in slices.items() for j, y in texts if y and any(c in y.lower() for c in own))
    assert expected and pairs(lookups.shared_substrings(p, t, "p", "t", "text", width=8, stride=5), "p", "t") == expected


def test_p_values(spark):
    """Against published tables and exact fractions: quantiles of Student's t, binomial sums, closed forms of the beta function."""
    from fractions import Fraction
    from math import atan, comb, pi, sqrt

    def one(c):
        return spark.range(1).select(c).first()[0]

    lit = lambda x: F.lit(float(x))
    for t, df, p in ((12.706204736432095, 1, 0.05), (2.228138851964939, 10, 0.05), (1.9839715184496334, 100, 0.05), (3.169272667175838, 10, 0.01)):
        assert abs(one(stats.student_p(lit(t), F.lit(df))) - p) < 1e-9
    for t in (0.0, 0.5, 3.0):  # one and two degrees of freedom
        assert abs(one(stats.student_p(lit(t), F.lit(1))) - (1 - 2 * atan(t) / pi)) < 1e-12
        assert abs(one(stats.student_p(lit(-t), F.lit(2))) - (1 - t / sqrt(2 + t * t))) < 1e-12
    for b, c in ((0, 0), (3, 3), (0, 5), (12, 4), (48, 53), (400, 460), (2, 900)):
        exact = min(Fraction(1), 2 * Fraction(sum(comb(b + c, k) for k in range(min(b, c) + 1)), 2 ** (b + c)))
        assert abs(one(stats.sign_p(F.lit(b), F.lit(c))) - float(exact)) < 1e-9
    for x in (0.0, 0.1, 0.5, 0.99, 1.0):  # I_x(a, 1) = x ** a
        assert abs(one(stats.incomplete_beta(lit(x), lit(3.5), lit(1))) - x**3.5) < 1e-12
    assert one(stats.student_p(lit(1), F.lit(0))) is None
    assert abs(one(stats.sign_p(F.lit(100_200), F.lit(100_000))) - 0.6565) < 1e-3


def test_equal_choices_keep_their_letters(spark):
    choices = "map('A', 'same', 'B', 'other', 'C', 'same', 'D', 'last')"
    questions = spark.range(1).selectExpr("'q' AS id", "'C' AS correct", f"{choices} AS choices")
    graded = evaluation.grade(spark.createDataFrame([("base", "q", "C", "C"), ("base", "r", "A", "A")], "cond string, id string, correct_presented string, raw_output string"))
    view = evaluation.condition_view(graded.drop("raw_output"), questions, graded).first()
    assert (view["picked_letter"], view["picked_text"]) == ("C", "same")


def greedy_chunks(items, limit):
    chunks, used, last = [], 0, None
    for kind, content, section in items:
        if kind == "table":
            chunks.append([content])
            last = None
            continue
        if last is None or section != last or used + len(content) > limit:
            chunks.append([])
            used = 0
        chunks[-1].append(content)
        used += len(content)
        last = section
    return ["\n\n".join(c) for c in chunks]


def test_packing(spark):
    rng = random.Random(1)
    rows, expected = [], {}
    for doc in range(30):
        items = [(rng.choice(["text"] * 6 + ["table"]), chr(97 + i % 26) * rng.choice([5, 40, 90, 250]), f"s{i // rng.choice([3, 5])}") for i in range(rng.randrange(1, 60))]
        rows += [(doc, i, k, c, s, s) for i, (k, c, s) in enumerate(items)]
        expected[doc] = greedy_chunks(items, 200)
    df = spark.createDataFrame(rows, "doc long, no long, kind string, content string, chapter string, section_title string").repartition(8)
    got = {}
    for r in packing.pack_elements(df, "doc", "no", "content", "kind", 200).orderBy("doc", "chunk").collect():
        got.setdefault(r["doc"], []).append(r["text"])
    assert got == expected


def test_steps_of_rows_without_a_cut():
    rng = np.random.default_rng(5)
    for _ in range(400):
        sizes, limit = rng.integers(0, rng.choice([3, 9, 30]), rng.integers(1, 40)), 20
        upto, times, ends = chunk_splits.steps(sizes, limit)
        for used in range(0, 45):
            step = next((i for i, u in enumerate(upto) if used > limit or u > limit - used), None)
            now, begun = used, 0
            for size in sizes:
                begun, now = (begun + 1, size) if now + size > limit else (begun, now + size)
            assert (begun, now) == ((0, used + sizes.sum()) if step is None else (times[step], ends[step]))


@pytest.mark.parametrize("splits", [2, 7, 40])
def test_a_long_document_is_packed_in_many_splits(spark, splits):
    rng = random.Random(splits)
    rows, expected = [], {}
    for doc, n, sections in ((None, 40, 3), (1, 30, 2), (2, 900, 1), (3, 500, 4), (4, 3, 1), (5, 1, 1), (6, 60, 60)):
        items = []
        for i in range(n):
            text = rng.choice([None, "", "x", "y" * 40, "z" * 90, "w" * 250] if doc != 6 else ["", None])
            items.append(("table" if doc == 3 and rng.random() < 0.02 else rng.choice(["text", "note"]), text, f"s{i * sections // n}" if doc != 6 else "s"))
        rows += [(doc, i, k, c, s, s, i // 10) for i, (k, c, s) in enumerate(items)]
        expected[doc] = packed_by_hand(items, 200)
    df = spark.createDataFrame(rows, "doc long, no long, kind string, content string, chapter string, section_title string, page long").repartition(8)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", splits)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {}
        for r in packing.pack_elements(df, "doc", "no", "content", "kind", 200, page="page").orderBy("doc", "chunk").collect():
            got.setdefault(r["doc"], []).append((r["chunk"], r["content_type"], r["section_title"], r["text"], r["n_elements"], r["first_page"], r["last_page"]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == expected
    assert packing.pack_elements(df.limit(0), "doc", "no", "content", "kind", 200).count() == 0


def packed_by_hand(items, limit):
    """Chunks of (kind, text, section) rows, ten rows a page."""
    chunks = []
    for i, (kind, text, section) in enumerate(items):
        size, last = len(text or ""), chunks[-1] if chunks else None
        if last is None or "table" in (kind, last["kind"]) or last["section"] != section or last["used"] + size > limit:
            chunks.append({"kind": kind, "section": section, "used": 0, "texts": [], "rows": []})
        chunks[-1]["used"] += size
        chunks[-1]["texts"] += [text] if text is not None else []
        chunks[-1]["rows"].append(i)
    return [(n, c["kind"], c["section"], "\n\n".join(c["texts"]), len(c["rows"]), c["rows"][0] // 10, c["rows"][-1] // 10) for n, c in enumerate(chunks, 1)]


@pytest.mark.parametrize("block", [3, 10_000])
def test_fill_forward(spark, block):
    rng = random.Random(8)
    rows, expected = [], []
    for doc in ("hot", "b", "c"):
        last = None
        for i in range(300 if doc == "hot" else 20):
            v = f"{doc}{i}" if rng.random() < 0.1 else None
            last = v or last
            rows.append((doc, i, v))
            expected.append((doc, i, last))
    df = spark.createDataFrame(rows, "d string, o long, v string").repartition(8)
    got = packing.fill_forward(df, "d", "o", {"filled": F.col("v")}, block)
    assert {(r["d"], r["o"]): r["filled"] for r in got.collect()} == {(d, o): v for d, o, v in expected}


def test_sections_stop(spark):
    names = ["intro line", "Methods", "text", "References", "a paper", "Appendix", "more"]
    rows = [("d", i, n, n[0].isupper()) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "d string, o long, t string, h boolean")
    got = pairs(packing.fill_sections(df, "d", "o", "t", "h"), "o", "section_title", "chapter")
    assert got == [(0, "Unknown Section", "Unknown Chapter"), (1, "Methods", "Unknown Chapter"), (2, "Methods", "Unknown Chapter")]


def test_decisions_equal_those_on_regrouped_text(spark):
    rng = random.Random(2)
    words = ["the", "and", "der", "und", "les", "tion", "x"]
    rows = [(i, None if i % 5 == 0 else "hot" if i % 3 else f"d{i % 7}", " ".join(rng.choices(words, k=rng.choice([0, 1, 300])))) for i in range(400)]
    df = spark.createDataFrame(rows, "o long, d string, t string").repartition(8)
    full = quality.regroup(df, "d", "o", "t").select("d", quality.detect_language(F.col("full_text")).alias("lang"), "n_chunks")
    decided = quality.decide_documents(df, "d", "t", topic="tion", least=5)
    assert pairs(decided, "d", "detected_lang", "n_chunks") == pairs(full, "d", "lang", "n_chunks")
    assert quality.split_by_decision(df, decided, "d").count() == 400
    only = {"xx": ("x",)}
    assert {r["detected_lang"] for r in quality.decide_documents(df, "d", "t", stop_words=only).collect()} == {"xx"}


def test_rows_without_keys_are_no_copies(spark):
    texts = ["Это текст", "这是文本", None, "", "Это, текст!", "plain", "PLAIN.", "!?"]
    df = spark.createDataFrame(list(enumerate(texts, 1)), "id long, t string")
    kept = dedup.drop_copies(df.withColumn("key", content_key(F.col("t"))), "id", F.col("key"))
    assert pairs(kept, "id") == [(1,), (2,), (3,), (4,), (6,), (8,)]
    assert [s for _, s in pairs(dedup.mark_content_copies(df.select("id", F.nullif(F.lower("t"), F.lit("")).alias("h")), "id", "h"), "id", "status")] == ["accepted"] * 6 + ["accepted", "accepted"]
    assert pairs(dedup.mark_content_copies(spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, None)], "id long, h string"), "id", "h"), "id", "status") == [
        (1, "accepted"), (2, "accepted"), (3, "DUPLICATE"), (4, "accepted"),
    ]
    assert pairs(dedup.not_known(df, df, "t"), "id") == [(3,), (4,)]


def test_layout_chunks(spark):
    blocks = [
        (1, 1, " Running head ", False), (2, 1, "first text", False), (3, 1, "", False), (4, 1, "2. Results", True), (5, 1, "Figure 3 shows it", False),
        (6, 2, "Running head", False), (7, 2, "curl http://x", False), (8, 3, "2. Results", True), (9, 3, "more", False), (10, 3, "Running head\n", False),
        (11, 4, "Methods", True), (12, 4, "how", False), (13, 4, "2. Results", True), (14, 4, "again", False), (15, 5, "Running head", False), (16, 5, "References", True), (17, 5, "hidden", False),
    ]
    df = spark.createDataFrame([(d, *b, None) for d in ("d", None) for b in blocks], "d string, o long, p long, t string, h boolean, m double").repartition(8)
    rows = sorted(tuple(r) for r in packing.layout_chunks(df, "d", "o", "p", "t", "h", "m").filter("d IS NOT NULL").select("id", "chapter", "section_title", "page_range", "text").collect())
    head = "[Document: d | Chapter: {} | Section: {} | Page: {}]\n\n{}"
    expected = [("Chapter 1", "Introduction", "1", "first text"), ("Chapter 2", "2. Results", "2-3", "```\ncurl http://x\n```\n\nmore"),
                ("Unknown Chapter", "Methods", "4", "how"), ("Chapter 2", "2. Results", "4", "again")]
    assert rows == [(f"chunk_{i:04d}", c, s, p, head.format(c, s, p, t)) for i, (c, s, p, t) in enumerate(expected, 1)]
    assert packing.layout_chunks(df, "d", "o", "p", "t", "h", "m").count() == 8


def test_learned_languages_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    profiles = languages.learn(docs.filter(~held_out), "text", "lang")
    got = languages.detect(docs.filter(held_out), "doc_id", "text", profiles)
    right = docs.filter("length(trim(text)) > 20 AND lang IS NOT NULL").join(got, "doc_id").filter("detected_lang != 'unknown'")
    total, hits = right.agg(F.count("*"), F.count_if(F.col("lang") == F.col("detected_lang"))).first()
    assert total > 200 and hits / total > 0.98
    assert got.count() == docs.filter(held_out).count()


def test_languages_of_odd_texts(spark):
    taught = spark.createDataFrame([("aaaa bbbb " * 9, "x"), ("cccc dddd " * 9, "y"), ("cccc dddd " * 9, "z"), ("\u4e2d\u6587" * 20, "zh"), (None, "x"), ("!!", "w"), ("eeee", None)], "text string, lang string")
    profiles = languages.learn(taught, "text", "lang")
    assert {r["lang"] for r in profiles.collect()} == {"x", "y", "z", "zh"}
    rows = [(1, "aaaa " * 9), (2, "cccc " * 9), (3, None), (4, ""), (5, "aaaa"), (6, "12 " * 30), (7, "\u4e2d\u6587" * 15), (8, "aaaa "), (8, "aaaa " * 4), (None, "bbbb " * 9), (9, "a" * 200_000)]
    texts = spark.createDataFrame(rows, "id long, text string").repartition(8)
    got = {r["id"]: r["detected_lang"] for r in languages.detect(texts, "id", "text", profiles).collect()}
    # y and z are as likely for 2; the chunks of 8 are judged together
    assert got == {1: "x", 2: "y", 3: "unknown", 4: "unknown", 5: "unknown", 6: "unknown", 7: "zh", 8: "x", None: "x", 9: "x"}
    none = languages.learn(taught.limit(0), "text", "lang")
    assert {r["detected_lang"] for r in languages.detect(texts, "id", "text", none).collect()} == {"unknown"}
    assert languages.detect(texts.limit(0), "id", "text", profiles).count() == 0
    kept = quality.decide_documents(texts, "id", "text", language="x", topic="aaaa", least=1, profiles=profiles)
    reasons = {r["id"]: (r["reason"], r["n_chunks"]) for r in kept.collect()}
    assert reasons[1] == (None, 1) and reasons[8] == (None, 2) and reasons[2][0] == "NON_ENGLISH" and reasons[None][0] == "OFF_TOPIC_LOW_MENTIONS"


def test_rows_without_document_or_order_are_filled(spark):
    df = spark.createDataFrame([("d", 1, "v"), ("d", 2, None), (None, 1, "n"), (None, 2, None), ("d", None, None)], "d string, o long, v string")
    got = packing.fill_forward(df, "d", "o", {"filled": F.col("v")}).collect()
    assert {(r["d"], r["o"]): r["filled"] for r in got} == {("d", 1): "v", ("d", 2): "v", (None, 1): "n", (None, 2): "n", ("d", None): None}


def test_repeated_heads_with_blanks_are_dropped(spark):
    df = spark.createDataFrame([("d", t) for t in ("Head", " Head ", "Head\n", "Head", "text")] + [(None, "Head")], "d string, t string")
    assert sorted(r["t"] for r in quality.drop_repeated(df, "d", "t").collect()) == ["Head", "text"]


def test_unseen_rows_do_not_depend_on_batches(spark):
    rows = [(1, "x", ""), (2, "y", ""), (3, "x", "k"), (4, "z", "k"), (5, "z", "m"), (6, None, "k"), (7, None, "m"), (8, "w", "m")]
    kept = []
    for size in (8, 3, 1):
        folder = scratch_path(spark, "landed")
        schema = spark.createDataFrame(rows[:1], "id long, a string, b string").schema
        for at in range(0, 8, size):
            spark.createDataFrame(rows[at : at + size], schema).coalesce(1).write.mode("append").parquet(folder)
            incremental.keep_unseen(incremental.landed(spark, folder, schema, "*.parquet"), f"{folder}-log", f"{folder}-at", "id", ["a", "b"])
        kept.append(pairs(incremental.read_log(spark, f"{folder}-log"), "id"))
    assert kept[0] == kept[1] == kept[2] == [(1,), (2,), (4,), (7,)]


@pytest.mark.parametrize("exclude, cell_rows, block", [(True, 5, 4096), (False, 9, 4), (True, 4096, 50)])
def test_nearest_equals_brute_force(spark, exclude, cell_rows, block):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(120, 6)).astype(np.float32)
    v[::3] = v[0]  # a third are copies
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<float>").repartition(6)
    d = np.round(((v[:, None].astype(float) - v[None].astype(float)) ** 2).sum(-1), 9)
    expected = []
    for i in range(len(v)):
        best = sorted((d[i, j], j) for j in range(len(v)) if not (exclude and i == j))[:5]
        expected += [(i, p + 1, j) for p, (_, j) in enumerate(best)]
    got = retrieval.nearest(df, df, "id", "v", 5, exclude_self=exclude, cell_rows=cell_rows, block=block, share=20)
    assert pairs(got, "query_id", "place", "neighbour_id") == sorted(expected)


def test_a_stored_index_answers_other_queries_and_prunes(spark):
    """Queries that are no rows of the index, an index that is read again, few pairs compared; no vectors, one vector."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 8)) * 20
    v = (centres[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 8))).astype(np.float32)
    asked = (centres[rng.integers(0, 40, 50)] + rng.normal(size=(50, 8))).astype(np.float32)
    schema = "id long, v array<float>, kind string"
    df = spark.createDataFrame([(i, x.tolist(), "a") for i, x in enumerate(v)] + [(5000, None, "a")], schema)
    path, seen = scratch_path(spark, "index"), scratch_path(spark, "seen")
    metric_index.build(df, "id", "v", path, ["kind"], cell_rows=25)
    index = metric_index.MetricIndex(spark, path)
    queries = spark.createDataFrame([(i, x.tolist(), "q") for i, x in enumerate(asked)], schema)
    got = metric_index.search(index, queries, "id", "v", 3, examined=seen)
    d = np.round(((asked[:, None].astype(float) - v[None].astype(float)) ** 2).sum(-1), 9)
    expected = [(i, p + 1, int(j)) for i in range(50) for p, j in enumerate(np.lexsort((np.arange(2000), d[i]))[:3])]
    assert pairs(got, "query_id", "place", "neighbour_id") == expected
    assert index.table("rows").count() == 2000 and index.table("cells").count() > 50
    assert spark.read.parquet(seen).agg(F.sum("n")).first()[0] < 0.2 * 50 * 2000
    for n in (0, 1):
        few = metric_index.build(df.limit(n), "id", "v", scratch_path(spark, "index"))
        assert metric_index.search(few, queries, "id", "v", 3).count() == 50 * n


def test_no_vector_is_moved_for_the_cells_of_others(spark):
    """Vectors without structure, where nearly every cell stays open: what is shuffled does not grow with vectors times cells."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(3000, 24)).astype(np.float32)
    v /= np.sqrt((v * v).sum(1))[:, None]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<float>").repartition(4)
    index = metric_index.build(df, "id", "v", scratch_path(spark, "index"), cell_rows=100)
    seen = scratch_path(spark, "seen")
    got = metric_index.search(index, df, "id", "v", 4, exclude_self=True, examined=seen, pass_values=24 * 1000)
    plan = got._jdf.queryExecution().toString()
    assert "visits" not in plan and "FlatMapCoGroups" not in plan
    assert spark.read.parquet(seen).agg(F.sum("n")).first()[0] > 0.5 * 3000 * 3000
    d = np.round(((v[:, None].astype(float) - v[None].astype(float)) ** 2).sum(-1), 9)
    np.fill_diagonal(d, np.inf)
    best = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert pairs(got, "query_id", "place", "neighbour_id") == [(i, p + 1, int(j)) for i in range(3000) for p, j in enumerate(best[i])]


def test_a_text_leaves_its_task_as_one_row_for_each_language(spark):
    """No row for a word or trigram; profiles in many blocks and trigrams found by search give the same result."""
    texts = spark.createDataFrame([(1, "Das ist ein Haus, und das Haus ist alt.", "de"), (2, "The house is old and the roof is new.", "en"), (3, "\U0001d4d0 the 12 &  Über-Haus!" * 3, None),
                                   (4, None, None), (None, "ein altes Haus ist das Haus", None), (5, "x" * 30 + " the house", "en")], "id long, text string, lang string")
    profiles = languages.learn(texts, "text", "lang")
    counts = {(r["lang"], r["gram"]) for r in profiles.collect()}
    assert {("de", " da"), ("de", "us "), ("en", "the"), ("en", "")} <= counts and ("en", "e h") not in counts and all(len(g) in (0, 3) for _, g in counts)
    got = languages.detect(texts, "id", "text", profiles)
    assert "Generate" not in got._jdf.queryExecution().toString()
    found = {r["id"]: r["detected_lang"] for r in got.collect()}
    assert found == {1: "de", 2: "en", 3: "de", 4: "unknown", None: "de", 5: "en"}
    assert {r["id"]: r["detected_lang"] for r in languages.detect(texts, "id", "text", profiles, block=20).collect()} == found
    points = np.frombuffer(" Haus the xyz ".encode("utf-32-le"), np.uint32)
    own = languages._Profile.of(profiles.toArrow(), ["de", "en"])
    table, languages.TABLE = languages.TABLE, 0
    try:
        searched = languages._Profile.of(profiles.toArrow(), ["de", "en"])
    finally:
        languages.TABLE = table
    grams = np.stack([points[:-2], points[1:-1], points[2:]])
    assert own.size and not searched.size and (own.rows(grams) == searched.rows(grams)).all()


def test_long_blocks_are_not_shuffled_to_find_repeated_ones(spark):
    rows = [(1, "head ")] * 4 + [(1, "x" * 500)] * 5 + [(2, " head"), (None, "foot"), (None, "foot"), (None, "foot"), (None, "foot"), (1, None), (None, None)]
    df = spark.createDataFrame(rows, "d long, t string")
    got = quality.drop_repeated(df, "d", "t")
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([(1, "x" * 500)] * 5 + [(2, " head"), (1, None), (None, None)], "d long, t string").collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    aggregate = plan[plan.index("Aggregate"):]
    assert "length" in aggregate and "Union" in plan


def test_normalised(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "id long, v array<float>")
    assert [r[0] for r in df.orderBy("id").select(metric_index.normalised("v")).collect()] == [[0.6, 0.8], [0.0, 0.0], None]


def test_gate(spark):
    df = spark.createDataFrame([(1, 0.05, "c"), (2, 0.0676, "c"), (3, 0.07, "c"), (4, None, "c")], "query_id long, top_distance double, context string")
    assert pairs(retrieval.gate(df), "query_id", "used_context", "context") == [(1, True, "c"), (2, True, "c"), (3, False, ""), (4, False, "")]


def test_flips_and_tests(spark):
    flips = [(True, True)] * 607 + [(False, False)] * 120 + [(True, False)] * 167 + [(False, True)] * 66
    rows = [(c, str(i), pair[k], 5 - k if i % 2 else 4) for i, pair in enumerate(flips) for k, c in enumerate(("none", "always"))]
    df = spark.createDataFrame(rows, "cond string, id string, is_correct boolean, coherence int")
    assert tuple(evaluation.flip_table(df, "none", "always").first()) == (960, 607, 120, 167, 66)
    test = evaluation.paired_tests(df, "none", "always", "coherence").first()
    assert test["mcnemar"] == pytest.approx((167 - 66 - 1) ** 2 / 233)
    assert test["mean_gap"] == 0.5


def test_key_suspect_needs_three_votes(spark):
    views = spark.createDataFrame(
        [(c, "q1", "B", False) for c in "xyz"] + [(c, "q2", "B", False) for c in "xy"] + [(c, "q3", p, p == "A") for c, p in zip("uvwxyz", "BBBAAA")],
        "cond string, id string, picked_letter string, is_correct boolean",
    )
    questions = spark.createDataFrame([("q1", "A"), ("q2", "A"), ("q3", "A")], "id string, correct string")
    assert pairs(evaluation.question_difficulty(views, questions), "id", "key_suspect") == [("q1", True), ("q2", False), ("q3", False)]


def test_patch_guards(spark):
    df = spark.createDataFrame([("a", "old text"), ("b", "x")], "id string, notes string")
    patch = lambda *rows: spark.createDataFrame(list(rows), "id string, new_notes string, o string, n string")
    done = records.patch(df, patch(("a", None, "old", "new")), "id", ["notes"], {"notes": ("o", "n")})
    assert pairs(done, "id", "notes") == [("a", "new text"), ("b", "x")]
    with pytest.raises(Exception, match="without a record: z"):
        records.patch(df, patch(("z", "n", None, None)), "id", ["notes"]).collect()
    with pytest.raises(Exception, match="fragment not found in notes: b"):
        records.patch(df, patch(("b", None, "old", "new")), "id", [], {"notes": ("o", "n")}).collect()


def test_cutoff_ties_and_imprecise_years(spark):
    rows = [(1, "2024-01-01", 2023, "2024-01-01"), (2, None, 2024, None), (3, "", 2023, "2024-05-05"), (4, "bad", 2020, None), (5, "2024-03-03", None, "2023-12-31")]
    df = spark.createDataFrame(rows, "id long, fpd string, year int, created string")
    sources = records.article_dates(F.col("fpd"), F.col("year")) + [("registry.preprint", F.to_date("created"))]
    got = pairs(records.earliest_public(df, sources), "id", "decision", "reason", "earliest_source")
    assert got == [
        (1, "INCLUDE", "POST_CUTOFF_CONFIRMED", "index.firstPublicationDate"), (2, "INCLUDE", "POST_CUTOFF_CONFIRMED", "index.pubYear(day-imprecise)"),
        (3, "EXCLUDE", "PRE_CUTOFF_EPUBLICATION", "index.pubYear(day-imprecise)"), (4, "AMBIGUOUS", "AMBIGUOUS_DATE", None),
        (5, "EXCLUDE", "PRE_CUTOFF_PREPRINT", "registry.preprint"),
    ]


def test_passages_equal_all_pairs_without_joining_common_words(spark):
    rng = random.Random(11)
    common, rare = [f"common{i}" for i in range(8)], [f"rare{i}" for i in range(400)]
    chunks = [(d, f"c{n}", n, " ".join(rng.sample(common, rng.choice([7, 8])) + rng.sample(rare, rng.randrange(2, 9)))) for d, many in (("hot", 300), ("b", 20), (None, 4)) for n in range(many)]
    chunks += [("b", "c20", 20, ""), ("b", "c21", 21, None), ("b", "c22", 22, "rare1")]
    asked = []
    for i in range(60):
        d, chunk, _, body = rng.choice(chunks[:320])
        words = body.split()
        asked.append((i, d, chunk if i % 7 == 0 else "none", " ".join(words[: 8 if i % 9 == 0 else None] if i % 2 else words + rng.sample(rare, 3))))
    asked += [(60, "b", "none", ""), (61, "b", "none", None), (62, "gone", "none", "common1"), (63, None, "c1", "common1"), (64, "b", "none", "unheard"), (65, "hot", "none", "common0 common1 common2")]
    questions = spark.createDataFrame(asked, "id long, doc string, source_chunk_id string, needle string")
    passages = spark.createDataFrame(chunks, "doc string, chunk_id string, order long, body string")

    expected = set()
    for i, d, source, needle in asked:
        near = [(c, n, set((body or "").split())) for dd, c, n, body in chunks if d is not None and dd == d]
        if any(c == source for c, _, _ in near):
            expected.add((i, source, 1, True))
            continue
        own = set((needle or "").split())
        best = sorted((-round(len(own & words) / len(words) ** 0.5, 9), n, c) for c, n, words in near if words)[:3]
        expected |= {(i, c, place, False) for place, (_, _, c) in enumerate(best, 1)}
    found = lookups.find_passages(questions, passages, "doc")
    assert {(r.id, r.chunk_id, r.place, r.exact) for r in found.collect()} == expected

    words = lambda c: F.array_distinct(F.split(c, " "))
    worded = passages.filter("doc = 'hot'").select("doc", "chunk_id", "order", words("body").alias("_c")).withColumn("_size", F.size("_c"))
    hot = questions.filter("doc = 'hot' AND id % 2 = 0 AND id < 60").select("id", "doc", words("needle").alias("_q"))
    # every pair shares common words
    assert lookups.passage_candidates(hot, worded, "doc", 3).count() < 0.5 * hot.count() * worded.count()


def test_few_questions_of_a_document_join_no_words(spark, monkeypatch):
    """Passages of a document with few questions move whole, not word by word; both ways give the same rows."""
    rng = random.Random(12)
    words = [f"rare{i}" for i in range(40)]
    chunks = [(d, f"c{n}", n, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for d in range(12) for n in range(15)] + [(0, "c15", 15, None), (1, "c15", 15, "")]
    asked = [(i, i % 12, "c3" if i == 5 else "none", " ".join(rng.choices(words, k=6)) if i != 7 else None) for i in range(24)]
    questions = spark.createDataFrame(asked + asked[:1], "id long, doc long, source_chunk_id string, needle string")
    passages = spark.createDataFrame(chunks + chunks[:2], "doc long, chunk_id string, order long, body string")
    rows = lambda few: sorted(map(tuple, lookups.find_passages(questions, passages, "doc", few=few).collect()))
    by_words = rows(0)
    assert len(by_words) == 23 * 3 + 1 and rows(1) == rows(2) == by_words

    def no_words(*args):
        raise AssertionError("words were joined")

    monkeypatch.setattr(lookups, "passage_candidates", no_words)
    found = lookups.find_passages(questions, passages, "doc")
    assert sorted(map(tuple, found.collect())) == by_words


def test_notes_are_whole_without_a_limit(spark):
    reviews = spark.createDataFrame([("q", "ann", fixed.REVIEW_VERDICTS[0], "n" * 5000, "t")], "qid string, reviewer string, verdict string, notes string, ts string")
    questions = spark.createDataFrame([("q",)], "qid string")
    for limit, length in [({}, 2000), ({"note_chars": 7}, 7), ({"note_chars": None}, 5000)]:
        assert len(evaluation.valid_reviews(reviews, questions, **limit).first().notes) == length
        assert landed.nested_reviews(reviews, **limit).first().reviews.count("n" * length) == 1
        assert "n" * (length + 1) not in landed.nested_reviews(reviews, **limit).first().reviews
