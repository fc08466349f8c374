"""Readers on hand-made files, and restarts of the incremental jobs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from siftbook.sources import articles as A
from siftbook.sources import files as S
from siftbook.sources import landed as L
from siftbook.sources.concatenated import read_concatenated, record_texts
from siftbook.streaming import incremental as K

JATS = """<article><front><title-group><article-title>A <i>small</i> study</article-title></title-group>
<pub-date pub-type="collection"><year>2021</year></pub-date><pub-date pub-type="ppub"><year>2022</year></pub-date>
<abstract><p>ABSTRACTWe  look.</p></abstract></front><body><p>Loose start.</p>
<sec><title>Methods</title><p>One.</p><sec><title>Strains</title><p>Two.</p>
<table-wrap><label>Table 1</label><caption><p>Sizes</p></caption><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td> 2 </td></tr></table></table-wrap></sec></sec>
<sec><title>References</title><p>Hidden.</p></sec></body></article>"""
ELSEVIER = """<full xmlns:ce="http://www.elsevier.com/xml/common/dtd" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Short note</dc:title>
<dc:description>Same words.</dc:description><ce:simple-para>Same words.</ce:simple-para><ce:simple-para>Other words.</ce:simple-para></full>"""


@pytest.fixture()
def xml_folder(tmp_path):
    for name, text in {"PMC_1.xml": JATS, "set.xml": f"<pmc-articleset>{JATS}</pmc-articleset>", "123.xml": ELSEVIER, "bad.xml": "<article><p>"}.items():
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_articles(spark, xml_folder):
    parts = A.article_parts(A.read_articles(spark, xml_folder))
    report = {r["stem"]: (r["format"], r["error"] is not None) for r in A.parse_report(parts).collect()}
    assert report == {"PMC_1": ("jats", False), "set": ("jats", False), "123": ("elsevier", False), "bad": (None, True)}
    heads = {r["stem"]: r for r in A.article_head(parts).collect()}
    assert heads["PMC_1"]["document_name"] == "A small study" and heads["PMC_1"]["pub_year"] == "2022"
    chunks = A.article_chunks(parts).orderBy("stem", F.regexp_extract("id", r"(\d+)$", 1)).collect()
    mine = [(c["id"], c["chapter"], c["section_title"], c["text"].split("\n\n", 1)[1]) for c in chunks if c["stem"] == "PMC_1"]
    assert mine == [
        ("pmc_pmc_1_chunk_0001", "Abstract", "Abstract", "ABSTRACTWe look."), ("pmc_pmc_1_chunk_0002", "Body", "Body", "Loose start."),
        ("pmc_pmc_1_chunk_0003", "Methods", "Methods", "One."), ("pmc_pmc_1_chunk_0004", "Methods", "Strains", "Two."),
        ("pmc_pmc_1_tbl_0005", "Methods", "Strains", "[TABLE]\nTable 1 | Sizes\na\tb\n1\t2"),
    ]
    other = [(c["id"], c["section_title"], c["text"].split("\n\n", 1)[1], c["pub_year"]) for c in chunks if c["stem"] == "123"]
    assert other == [("xml_123_chunk_0001", "Abstract", "Same words.", None), ("xml_123_chunk_0002", "Body", "Other words.", None)]
    sections = {(r["title"], r["text"], r["abstract"]) for r in A.section_texts(parts).filter("stem = 'set'").collect()}
    assert sections == {(t, x, "We  look.") for t, x in (("Methods", "One."), ("Strains", "Two."), ("References", "Hidden."))}


def test_json_readers(spark, tmp_path):
    (tmp_path / "lines.jsonl").write_text('{"id": 1}\n\n{"id": 2\n{"id": 3}\n')
    rows = S.read_jsonl_tolerant(spark, str(tmp_path / "lines.jsonl"), "id long").collect()
    assert [r["id"] for r in rows if r[S.CORRUPT] is None] == [1, 3] and sum(r[S.CORRUPT] is not None for r in rows) == 1
    (tmp_path / "joined.json").write_text(json.dumps({"id": 1}, indent=1) + json.dumps({"id": 2}) + "\n \n" + json.dumps({"id": 3}, indent=2))
    assert sorted(r[0] for r in read_concatenated(spark, str(tmp_path / "joined.json"), "id long").collect()) == [1, 2, 3]
    (tmp_path / "seeds.json").write_text(json.dumps([{"id": 1}, {"id": 2}], indent=1))
    assert S.read_json_array(spark, str(tmp_path / "seeds.json"), "id long").count() == 2


@pytest.mark.parametrize("split", [64, 1 << 27])
def test_concatenated_json_in_splits(spark, tmp_path, split):
    """Brackets and quotes inside strings, nested objects, several records on a line and records over many lines."""
    rng = random.Random(1)
    records = [{"id": i, "text": rng.choice(['{ "x" }', "}{", "a\nb \\\\ \"", "plain [", ""]), "more": {"deep": [{"v": i}, {"v": None}]}} for i in range(60)]
    texts = [json.dumps(r, indent=rng.choice([None, 1, 4])) for r in records]
    (tmp_path / "a.json").write_text("".join(t + rng.choice(["", " ", "\n", "\n\n  "]) for t in texts[:40]))
    (tmp_path / "b.json").write_text("\n".join(texts[40:]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        rows = read_concatenated(spark, str(tmp_path), "id long, text string, more struct<deep:array<struct<v:long>>>").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["id"]: (r["text"], [d["v"] for d in r["more"]["deep"]]) for r in rows} == {r["id"]: (r["text"], [r["id"], None]) for r in records}
    assert len(rows) == 60


@pytest.mark.parametrize("split", [1 << 30, 1000, 97])
def test_concatenated_json_of_any_shape(spark, tmp_path, split):
    """Random records in one line or many, escapes and braces in strings, cut by splits anywhere; the order of a file is kept."""
    rng = random.Random(split)
    marks = ["}", "{", '"', "\\", "\n", "a", "é", "}{", '\\"', "[", " ", "}}", '{"id": 1}']
    records = [{"id": i, "text": "".join(rng.choice(marks) for _ in range(rng.randint(0, 40)))} for i in range(120)]
    for name, part in (("a", records[:70]), ("b", records[70:119]), ("c", records[119:])):
        (tmp_path / f"{name}.json").write_text("".join(json.dumps(r, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5) + rng.choice(["", "\n", "  \n\n"]) for r in part))
    (tmp_path / "d.json").write_text("")
    (tmp_path / "e.json").write_text(" \n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        rows = read_concatenated(spark, str(tmp_path), "id long, text string").collect()
        order = record_texts(spark, str(tmp_path)).filter("file LIKE '%a.json'").orderBy("record").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["id"], r["text"]) for r in rows) == [(r["id"], r["text"]) for r in records]
    assert [json.loads(r["record_text"])["id"] for r in order] == list(range(70)) and [r["record"] for r in order] == list(range(70))


def test_long_strings_in_concatenated_json(spark, tmp_path):
    """Strings of thousands and of ten million characters, and one of nothing but escapes."""
    texts = ["x" * 3000, ("y" * 996 + "} {\"") * 10_000, '\\"' * 5000, ""]
    (tmp_path / "long.json").write_text("\n".join(json.dumps({"id": i, "text": t}, indent=2) for i, t in enumerate(texts)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        rows = read_concatenated(spark, str(tmp_path), "id long, text string").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["id"]: r["text"] for r in rows} == dict(enumerate(texts))


def test_a_file_that_breaks_off(spark, tmp_path):
    (tmp_path / "broken.json").write_text('{"id": 1}\n{"id": 2, "text": "no end')
    rows = record_texts(spark, str(tmp_path)).orderBy("record").collect()
    assert [r["record_text"].strip() for r in rows] == ['{"id": 1}', '{"id": 2, "text": "no end']


def test_titles_of_references_are_no_titles(spark):
    cited = "<article><front><abstract>Short.</abstract></front><back><ref-list><ref><article-title>Cited paper</article-title></ref></ref-list></back></article>"
    other = '<full xmlns:ce="c" xmlns:dc="http://purl.org/dc/elements/1.1/"><ce:title>Cited</ce:title></full>'
    heads = A.article_head(A.article_parts(spark.createDataFrame([("one", cited), ("two", other)], "stem string, xml string")))
    assert {r["stem"]: r["document_name"] for r in heads.collect()} == {"one": "one", "two": "two"}


def test_batch_responses(spark):
    def line(cid, content=None, error=None):
        body = {"choices": [{"message": {"content": content}}]} if content is not None else None
        return (json.dumps({"custom_id": cid, "error": error, "response": {"body": body} if body else None}),)
    lines = [line("a", '{"predicted": " b", "coherence": 4}'), line("b", "{oops"), line("c", error="limit"), ("",), line("d", '{"predicted": null}')]
    read = L.batch_scores(spark.createDataFrame(lines, "value string"))
    assert {r["custom_id"]: r["problem"] for r in read.collect()} == {"a": None, "b": "malformed", "c": "error", "d": None}
    requests = spark.createDataFrame([("a", "B"), ("b", "B"), ("d", "B")], "id string, correct_presented string")
    got = {r["id"]: (r["predicted"], r["is_correct"], r["penalised"], r["coherence"]) for r in L.scored_responses(read, requests).collect()}
    assert got == {"a": ("B", True, 1.0, 4), "d": (None, False, 0.0, None)}


def test_incremental_runs_read_only_new_files(spark, tmp_path):
    landed, out, check, log = (str(tmp_path / x) for x in ("landed", "out", "check", "log"))
    schema = "id long, key string, status string"
    def land(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{landed}/{name}")
    stream = lambda: K.landed(spark, landed + "/*", spark.createDataFrame([], schema).schema, "*.parquet")
    land("one", [(1, "a", "open"), (2, "b", "open"), (3, "a", "done")])
    for _ in range(2):
        K.process_new(stream(), out, check)
        K.keep_unseen(stream(), log, check + "2", "id", ["key"])
        K.append_log(stream(), log + "3", check + "3")
        K.running_counts(stream(), "status", out + "4", check + "4")
    assert spark.read.parquet(out).count() == 3
    land("two", [(4, "b", "done"), (5, "c", "open")])
    K.process_new(stream(), out, check)
    K.keep_unseen(stream(), log, check + "2", "id", ["key"])
    K.append_log(stream(), log + "3", check + "3")
    K.running_counts(stream(), "status", out + "4", check + "4")
    assert sorted(r[0] for r in spark.read.parquet(out).select("id").collect()) == [1, 2, 3, 4, 5]
    assert sorted(r["id"] for r in K.read_log(spark, log).collect()) == [1, 2, 5]
    assert {r["status"]: r["n"] for r in K.latest_counts(spark, out + "4").collect()} == {"open": 3, "done": 2}
    log3 = K.read_log(spark, log + "3")
    state = K.upserted(spark, log + "3", "key", "id", ["id"], ["status"])
    assert log3.count() == 5 and {(r["key"], r["id"], r["status"]) for r in state.collect()} == {("a", 1, "done"), ("b", 2, "done"), ("c", 5, "open")}


def test_a_stream_stops_at_its_target(spark, tmp_path):
    """Files behind the one that reaches the target stay unread, a second run reads nothing, totals are kept for each batch."""
    schema = "id long, status string"
    for part in range(6):
        rows = [(10 * part + i, "ok" if i % 2 else "bad") for i in range(10)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/part-{part}"))
    places = [str(tmp_path / name) for name in ("log", "counts", "state")]
    stream = lambda: K.landed(spark, str(tmp_path / "in/*"), spark.createDataFrame([], schema).schema, "*.parquet", files_per_batch=1)
    for _ in range(2):
        assert K.collect_until(stream(), "status", "ok", 12, *places)
        assert K.read_log(spark, places[0]).count() == 30
    assert [r[0] for r in K.first_accepted(K.read_log(spark, places[0]), "status", "ok", "id", 12).collect()] == list(range(1, 24, 2))
    assert {tuple(r) for r in K.latest_counts(spark, places[1]).collect()} == {("ok", 15), ("bad", 15)}
    # a target that was out of reach is reached by the files that are left
    assert K.collect_until(stream(), "status", "ok", 30, *places) and K.read_log(spark, places[0]).count() == 60
    assert not K.collect_until(stream(), "status", "ok", 31, *places)
    K.running_counts(stream(), "status", str(tmp_path / "all"), str(tmp_path / "all-state"))
    assert {tuple(r) for r in K.latest_counts(spark, str(tmp_path / "all")).collect()} == {("ok", 30), ("bad", 30)}
