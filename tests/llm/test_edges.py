"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import gc
import gzip
import weakref
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftbook.llm import classifier, decontamination, language, licenses, near_dedup, packing, pages, quality, queries, sharding, warc
from siftbook.operators.graph import components
from siftbook.session import scratch_path

PLAIN = " ".join(f"word{i} of a plain text" for i in range(30)) + "\nWith the MIT License, and more."
LONG = " ".join(f"long{i}" for i in range(150_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_words string, kept string, score string, shard string, _row string, node string, host string"
ROWS = [
    (1, PLAIN), (2, PLAIN.upper()), (3, PLAIN), (3, PLAIN), (4, None), (5, ""), (6, " \t\n\r "), (7, LONG), (8, LONG + " end"), (None, PLAIN), (None, None),
    (9, "!!! ??? ..."), (10, "ein kurzer Text"), (11, "\x1c x\x00y \x85 é \U0001f600 Σας"), (12, "the the the the"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None if k % 4 == 0 else ("en", "de")[k % 2], None if k % 5 == 0 else "a", *["x"] * 7) for k, (i, t) in enumerate(ROWS)], SCHEMA)


def some(df):
    """All rows, by (id as text, words of the text)."""
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_language(spark, docs):
    found = language.identify(docs, language.learn(docs), keep=["doc_id", "text", "score", "kept"])
    rows = {r.text: r for r in found.collect()}
    assert found.count() == len(ROWS) and found.columns == ["doc_id", "text", "kept", "lang_pred", "score"]
    for text in (None, "", " \t\n\r ", "!!! ??? ..."):
        assert (rows[text].lang_pred, rows[text].score) == ("und", 0.0)
    assert rows[LONG].lang_pred in ("en", "de") and 0 < rows[LONG].score <= 1
    assert {r.lang_pred for r in language.identify(docs, {}).collect()} == {"und"}
    assert language.learn(docs.filter("false")) == {} and language.identify(docs.filter("false"), {}).count() == 0


def test_bundles_do_not_depend_on_chunks(monkeypatch):
    profiles = language.Profiles(64)
    whole, _ = profiles.bundles([PLAIN, "a", "ab  cd", "Ünïcode — «text» 漢字"])
    monkeypatch.setattr(language, "CHUNK", 3)
    assert (profiles.bundles([PLAIN, "a", "ab  cd", "Ünïcode — «text» 漢字"])[0] == whole).all()


def test_profiles_go_with_their_task():
    """Nothing outside keeps a task's vectors, or a worker would hold those of all tasks before."""
    profiles = language.Profiles(64)
    profiles.bundles([PLAIN])
    gone = weakref.ref(profiles)
    del profiles
    gc.collect()
    assert gone() is None


def test_forgotten_vectors_are_drawn_again(monkeypatch):
    texts = [PLAIN, "Ünïcode — «text» 漢字", PLAIN[::-1]]
    whole, _ = language.Profiles(64).bundles(texts)
    for name, value in (("LIMIT", 40), ("LETTERS", 3), ("BLOCK", 7)):
        monkeypatch.setattr(language.Profiles, name, value)
    few = language.Profiles(64)
    assert (few.bundles(texts, block=1)[0] == whole).all() and len(few.known) <= 40 and len(few.drawn) <= 3


def test_quality(spark, docs):
    rows = quality.judged(docs, keep=["doc_id", "text", "kept", "n_words"]).collect()
    assert len(rows) == len(ROWS)
    by = {r.text: r for r in rows}
    assert by[None].n_words == 0 and by[None].base_failed and not by[None].kept
    assert by[""].n_words == by[" \t\n\r "].n_words == 0 and by["the the the the"].n_repeat_words == 4
    assert by[LONG].n_words == 150_000 and by[LONG].kept and by[LONG].n_repeat_words == 0
    assert quality.judged(docs.filter("false")).count() == 0


def test_host_rates_are_shrunk(spark):
    rows = [("a", 10, 5)] * 1 + [("b", 1000, 500), ("c", 1000, 0), ("d", 1, 1)]
    measured = spark.createDataFrame([(h, 0 if k < bad else 60, 0, 300, 0, 1, 0, 0) for h, n, bad in rows for k in range(n)], "host string, n_words long, n_symbols long, word_chars long, n_capitals long, n_lines long, n_dup_lines long, n_repeat_words long")
    rates = {r.host: r.rate for r in quality.host_rates(measured, "host").collect()}
    assert 0.49 < rates["b"] < 0.51 and rates["c"] < 0.01 and rates["d"] < 1 and rates["a"] < rates["d"]


def test_near_copies(spark, docs):
    rows = near_dedup.classes(docs).collect()
    assert len(rows) == len(ROWS)
    plain = [r for r in rows if r.n_shingles and r.doc_id in (1, 2, 3, None)]
    assert {r.component_id for r in plain} == {1} and [r.doc_id for r in plain if r.kept] == [1]
    assert {(r.component_id, r.kept) for r in rows if r.doc_id in (7, 8)} == {(7, True), (7, False)}
    assert all(r.component_id == r.doc_id and r.kept for r in rows if not r.n_shingles)
    assert near_dedup.classes(docs.filter("false")).count() == 0
    assert [(r.component_id, r.kept) for r in near_dedup.classes(docs.filter("doc_id IS NULL AND text IS NOT NULL")).collect()] == [(None, True)]


def test_near_copies_in_a_crowd(spark, monkeypatch):
    """Regions wider than the window, chains and near misses, against all pairs."""
    monkeypatch.setattr(near_dedup, "WINDOW", 16)
    import numpy as np

    draw = np.random.default_rng(3)
    base = [f"w{i}" for i in draw.integers(0, 10_000, 120)]
    texts = []
    for _ in range(90):
        words = list(base)
        for at in draw.integers(0, len(words), int(draw.integers(0, 6))):
            words[at] = f"x{draw.integers(0, 10_000)}"
        texts.append(" ".join(words))
    sets = [set(near_dedup.shingles(t.encode().split(), near_dedup.Hashes()).tolist()) for t in texts]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                low, high = sorted((parent[i], parent[j]))
                parent = [low if p == high else p for p in parent]
    rows = near_dedup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == dict(enumerate(parent))


def test_a_pair_in_a_crowd_of_near_misses(spark, monkeypatch):
    """Many documents that share a passage, none similar enough, and planted pairs that are: all are found, beyond any window."""
    monkeypatch.setattr(near_dedup, "WINDOW", 4)
    monkeypatch.setattr(near_dedup, "TILE", 32, raising=False)
    shared = " ".join(f"s{i}" for i in range(100))
    own = [" ".join(f"d{k}x{i}" for i in range(18)) for k in range(240)]
    texts = [f"{shared} {o}" for o in own] + [f"{shared} {' '.join(own[k].split()[:3])} {' '.join(f'p{k}x{i}' for i in range(15))}" for k in range(0, 240, 4)]
    rows = near_dedup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == {i: i if i < 240 else 4 * (i - 240) for i in range(300)}


def test_a_near_miss_does_not_hide_a_link():
    """A row's first partner of a class is one shingle short, the next of that class is similar enough."""
    import numpy as np

    sets = np.empty(3, object)
    sets[:] = [np.arange(k, k + 20, dtype=np.uint64) for k in (0, 3, 2)]
    sizes, group = np.array([20, 20, 20]), np.array([0, 7, 7])
    pairs = np.array([[0, 0], [1, 2], [100, 100]])
    assert near_dedup._linked(pairs, group, sizes, sets, 75)[:2].T.tolist() == [[0, 2]]


def test_components(spark):
    chain = [(i, i + 1) for i in range(300)]
    edges = spark.createDataFrame([*chain, (1000, 1001), (1001, 1000), (5, 5), (7, None)], "a long, b long")
    found = {r.node: r.component for r in components(edges).collect()}
    assert found == dict.fromkeys(range(301), 0) | {1000: 1000, 1001: 1000}
    assert components(edges.filter("false")).count() == 0


def test_licenses(spark, docs):
    rows = licenses.scan(docs, keep=["doc_id", "text", "score"]).collect()
    by = {r.text: r for r in rows}
    assert len(rows) == len(ROWS) and by[PLAIN].base_labels == by[PLAIN].labels == "mit" and by[PLAIN].n_base == 1 and by[PLAIN].first_word == 152
    assert (by[None].n_words, by[None].first_word, by[None].labels, by[None].score) == (0, None, "", 0.0)
    text = "general public license: MIT license MIT-License! the GNU General Public License, version 3. Licensed under CC BY-NC 4.0"
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_base, row.first_word, row.last_word, row.base_labels, row.labels) == (4, 0, 9, "gpl,mit", "cc-by-nc-4.0,gpl,gpl-3.0,mit")
    assert licenses.scan(docs.filter("false")).count() == 0


def test_packing(spark, docs):
    from tests.llm.test_queries import check_packed

    pieces = packing.token_pieces(docs, queries.vocabulary())
    rows = packing.pack(pieces, task_rows=4).toPandas()
    assert len(rows) == pieces.count()
    one = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    check_packed(packing.pack(packing.token_pieces(one, queries.vocabulary())).toPandas(), one.toPandas())
    assert packing.pack(packing.token_pieces(docs.filter("false"), queries.vocabulary())).count() == 0
    full = spark.createDataFrame([(i, 0, 0, 3000, 0) for i in range(50)], packing.PIECE)
    assert packing.pack(full, task_rows=5).select("sequence_id").distinct().count() == 50
    ids = packing.token_pieces(docs.filter("doc_id = 10"), queries.vocabulary(), with_ids=True).first()
    assert len(ids.ids) == ids.length and ids.ids[-1] == 1


def test_shards(spark, docs):
    rows = sharding.shards(docs).toPandas()
    assert len(rows) == len(ROWS) and rows.groupby("shard").size().between(1, 2).all()
    text = F.when(F.col("id") < 300, "same").when(F.col("id") < 500, F.concat(F.lit("t"), F.expr("id div 2"))).otherwise(F.concat(F.lit("u"), F.col("id")))
    hot = spark.range(900).select(F.col("id").alias("doc_id"), text.alias("text"))
    placed = sharding.shards(hot).toPandas().merge(hot.toPandas(), on="doc_id")
    counts = placed.groupby("shard").size()
    assert counts.max() - counts.min() == 1 and counts.sum() == 900
    spread = placed.groupby("text").shard.nunique()
    assert spread["same"] <= 5 and (spread.drop("same") == 1).mean() > 0.99
    assert sharding.shards(docs.filter("false")).count() == 0 and sharding.shards(docs.limit(1)).count() == 1


@pytest.mark.parametrize(("hot", "groups", "copies", "loose"), [(1000, 300, 2, 1400), (0, 60, 50, 200), (900, 20, 70, 700)])
def test_no_text_that_fits_a_shard_is_split(spark, hot, groups, copies, loose):
    texts = ["hot"] * hot + [f"group {g}" for g in range(groups) for _ in range(copies)] + [f"alone {n}" for n in range(loose)]
    docs = spark.createDataFrame([(i * 7 + 3, text) for i, text in enumerate(texts)], "doc_id long, text string")
    placed = sharding.shards(docs).toPandas().merge(docs.toPandas(), on="doc_id")
    sizes = placed.groupby("shard").size()
    assert len(placed) == len(texts) and sizes.max() - sizes.min() <= 1
    assert all(sorted(part.slot) == list(range(len(part))) for _, part in placed.groupby("shard"))
    spread = placed.groupby("text").shard.nunique()
    assert (spread.drop("hot", errors="ignore") > 1).sum() == 0
    assert not hot or spread["hot"] <= hot // (len(texts) // 8) + 2


def test_classifier(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (10, 0), (12, 0), (12, 1), (None, 1), (5, None)], "doc_id long, quality int")
    net = classifier.learn(docs, labels, "quality")
    rows = classifier.scored(docs, net, keep=["doc_id", "text", "score"]).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert classifier.scored(docs.filter("false"), net).count() == 0
    assert {r.score for r in classifier.scored(docs, classifier.learn(docs.filter("false"), labels, "quality")).collect()} == {0.5}


def test_scores_do_not_depend_on_slices(monkeypatch):
    net = classifier.fit([PLAIN.encode(), b"$$$ %%% ###" * 30, b""], [1, 0, 0], epochs=3)
    texts = [LONG.encode()[:70_000], b"", b"abc", PLAIN.encode()]
    whole = classifier.scores(net, texts)
    monkeypatch.setattr(classifier, "SLICE", 2048)
    assert abs(classifier.scores(net, texts) - whole).max() < 1e-5


PAGES = [
    (1, "http://A.example/1", "<html><nav>m</nav><article><header><h1>T</h1><p>by me</p></header><p>One &amp; two<p>three<script>var t='</p>'</script></article>"),
    (2, "http://a.example/2", None), (3, None, ""), (3, None, ""), (4, "no url", "plain &lt;text&gt;\n of   one block"), (None, "http://b.example", "<div><p>x<div class='comments'><p>no</p></div>"),
    (5, "http://b.example/x y\r\n", "<div><a href=x>menu item</a></div><div>Some text<br>goes <b>on</b></div><form>f</form><!-- c -->"),
]


@pytest.fixture(scope="module")
def some_pages(spark):
    return spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, text string, host string")


def test_main_texts(spark, some_pages):
    rows = {(r.page_id, r.url): r.text for r in pages.extracted(some_pages).collect()}
    assert pages.extracted(some_pages).count() == len(PAGES)
    assert [rows[p[:2]] for p in PAGES] == ["T\nOne & two\nthree", "", "", "", "plain <text> of one block", "x", "Some text goes on"]
    assert pages.extracted(some_pages.filter("false")).count() == 0


def test_constant_blocks_of_a_host_are_template(spark):
    made = [(i, f"http://h.example/{i}", f"<body><div><p>Always here.</p></div><div><h2>Head {i}</h2><p>Own text {i}.</p></div><div><p>Read more soon.</p></div></body>") for i in range(20)]
    rows = pages.extracted(spark.createDataFrame(made, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in rows} == {i: f"Head {i}\nOwn text {i}." for i in range(20)}
    copies = [(i, "http://h.example/", "<body><div><p>Copy.</p></div></body>") for i in range(20)]
    assert {r.text for r in pages.extracted(spark.createDataFrame(copies, "page_id long, url string, html string")).collect()} == {"Copy."}


def test_blank_pages_are_no_seed(spark):
    made = [(i, f"http://h{i % 8}.example/{i}", f"<body><div><p>Always here.</p></div><div><h2>Head {i}</h2><p>Own text {i}.</p></div></body>") for i in range(48)]
    blank = [(100 + i, f"http://h{i % 8}.example/", (None, "", " \t")[i % 3]) for i in range(24)]
    rows = pages.extracted(spark.createDataFrame(made + blank, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in rows} == {i: f"Head {i}\nOwn text {i}." for i in range(48)} | {100 + i: "" for i in range(24)}


def test_constant_lines_beside_paragraphs_are_template(spark):
    made = [(i, f"http://h.example/{i}", f"<body><div><p>Own {i}.</p><p>More of {i}.</p><p>Licensed to all.</p></div></body>") for i in range(20)]
    made.append((20, "http://h.example/20", "<body><div><p>Page lost.</p></div></body>"))
    rows = pages.extracted(spark.createDataFrame(made, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in rows} == {i: f"Own {i}.\nMore of {i}." for i in range(20)} | {20: "Page lost."}


def test_names_do_not_hide_the_article():
    """Names that only contain a telling word, words in other attributes, and marked blocks that hold the article."""
    for page in (
        '<div class="content with-sidebar"><article><p>Own.</p></article></div>', '<div class="sidebar"><main><p>Own.</p></main></div>', '<article><div class="article-header"><h1>Own.</h1></div></article>',
        '<article><div style="overflow:hidden"><p>Own.</p></div></article>', '<article><p aria-hidden="false">Own.</p></article>', '<article><p data-class="menu">Own.</p></article>',
        '<article><p>Own.</p><div hidden>no</div><div class="share">no</div></article><div class="a sidebar"><p>no</p></div>',
    ):
        assert [b[2] for b in pages.blocks(page, "[]")] == ["Own."], page


def test_deep_and_broken_pages():
    for tag in ("div", "b", "p", "font", "li"):
        text = f"<article>{f'<{tag}>' * 5000}deep <i>text</i>{f'</{tag}>' * 5000}<p>after</article><footer>no</footer>"
        assert [b[2] for b in pages.blocks(text, "[]")] in (["deep text\nafter"], ["deep text", "after"])
    for text in ("<", "<p", '<a href="x>y', "</p></p>", "<!-- ", "<script>", "&#xFFFFFF; &amp", "<p>\ud800"):
        assert isinstance(pages.blocks(text, "[]"), list)


def test_archives(spark, some_pages):
    folder = scratch_path(spark, "warc")
    files = warc.write_monolithic(warc.marked(some_pages), folder)
    index = warc.normalise(files)
    rows = warc.read_records(index).collect()
    assert len(rows) == len(PAGES)
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in rows) == sorted(
        [(0, "response", None), (1, "response", None), (2, "revisit", 3), (3, "response", None), (3, "response", None), (4, "response", None), (5, "response", None)]
    )
    assert {bytes(r.payload).decode() for r in rows if r.payload is not None} == {p[2] or "" for p in PAGES}
    for path in {r.path for r in index.collect()}:
        system, name = warc.opened(path)
        with system.open_input_stream(name, compression=None) as f:
            data = f.read()
        own = sorted((r.offset, r.length) for r in index.collect() if r.path == path)
        assert [o for o, _ in own] == [0, *(o + n for o, n in own[:-1])] and sum(own[-1]) == len(data)
        assert gzip.decompress(data) == b"".join(zlib.decompress(data[o : o + n], 31) for o, n in own)
    assert warc.read_records(warc.normalise(warc.write_monolithic(warc.marked(some_pages.filter("false")), folder))).count() == 0
    assert {r.record_type for r in warc.marked(some_pages, 1).select(F.when(F.col("refers_to").isNull(), "response").alias("record_type")).collect()} == {"response"}


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_members_of_an_archive(monkeypatch, block):
    """Many members in one block, zeros between them, records over several members, a file that breaks off."""
    import io

    monkeypatch.setattr(warc, "BLOCK", block)
    records = [warc.page_record(i, "u", b"x" * i, None) for i in range(10)]
    data = b"".join(records)
    parts = [data[at : at + 100] for at in range(0, len(data), 100)]
    for packed in (b"".join(map(gzip.compress, records)), b"\0\0".join(map(gzip.compress, parts)) + b"\0", gzip.compress(data) + gzip.compress(b"")):
        stream, seen = warc.Inflated(io.BytesIO(packed)), []
        while (head := stream.header()) is not None:
            size = int(warc.fields_of(head)["content-length"])
            seen.append(head + b"".join(stream.pieces(size + 4)))
        assert seen == records
    broken = warc.Inflated(io.BytesIO(gzip.compress(data)[:-20]))
    with pytest.raises(ValueError, match="ends inside"):
        while (head := broken.header()) is not None:
            list(broken.pieces(int(warc.fields_of(head)["content-length"]) + 4))


def test_ids_of_every_letter_before_a_mark():
    from tokenizers import Tokenizer

    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha() and not 0x3400 <= c < 0xD7A4 and c < 0x20000]
    texts = [f"a{c}. {c}, a{c}b" for c in letters]
    ids = packing.WordIds(queries.vocabulary())
    got = [bytes(x) for at in range(0, len(texts), 1000) for x in ids(texts[at : at + 1000])]
    expected = [packing.WordIds._packed(e) for e in Tokenizer.from_file(queries.vocabulary()).encode_batch(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, got, expected, strict=True) if a != b] == []


@pytest.mark.parametrize("window", [1, 2, 3, 7, 12, 13, 20, 40])
def test_windows_of_any_length(window):
    """Hit words and items against a search of every window."""
    import random

    rng = random.Random(window)
    for _ in range(12):
        words = lambda n: [b"w%d" % rng.randrange(3) for _ in range(n)]
        texts = [words(rng.randrange(0, 150)) for _ in range(6)]
        items = [(str(i), rng.choice(texts)[:70][rng.randrange(0, 9):] + words(rng.randrange(0, 3))) for i in range(5)]
        tests = decontamination.Tests([(n, b" ".join(own).decode()) for n, own in items], window)
        hit, found, _ = decontamination.search(texts, tests)
        for text, bits, names in zip(texts, hit, found, strict=True):
            expected, wanted = [False] * len(text), set()
            for name, own in items:
                size = min(window, len(own))
                parts = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
                for k in range(len(text) - size + 1):
                    if tuple(text[k : k + size]) in parts:
                        wanted.add(name)
                        expected[k : k + size] = [True] * size
            assert bits.tolist() == expected and names == wanted


def test_inflating_in_small_steps(monkeypatch):
    import io

    monkeypatch.setattr(warc, "BLOCK", 7)
    records = [warc.page_record(i, "u", b"x" * i, None) for i in range(40)]
    for data in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        stream, seen = warc.Inflated(io.BytesIO(data)), []
        while (header := stream.header()) is not None:
            size = int(warc.fields_of(header)["content-length"])
            seen.append(header + b"".join(stream.pieces(size + 4)))
        assert seen == records


def test_decontamination(spark, docs):
    tests = spark.createDataFrame([(1, "Word3 of a plain text word4 of a plain text"), (2, None), (3, "?"), (None, "kurzer TEXT"), (1, "long5 long6"), (4, "absent words")], "item_id long, text string")
    rows = decontamination.find_passages(docs, tests, keep=["doc_id", "text", "n_words"])
    by = {r.text: r for r in rows.collect()}
    assert rows.count() == len(ROWS) and by[PLAIN].items == ["1"] and by[PLAIN].n_hit == 10 and by[LONG].n_hit == 2 and by["ein kurzer Text"].items == [""]
    assert by[None].n_words == by[None].n_hit == 0 and by[None].items == []
    blocks = decontamination.find_passages(docs, tests, keep=["doc_id", "text"], block_chars=20)
    assert {r.text: (r.n_hit, r.items) for r in blocks.collect()} == {t: (r.n_hit, r.items) for t, r in by.items()}
    assert {r.n_hit for r in decontamination.find_passages(docs, tests.filter("false")).collect()} == {0}
    assert decontamination.find_passages(docs.filter("false"), tests).count() == 0


def test_long_matches_cross_shards(monkeypatch):
    monkeypatch.setattr(decontamination, "SHARD_WORDS", 40)
    item = [b"i%d" % i for i in range(25)]
    text = [b"a%d" % i for i in range(30)] + item + [b"b%d" % i for i in range(30)]
    tests = decontamination.Tests([("7", b" ".join(item).decode())], 10)
    hit, found, matches = decontamination.search([text, text[:35], []], tests)
    assert hit[0].nonzero()[0].tolist() == list(range(30, 55)) and not hit[1].any() and found[0] == {"7"}
    assert matches[0] == [("7", 0, 30, 25)]


@pytest.mark.parametrize("step", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_stages_return_the_columns_of_documents(spark, docs, step):
    folder = "/root/testdata/sf0.001"
    assert step(spark, docs, folder).schema.names == docs.columns
    assert step(spark, docs.filter("false"), folder).count() == 0
    assert step(spark, docs, folder).filter("doc_id = 7").count() == 1
