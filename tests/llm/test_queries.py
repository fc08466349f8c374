"""The registered queries against SQL or plain Python on whole tables."""

import html
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from siftbook.llm import queries
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"


def frame(spark, name):
    return queries.QUERIES[name](spark, FOLDER).toPandas()


def given(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet").toPandas()


@pytest.mark.parametrize("name", list(queries.SQL))
def test_equals_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.SQL[name]) is None


def test_languages_of_held_out_texts(spark):
    rows = frame(spark, "op1_language").merge(given(spark, "documents"), on="doc_id")
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]).all()
    held = rows[rows.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97 and rows.score.between(0, 1).all()


def test_main_texts(spark):
    rows = frame(spark, "op2_main_text").merge(given(spark, "pages"), on="page_id")
    for text, page in zip(rows.text, rows.html, strict=True):
        article = re.search(r"<article>(.*?)</article>", page or "", re.S)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article[1])] if article else []
        assert text == "\n".join(b for b in blocks if b)
    assert (rows.n_chars == rows.text.str.len()).all()


def check_packed(rows: pd.DataFrame, docs: pd.DataFrame):
    """Every token of every document stands once, in sequences without gaps."""
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(queries.vocabulary())
    expected = {}
    for doc, text in zip(docs.doc_id, docs.text, strict=True):
        ids = np.array([*tokens.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            expected[doc, k // 4096] = (k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes()))
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows.itertuples()}
    assert len(rows) == len(got) and got == expected
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == (own.length.cumsum() - own.length).tolist() and own.length.sum() <= 4096
    assert rows.sequence_id.nunique() <= 1.02 * rows.length.sum() / 4096 + 2


def test_packed_sequences(spark):
    check_packed(frame(spark, "op6_pack"), given(spark, "documents"))


def test_shards(spark):
    rows = frame(spark, "op7_shards").merge(given(spark, "documents")[["doc_id", "text"]], on="doc_id")
    counts = rows.groupby("shard").size()
    assert set(counts.index) == set(range(8)) and counts.max() - counts.min() <= 1
    assert all(sorted(own.slot) == list(range(len(own))) for _, own in rows.groupby("shard"))
    assert all((len(t.encode()) + 1, zlib.crc32(t.encode())) == (s, c) for t, s, c in zip(rows.text, rows["size"], rows.text_crc32, strict=True))
    assert (rows.groupby("text").shard.nunique() == 1).all() and (rows.law == "rows").all() and rows.grown_shard.isna().all()


def test_quality_of_held_out_texts(spark):
    rows = queries.QUERIES["op8_quality"](spark, "/root/testdata/sf0.01").toPandas()
    known = rows.merge(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas(), on="doc_id")
    held = known[known.held_out]
    assert len(rows) == 1000 and rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.3)).all()
    assert (held.predicted == held.quality).mean() > 0.9


def test_pipeline_keeps_what_each_stage_keeps(spark):
    """The stages against the queries' own SQL and plain Python, each on its own input."""
    import duckdb

    import corpus_pipeline

    rows = corpus_pipeline.run(spark, FOLDER).toPandas()
    docs = given(spark, "documents")
    docs = docs[docs.text.str.contains(r"[^\W\d_]", regex=True)]
    for name, keep in (("op3_quality", "kept"), ("op4_near_dedup", "kept"), ("op10_decontaminate", "NOT contaminated")):
        con = duckdb.connect()
        con.register("documents", docs)
        con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{FOLDER}/benchmark.parquet'")
        kept = con.execute(f"SELECT doc_id FROM ({queries.SQL[name]}) WHERE {keep}").df().doc_id
        docs = docs[docs.doc_id.isin(kept)]
    check_packed(rows, docs)
