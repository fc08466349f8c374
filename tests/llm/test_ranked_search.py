"""The dual tree against scores of all pairs."""

import math
from collections import Counter

import numpy as np
import pytest

from siftbook.llm import ranked_search as R
from siftbook.llm.words import term_words


def brute(docs, items, k):
    bags = [(i, Counter(term_words(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    total, length = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in set(items):
        found = []
        for doc, bag, n in bags:
            m = 10 + 90 * n * total // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in set(term_words(text)) if t in bag)
            if s > 0 and doc is not None:
                found.append((-s, doc))
        out += [(str(item), r + 1, d, -s) for r, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def tables():
    """Ties, repeated rows and ids, nulls, texts without terms, a long text, other scripts."""
    rng = np.random.default_rng(7)
    text = lambda n, top: " ".join(f"W{min(x, top)}" for x in rng.zipf(1.3, n))
    docs = [(i, text(int(rng.integers(0, 60)), 400)) for i in range(300)]
    docs += [(i + 400, docs[i % 7][1]) for i in range(40)]
    docs += [docs[3], (3, docs[9][1]), (None, docs[4][1]), (None, None), (900, None), (901, ""), (902, "?! ..."), (903, text(30_000, 5000)), (904, "Ünï 漢字 w1"), (-4, docs[5][1])]
    items = [(i, text(int(rng.integers(1, 25)), 400)) for i in range(60)]
    items += [items[0], (0, items[1][1]), (None, "w2 w3"), (61, None), (62, ""), (63, "nowhere else"), (64, "漢字 W1 w1"), (65, "w7")]
    return docs, items


@pytest.mark.parametrize(("block", "k"), [(4 << 20, 10), (500, 3)])
def test_equals_all_pairs(spark, tables, block, k):
    docs, items = tables
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, terms string, n int").repartition(6)
    found = R.search(d, spark.createDataFrame(items, "item_id long, text string"), k=k, block_chars=block, seeds=4)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((str(r.item_id), r.rank, r.doc_id, r.score) for r in found.collect()) == brute(docs, items, k)


def test_nodes_are_pruned():
    """Most pairs are never scored, and the best are the same."""
    rng = np.random.default_rng(8)
    texts = [[b"t%d" % x for x in rng.integers(0, 3000, 12)] for _ in range(200)]
    items = R.Items(texts)
    weights = rng.integers(1, 5000, len(items.numbers))
    items.weigh(weights)
    tree = R.DualTree(items, weights, 3, np.zeros(200, np.int64))
    expected = [[] for _ in texts]
    for start in range(0, 6000, 2000):
        ids = np.arange(start, start + 2000)
        row, terms = np.repeat(np.arange(2000), 15), rng.integers(0, len(weights), 30000)
        keys = np.unique(row * len(weights) + terms)
        row, terms = keys // len(weights), keys % len(weights)
        values = rng.integers(1, 100, len(row))
        dense = np.zeros((2000, len(weights)), np.int64)
        dense[row, terms] = values
        for i, text in enumerate(texts):
            own = [items.numbers[w] for w in set(text)]
            expected[i] += zip((-(dense[:, own] * weights[own]).sum(1)).tolist(), ids.tolist(), strict=True)
        tree.add(ids, row, terms, values)
    group, score, doc = tree.best.rows()
    assert list(zip(group.tolist(), (-score).tolist(), doc.tolist(), strict=True)) == [(i, s, d) for i, e in enumerate(expected) for s, d in sorted(e)[:3] if s < 0]
    assert tree.pairs < 0.5 * 200 * 6000


def test_no_rows(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert R.search(docs, items).count() == 0 and R.search(items.withColumnRenamed("item_id", "doc_id"), items.filter("false")).count() == 0
