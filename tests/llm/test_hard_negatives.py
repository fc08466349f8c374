"""Hard negatives against all pairs, and the packed keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftbook.llm import hard_negatives as H
from siftbook.llm.best import Best


def test_keys_sort_like_their_parts():
    rng = np.random.default_rng(1)
    rows = [(int(a), int(s), bool(n), int(i)) for a, s, n, i in zip(rng.integers(-3, 3, 300), rng.integers(-(1 << 60), 1 << 60, 300), rng.integers(0, 2, 300), rng.integers(-9, 9, 300), strict=True)]
    rows += [(a, 5, n, i) for a, _, n, i in rows[:50]]
    assert [H.unpacked(k) for k in sorted(H.packed(*r) for r in rows)] == sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3]))


def test_best_of_groups():
    rng = np.random.default_rng(2)
    best, held = Best(4, 3, -100, distinct=True), set()
    for _ in range(20):
        rows = [(int(g), int(s), int(i)) for g, s, i in zip(rng.integers(0, 4, 15), rng.integers(-9, 9, 15), rng.integers(0, 9, 15), strict=True)]
        best.add(*map(np.array, zip(*rows, strict=True)))
        held |= set(rows)
    expected = [r for g in range(4) for r in sorted((r for r in held if r[0] == g), key=lambda r: (-r[1], r[2]))[:3]]
    assert list(zip(*(x.tolist() for x in best.rows()), strict=True)) == expected


@pytest.mark.parametrize("size", [1.0, 2.0**30, 1e30])
def test_scores_are_whole(size):
    rng = np.random.default_rng(3)
    a, b = (np.floor(rng.normal(size=(5, 7)) * size * 100) for _ in range(2))
    exact = [[min(max(sum(int(x) * int(y) for x, y in zip(p, q, strict=True)), -(1 << 63) + 1), (1 << 63) - 1) for q in b] for p in a]
    assert H.scores(a, b).tolist() == exact


def brute(rows, share=80, k=5):
    ok = [(i, l, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for a, la, va in ok:
        if a % 10:
            continue
        pairs = sorted({(-sum(x * y for x, y in zip(va, v, strict=False)), i, l) for i, l, v in ok if i != a})
        for s, p, _ in [r for r in pairs if r[2] == la][:k]:
            fits = [(i, n) for n, i, l in pairs if l != la and -share * s <= -100 * n and n >= s]
            out |= {(a, p, r + 1, i, -s, -n) for r, (i, n) in enumerate(fits[:k])}
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    """Ties, equal vectors, repeated rows, nulls, broken and short vectors."""
    rng = np.random.default_rng(4)
    base = [[float(x) for x in v] for v in np.round(rng.normal(size=(12, 6)), 1)]
    out = [(i, base[int(rng.integers(0, 12))], int(rng.integers(0, 3))) for i in range(150)]
    out += [out[20], out[21], (None, base[0], 1), (200, None, 1), (201, base[0], None), (202, [1.0, None, 0.0], 1), (210, [float("nan")] * 6, 1), (211, [float("inf"), 0.0], 1), (220, base[3][:2], 0), (221, [], 1)]
    return out


@pytest.mark.parametrize("block", [4096, 3])
def test_equals_all_pairs(spark, rows, block):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, score string").repartition(5)
    got = H.mine(docs, F.col("vec_id") % 10 == 0, anchor_block=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert H.mine(docs, F.col("vec_id") % 10 == 0).count() == 0
