"""The FM-index, its backward search and the removal of repeated passages, against brute force."""

import numpy as np
import pytest

from siftbook.llm import substrings
from siftbook.llm.fm_index import FMIndex, WaveletMatrix, earlier_matches, suffix_order


def test_suffixes_are_sorted():
    rng = np.random.default_rng(3)
    for _ in range(20):
        symbols = np.append(rng.integers(0, 4, 60), 0)
        ends = np.cumsum(symbols == 0)
        keys = [[(0, int(ends[j])) if symbols[j] == 0 else (1, int(symbols[j])) for j in range(i, len(symbols))] for i in range(len(symbols))]
        assert suffix_order(symbols).tolist() == sorted(range(len(symbols)), key=keys.__getitem__)


def test_ranks_of_a_wavelet_matrix():
    symbols = np.random.default_rng(4).integers(0, 50, 1000)
    matrix = WaveletMatrix(symbols)
    for c in (0, 7, 49):
        at = np.arange(1001)
        c_all = np.full(1001, c)
        ranks = matrix.follow(c_all, at) - matrix.follow(c_all, np.zeros(1001, np.int64))
        assert ranks.tolist() == [int((symbols[:i] == c).sum()) for i in at]


@pytest.mark.parametrize("seed", range(40))
def test_matches_equal_all_windows(seed):
    rng = np.random.default_rng(seed)
    least, n, letters = int(rng.integers(1, 6)), int(rng.integers(1, 30)), int(rng.integers(1, 5))
    texts = [rng.integers(1, letters + 1, int(rng.integers(0, 20))) for _ in range(n)]
    owner = np.sort(rng.integers(0, n, n))
    symbols = np.concatenate([np.append(t, 0) for t in texts])
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes + 1) - sizes - 1
    got = np.zeros(len(symbols), bool)
    for _, a, b in zip(*earlier_matches(FMIndex(symbols, np.repeat(owner, sizes + 1)), symbols, begin, begin + sizes, owner, least), strict=True):
        got[a:b] = True
    assert (got == covered([t.tolist() for t in texts], owner.tolist(), least, begin, len(symbols))).all()


def covered(texts, owner, least, begin, size):
    first, out = {}, np.zeros(size, bool)
    windows = [(i, s, tuple(t[s : s + least])) for i, t in enumerate(texts) for s in range(len(t) - least + 1)]
    for i, _, w in windows:
        first[w] = min(first.get(w, owner[i]), owner[i])
    for i, s, w in windows:
        if first[w] < owner[i]:
            out[begin[i] + s : begin[i] + s + least] = True
    return out


def expected(rows, window):
    """(id, words, words that stay) of rows of (id, text)."""
    first, out = {}, []
    split = [(doc, (text or "").split()) for doc, text in rows]
    for doc, words in split:
        for s in range(len(words) - window + 1 if doc is not None else 0):
            w = tuple(words[s : s + window])
            first[w] = min(first.get(w, doc), doc)
    for doc, words in split:
        gone = set()
        for s in range(len(words) - window + 1 if doc is not None else 0):
            if first[tuple(words[s : s + window])] < doc:
                gone |= set(range(s, s + window))
        out.append((str(doc), len(words), " ".join(x for i, x in enumerate(words) if i not in gone)))
    return sorted(out)


@pytest.mark.parametrize(("crowd", "index_words"), [(256, 1 << 19), (2, 1 << 19), (256, 40)])
def test_removal_equals_brute_force(spark, crowd, index_words):
    """Shared lines in many contexts, copies, near copies, repeats inside a text, repeated rows and ids, nulls, a long text."""
    rng = np.random.default_rng(5)
    word = lambda n, top: [f"w{x}" for x in rng.integers(0, top, n)]
    line = word(9, 1000)
    rows = [(i, " ".join(word(int(rng.integers(0, 30)), 2))) for i in range(20)]
    rows += [(100 + i, " ".join(word(int(rng.integers(0, 15)), 300) + line + word(int(rng.integers(0, 15)), 300))) for i in range(40)]
    rows += [(200 + i, rows[45][1] + " " + " ".join(word(int(rng.integers(0, 3)), 300))) for i in range(10)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (None, None), (300, None), (301, ""), (302, " \t\n"), (303, "\n\n".join(line + line)), (304, " ".join(word(5000, 50))), (-5, rows[45][1])]
    docs = spark.createDataFrame([(i, t, "x", 0, "y") for i, t in rows], "doc_id long, text string, kept_text string, n_words int, th string")
    found = substrings.remove_repeats(docs, window=8, gram=4, crowd=crowd, index_words=index_words)
    assert found.columns == ["doc_id", "text", "th", "n_words", "n_removed", "removed", "kept_text"]
    got = found.collect()
    assert sorted((str(r.doc_id), r.n_words, r.kept_text) for r in got) == expected(rows, 8)
    assert all(r.n_removed == sum(s.stop - s.start for s in r.removed) == r.n_words - len(r.kept_text.split()) for r in got)
    assert any(r.n_removed for r in got)


def test_words_over_and_over_are_few_fragments(spark):
    """A text of two words in turn has as many windows as words, but only two different ones; each is one row with its starts."""
    docs = spark.createDataFrame([(i, " ".join(["ab", "cd"] * (100 + i) + [f"w{i}"])) for i in range(30)], "doc_id long, text string")
    keyed = docs.selectExpr("doc_id", "xxhash64(text) AS th", "text")
    rows = substrings._fragments(keyed, 8, 8).collect()
    assert sum(len(r.starts) for r in rows) == sum(2 * (100 + i) + 1 - 7 for i in range(30))
    # two windows in turn, and seven or eight at the end that hold the last word
    assert len(rows) <= 30 * 10
    for crowd in (256, 2):
        got = substrings.remove_repeats(docs, window=8, gram=4, crowd=crowd).collect()
        assert sorted((str(r.doc_id), r.n_words, r.kept_text) for r in got) == expected([(r.doc_id, r.text) for r in got], 8)


def test_no_rows(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
