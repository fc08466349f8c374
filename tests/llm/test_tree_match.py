"""Tree matching against the plain table over all prefixes."""

import json
import random
import time
from functools import cache

from siftbook.llm import pages
from siftbook.llm.tree_match import Shapes


def tree(rng, depth):
    return tuple((rng.choice("ab"), tree(rng, depth - 1) if depth and rng.random() < 0.6 else ()) for _ in range(rng.randrange(5)))


@cache
def most(ours, theirs):
    """Nodes paired of two lists of (label, children)."""
    if not ours or not theirs:
        return 0
    (a, below), (b, below_) = ours[-1], theirs[-1]
    both = most(ours[:-1], theirs[:-1]) + 1 + most(below, below_) if a == b else 0
    return max(most(ours[:-1], theirs), most(ours, theirs[:-1]), both)


def leftmost(ours, theirs):
    i, j, found = len(ours), len(theirs), {}
    while i and j:
        if most(ours[:i], theirs[:j]) == most(ours[: i - 1], theirs[:j]):
            i -= 1
        elif most(ours[:i], theirs[:j]) == most(ours[:i], theirs[: j - 1]):
            j -= 1
        else:
            i, j = i - 1, j - 1
            found[i] = j
    return found


def test_pairs_are_those_of_the_whole_table():
    rng = random.Random(2)
    paired = 0
    for _ in range(1000):
        a, b = tree(rng, 3) + tree(rng, 2), tree(rng, 3) + tree(rng, 2)
        shapes = Shapes()

        def ids(nodes, shapes=shapes):
            return tuple(shapes.add(label, ids(below)) for label, below in nodes)

        got = shapes.pairs(ids(a), ids(b))
        assert got == leftmost(a, b)
        assert sum(shapes.weight(ids(a)[i], ids(b)[j]) for i, j in got.items()) == most(a, b)
        paired += len(got)
    assert paired > 1000


def test_wide_pages():
    """A page of 10,000 rows, where no two neighbours are alike, next to one with other rows."""
    rng = random.Random(3)

    def page(own):
        rows = "".join(f"<tr><td class=c{rng.randrange(3)}>row {i}</td><td><div>b</div><p class=k{rng.randrange(3)}>c</p></td></tr>" for i in range(10_000))
        return f"<p>Notice.</p><table>{rows}</table><h2>{own}</h2>"

    seed = json.dumps(pages.plain(pages.skeleton(pages.parse(page("Seed.")))))
    start = time.perf_counter()
    found = pages.blocks(page("Own."), seed)
    assert time.perf_counter() - start < 60
    assert found[0][1:] == (True, "Notice.") and found[-1] == ("/2", False, "Own.")
    assert sum("row" in text for _, _, text in found) == 10_000
