"""Near-duplicate classes: a MinHash LSH forest finds candidates, whole shingle sets confirm them."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftbook.llm.batches import mapped
from siftbook.llm.words import Hashes, spaced_words
from siftbook.operators.graph import components
from siftbook.session import stage

#: Hash functions of a signature, trees of the forest, and values that neighbours share at least.
HASHES, TREES, DEPTH = 128, 32, 4
#: Neighbours before a row in the sorted order of its region that it is first compared with.
WINDOW = 256
#: Nodes of a region that are compared in one piece; a larger region is compared part by part.
TILE = 1024
#: Equal signature values of a pair that is confirmed, and of one that is confirmed though its ends have better partners.
#: A pair with similarity 0.75 has 96 on average, with a deviation of 5.
AGREE, CLOSE = 64, 78

_M = np.uint64(0x9E3779B97F4A7C15)
_draw = np.random.default_rng(20240229)
_FLIPS, _FACTORS = _draw.integers(0, 1 << 32, (HASHES, 1), np.uint32), _draw.integers(0, 1 << 32, (HASHES, 1), np.uint32) | np.uint32(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(words: list[bytes], hashes: Hashes, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; a shorter text is one run, no words are none."""
    own = hashes.of(words)
    if len(own) < size:
        size = len(own)
    if not size:
        return own
    runs = np.full(len(own) - size + 1, size, np.uint64)
    for k in range(size):
        runs = runs * _M + own[k : len(own) - size + 1 + k]
    return np.unique(_mixed(runs))


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """Sixteen bits of the least value of each hash function over the set."""
    low, least = (shingle_set >> np.uint64(32)).astype(np.uint32), np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        least = np.minimum(least, ((low[at : at + 2048] ^ _FLIPS) * _FACTORS).min(1))
    return (_mixed(least.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)


def signed(docs: DataFrame, keep: list[str], size: int = 5) -> DataFrame:
    """Set size, digest of the set (null if empty) and signature of each whole text."""
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("signature", T.BinaryType())]
    hashes = Hashes()

    def fn(piece: pa.RecordBatch) -> dict[str, list]:
        sets = [shingles(spaced_words(t), hashes, size) for t in piece.column("text").to_pylist()]
        return {
            "n_shingles": [len(s) for s in sets],
            "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
            "signature": [signature(s).tobytes() if len(s) else None for s in sets],
        }

    return mapped(docs, "text", fields, fn, keep=keep)


def regions(nodes: DataFrame) -> DataFrame:
    """(region, node, tree): where a node stands in each tree, by the first ``DEPTH`` values of the tree's order.

    Tree t reads the signature from value ``DEPTH * t`` on, around its end.
    """

    def task(batches):
        for batch in batches:
            signs = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, HASHES)
            keys = np.ascontiguousarray(signs).view(np.uint64)  # four values each
            keys = _mixed(keys + np.arange(1, TREES + 1, dtype=np.uint64) * _M).view(np.int64).ravel()
            node = np.repeat(batch.column("node").to_numpy(), TREES)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(node), pa.array(np.tile(np.arange(TREES, dtype=np.int8), len(signs)))], ["region", "node", "tree"])

    return nodes.select("node", "signature").mapInArrow(task, "region long, node long, tree byte")


def _signs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def neighbours(placed: DataFrame, most: int = 2) -> DataFrame:
    """Pairs of nodes that stand close in the sorted order of a region and are not in one class yet.

    ``placed`` has region, node, class and the signature as its tree reads it. Rows are sorted by
    region and signature, so the longest common prefixes are next to each other: a crowded region is
    read as deep as its rows agree. Each row is compared with ``WINDOW`` rows before it and names its
    ``most`` best agreeing partners. That joins most classes early; :func:`across` finds what is left.
    """

    def task(batches):
        tail = None
        for batch in batches:
            for piece in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                new = (*(piece.column(c).to_numpy() for c in ("region", "node", "class")), _signs(piece.column("ordered")))
                region, node, group, signs = new if tail is None else tuple(np.concatenate(x) for x in zip(tail, new, strict=True))
                begin = len(region) - len(new[0])
                found = [np.zeros((3, 0), np.int64)]
                for distance in range(1, min(WINDOW, len(region) - 1) + 1):
                    later = np.arange(max(begin, distance), len(region))
                    later = later[region[later] == region[later - distance]]
                    if not len(later):
                        break
                    later = later[group[later] != group[later - distance]]
                    agree = (signs[later] == signs[later - distance]).sum(1)
                    near = agree >= AGREE
                    found.append(np.stack([later[near], later[near] - distance, agree[near]]))
                pairs = np.concatenate(found, 1)
                pairs = pairs[:, _best(pairs, most)]
                a, b = node[pairs[0]], node[pairs[1]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
                tail = tuple(x[-WINDOW:] for x in (region, node, group, signs))

    rows = placed.repartitionByRange(F.col("region"), F.col("ordered")).sortWithinPartitions("region", "ordered", "node")
    return rows.select("region", "node", "class", "ordered").mapInArrow(task, "a long, b long").distinct()


def tiled(placed: DataFrame) -> DataFrame:
    """The rows of ``placed`` (region, node, class) for each tile they are compared in: low, high and own.

    A region of up to ``TILE`` nodes is one tile. In a larger one, the nodes of its largest class and
    all others are dealt into parts of about ``TILE`` nodes; a tile is two parts, and each two parts
    meet but those that both are of the largest class. So all pairs of nodes in different classes
    meet, and a crowd that is one class but for a few nodes is not copied.
    """
    sizes = placed.groupBy("region", "class").agg(F.count("*").alias("n"))
    large = sizes.groupBy("region").agg(F.sum("n").alias("all"), F.max(F.struct("n", "class")).alias("most"))
    parts = large.select("region", "all", F.col("most.class").alias("major"), F.ceil(F.col("most.n") / TILE).alias("m"), F.ceil((F.col("all") - F.col("most.n")) / TILE).alias("k"))
    at, small, major = F.xxhash64("node"), F.col("all") <= TILE, F.col("class") == F.col("major")
    own = F.when(small, F.lit(0)).when(major, F.col("k") + F.pmod(at, F.col("m"))).otherwise(F.pmod(at, F.col("k")))
    last = F.when(small, F.lit(0)).when(major, F.col("k") - 1).otherwise(F.col("k") + F.col("m") - 1)
    met = placed.join(parts, "region").withColumn("own", own.cast("int")).withColumn("met", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    return met.select(*placed.columns, "own", F.least("own", "met").alias("low"), F.greatest("own", "met").alias("high"))


def across(tiles: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes in different classes whose whole sets have the similarity, from all pairs of a tile.

    ``tiles`` has tree, signature and set besides what :func:`tiled` gives. A pair is
    compared in the first tree whose region both are in. A row names one node of each other class.
    """
    names = ("region", "low", "high", "own", "tree", "node", "class")

    def task(batches):
        tail = None
        for batch in batches:
            for piece in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                sets = np.array([np.frombuffer(x, np.uint64) for x in piece.column("shingles").to_pylist()] + [None], object)[:-1]
                new = (*(piece.column(c).to_numpy() for c in names), sets, _signs(piece.column("signature")))
                held = new if tail is None else tuple(np.concatenate(x) for x in zip(tail, new, strict=True))
                region, low, high, own, tree, node, group, sets, signs = held
                keys, begin = signs.view(np.uint64), len(region) - len(new[0])
                starts = np.flatnonzero(np.r_[True, (region[1:] != region[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
                first = np.repeat(starts, np.diff(np.r_[starts, len(region)]))
                found = [np.zeros((2, 0), np.int64)]
                later = np.arange(begin, len(region))
                for distance in range(1, len(region)):
                    later = later[later - distance >= first[later]]
                    if not len(later):
                        break
                    b = later[(group[later] != group[later - distance]) & ((own[later] != own[later - distance]) | (low[later] == high[later]))]
                    b = b[(keys[b] == keys[b - distance]).argmax(1) == tree[b]]
                    b = b[(signs[b] == signs[b - distance]).sum(1) >= CLOSE]
                    found.append(np.stack([b, b - distance]))
                pairs = _linked(np.concatenate(found, 1), group, np.array([len(x) for x in sets]), sets, percent)
                a, b = node[pairs[0]], node[pairs[1]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
                tail = tuple(x[starts[-1] :] for x in held)  # the tile that may go on

    rows = tiles.repartition("region", "low", "high").sortWithinPartitions("region", "low", "high")
    return rows.select(*names, "shingles", "signature").mapInArrow(task, "a long, b long").distinct()


def _best(pairs: np.ndarray, most: int) -> np.ndarray:
    """Pairs that are among the best agreeing ones of one of their ends."""
    chosen = np.zeros(pairs.shape[1], bool)
    for side in (0, 1):
        order = np.lexsort((-pairs[2], pairs[side]))
        owner = pairs[side][order]
        chosen[order[np.arange(len(owner)) - np.searchsorted(owner, owner) < most]] = True
    return chosen


def _linked(pairs: np.ndarray, group: np.ndarray, size: np.ndarray, sets: np.ndarray, percent: int) -> np.ndarray:
    """Of the pairs whose sets reach the similarity, one for each row and class."""
    pairs = pairs[:, np.argsort(pairs[0], kind="stable")]
    kept = []
    for rows in np.split(np.arange(pairs.shape[1]), np.flatnonzero(np.diff(pairs[0])) + 1):
        if not len(rows):
            continue
        row, others = pairs[0][rows[0]], pairs[1][rows]
        joined, lengths = np.concatenate([sets[o] for o in others]), np.array([len(sets[o]) for o in others])
        at = np.searchsorted(sets[row], joined)
        same = sets[row][np.minimum(at, len(sets[row]) - 1)] == joined
        common = np.add.reduceat(same.astype(np.int64), np.cumsum(lengths) - lengths)
        linked = rows[100 * common >= percent * (size[row] + size[others] - common)]
        kept.append(linked[np.unique(group[pairs[1][linked]], return_index=True)[1]])
    return pairs[:, np.concatenate(kept)] if kept else pairs[:, :0]


def agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose signatures agree in ``AGREE`` values at least."""
    signs = nodes.select("node", "signature")
    both = pairs.join(signs.withColumnsRenamed({"node": "b", "signature": "sb"}), "b").join(signs.withColumnsRenamed({"node": "a", "signature": "sa"}), "a")

    def task(batches):
        for batch in batches:
            yield batch.select(["a", "b"]).filter(pa.array((_signs(batch.column("sa")) == _signs(batch.column("sb"))).sum(1) >= AGREE))

    return both.select("a", "b", "sa", "sb").mapInArrow(task, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose whole sets have the asked similarity."""
    whole = sets.select("node", "shingles")
    both = pairs.join(whole.withColumnsRenamed({"node": "b", "shingles": "sb"}), "b").join(whole.withColumnsRenamed({"node": "a", "shingles": "sa"}), "a")

    def linked(a: bytes, b: bytes) -> bool:
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        common = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * common >= percent * (len(x) + len(y) - common)

    def task(batches):
        for batch in batches:
            sa, sb = batch.column("sa"), batch.column("sb")
            yield batch.select(["a", "b"]).filter(pa.array([linked(x.as_buffer(), y.as_buffer()) for x, y in zip(sa, sb, strict=True)], pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(task, "a long, b long")


def classes(docs: DataFrame, percent: int = 75, size: int = 5) -> DataFrame:
    """n_shingles, component_id and kept for each row of ``docs`` (``doc_id``, ``text``).

    Texts with equal sets are one node. In each region of each tree all nodes are held against the
    lowest one; then, in regions that still hold several classes, against their best few neighbours in
    sorted order; what is still apart is compared with all nodes of other classes in the region by
    sets, whatever its size. Only pairs that exact sets confirm count. Empty texts are linked with nothing; a row with a null id is in a
    class by its text, but names none: if all ids of a class are null, so is component_id, and the
    row is kept. Repeated rows have one class, and each of those with its lowest id is kept. An empty
    table gives no rows.
    """
    rows = stage(signed(docs.select("doc_id", "text", F.md5("text").alias("text_key")), ["doc_id", "text_key"], size), "signatures")
    first = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc_id", "text_key", "signature")).alias("r"), F.min("doc_id").alias("lowest"))
    nodes = stage(first.select(F.monotonically_increasing_id().alias("node"), "digest", "lowest", "r.*"), "nodes")
    trees = regions(nodes)
    crowded = trees.groupBy("region").agg(F.count("*").alias("n"), F.min("node").alias("leader")).filter("n > 1").drop("n")
    members = stage(trees.join(crowded, "region"), "regions")

    named = members.select("node").distinct().join(nodes.select("node", "doc_id", "text_key"), "node")
    sets = stage(_sets(docs, named, size), "sets")

    pairs = members.filter("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    checked = stage(agreeing(pairs, nodes), "pairs")
    links = stage(confirmed(checked, sets, percent), "links")
    groups = components(links)
    for early in (True, False):
        placed = members.join(groups, "node", "left").select("region", "node", "tree", F.coalesce("component", "node").alias("class"))
        mixed = placed.groupBy("region").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high").select("region")
        placed, signs = placed.join(mixed, "region"), nodes.select("node", "signature")
        if early:
            # the signature as the tree reads it
            ordered = F.expr(f"concat(substring(signature, 1 + tree * {2 * DEPTH}), substring(signature, 1, tree * {2 * DEPTH}))")
            near = neighbours(placed.join(signs, "node").withColumn("ordered", ordered))
            found = stage(confirmed(stage(near.join(checked, ["a", "b"], "left_anti"), "pairs"), sets, percent), "links")
        else:
            found = stage(across(tiled(stage(placed, "apart")).join(signs, "node").join(sets, "node"), percent), "links")
        links = links.unionByName(found)
        if not found.isEmpty():
            groups = components(links)
    # the lowest id of a class is found among its nodes, so no row of a large class travels for it
    grouped = nodes.select("node", "lowest").join(groups, "node")
    lowest = grouped.groupBy("component").agg(F.min("lowest").alias("_least"))
    named = groups.join(lowest, "component").select("node", "_least")
    whole = nodes.select("node", "digest", "lowest").join(named, "node", "left").select("digest", F.coalesce("_least", "lowest").alias("component_id"))
    joined = rows.select("doc_id", "n_shingles", "digest").join(whole, "digest", "left")
    out = joined.withColumn("component_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def _sets(docs: DataFrame, named: DataFrame, size: int) -> DataFrame:
    """Whole shingle sets of the named texts."""
    hashes = Hashes()

    def fn(piece: pa.RecordBatch) -> dict[str, list]:
        sets = [shingles(spaced_words(t), hashes, size) for t in piece.column("text").to_pylist()]
        return {
            "shingles": [s.tobytes() for s in sets],
        }

    texts = docs.select(F.col("doc_id").alias("_id"), "text", F.md5("text").alias("_key"))
    found = texts.join(named, texts["_id"].eqNullSafe(named["doc_id"]) & (texts["_key"] == named["text_key"])).select("node", "text").dropDuplicates(["node"])
    return mapped(found, "text", [T.StructField("shingles", T.BinaryType())], fn, keep=["node"])
