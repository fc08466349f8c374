"""Quality of whole texts by a small convolutional network over bytes, in numpy."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftbook.llm.batches import mapped

#: Filters read eight bytes at every fourth byte; a chunk is two halves of 512 bytes and starts at every half.
STEP, HALF, VECTOR, FILTERS = 4, 128, 8, 48
#: Bytes that go through the filters at a time.
SLICE = HALF * STEP * 1024

SCORE = [T.StructField("score", T.DoubleType())]


class Net(NamedTuple):
    """Byte vectors, filters on a step and on the step after it, and the weights of the pooled filters and of their squares.

    A square lets an unusually strong filter speak against a text, as in one that repeats a word.
    """

    byte: np.ndarray
    now: np.ndarray
    next: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    square: np.ndarray
    level: np.ndarray


class Layout:
    """Texts cut into slices of whole halves; each slice sees the four bytes after it."""

    def __init__(self, texts: list[bytes]):
        parts, steps, self.halves = [], [], []
        for text in texts:
            for at in range(0, max(len(text), 1), SLICE):
                part = text[at : at + SLICE]
                n = max(-(-len(part) // STEP), 1)
                parts.append(part.ljust(n * STEP, b"\0") + text[at + SLICE : at + SLICE + STEP].ljust(STEP, b"\0"))
                steps.append(n)
            self.halves.append(max(-(-len(text) // (HALF * STEP)), 1))
        self.parts, self.steps = parts, steps
        self.first = np.cumsum(self.halves) - self.halves  # of each text, among all halves

    def groups(self):
        """Byte arrays of about a slice, with the start and length of each half in steps."""
        held, size, begin, length, at = [], 0, [], [], 0
        for part, n in zip(self.parts, self.steps, strict=True):
            if held and size + len(part) > SLICE + STEP:
                yield np.frombuffer(b"".join(held), np.uint8), np.array(begin), np.array(length)
                held, size, begin, length, at = [], 0, [], [], 0
            held.append(part)
            size += len(part)
            for start in range(0, n, HALF):
                begin.append(at + start)
                length.append(min(HALF, n - start))
            at += n + 1
        if held:
            yield np.frombuffer(b"".join(held), np.uint8), np.array(begin), np.array(length)


def _filtered(net: Net, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps = net.byte[data].reshape(-1, STEP * VECTOR)
    out = steps[:-1] @ net.now
    out += steps[1:] @ net.next
    out += net.bias
    return steps, np.maximum(out, 0, out=out)


def _sums(active: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    edges = np.stack([begin, begin + length], 1).ravel()
    if edges[-1] >= len(active):
        edges = edges[:-1]
    return np.add.reduceat(active, edges, axis=0)[::2]


def _pooled(layout: Layout, sums: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best mean of each filter over the chunks of a text, the chunk it comes from, and the chunks' sizes."""
    last = np.zeros(len(sums), bool)
    last[layout.first[1:] - 1] = True
    last[-1] = True
    following = np.where(last[:, None], 0, np.roll(sums, -1, axis=0))
    size = np.maximum(length + np.where(last, 0, np.roll(length, -1)), HALF // 2)
    means = (sums + following) / size[:, None]
    best = np.maximum.reduceat(means, layout.first, axis=0)
    owner = np.repeat(np.arange(len(layout.first)), layout.halves)
    places = np.where(means == best[owner], np.arange(len(means))[:, None], len(means))
    return best, np.minimum.reduceat(places, layout.first, axis=0), size


def _answer(net: Net, best: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(best @ net.weight + best**2 @ net.square + net.level[0], -30, 30)))


def scores(net: Net, texts: list[bytes]) -> np.ndarray:
    """Probability of the label for each text; all its bytes are read."""
    layout, sums, lengths = Layout(texts), [], []
    for data, begin, length in layout.groups():
        sums.append(_sums(_filtered(net, data)[1], begin, length))
        lengths.append(length)
    best, _, _ = _pooled(layout, np.concatenate(sums), np.concatenate(lengths))
    return _answer(net, best).astype(np.float64)


def _gradients(net: Net, texts: list[bytes], labels: np.ndarray) -> Net:
    layout = Layout(texts)
    groups = [(data, begin, length, *_filtered(net, data)) for data, begin, length in layout.groups()]
    lengths = np.concatenate([g[2] for g in groups])
    best, place, size = _pooled(layout, np.concatenate([_sums(g[4], g[1], g[2]) for g in groups]), lengths)
    error = (_answer(net, best) - labels) / len(texts)
    back = error[:, None] * (net.weight + 2 * best * net.square) / size[place]
    halves, column = np.zeros((len(lengths) + 1, FILTERS), np.float32), np.broadcast_to(np.arange(FILTERS), place.shape)
    np.add.at(halves, (place, column), back)
    is_last = np.isin(place, layout.first + np.array(layout.halves) - 1)
    np.add.at(halves, (np.where(is_last, len(lengths), place + 1), column), back)
    grads = [np.zeros_like(x) for x in net]
    at = 0
    for data, begin, length, steps, active in groups:
        flow = np.zeros_like(active)
        rows = np.repeat(np.arange(len(length)), length)
        where = np.repeat(begin, length) + np.arange(len(rows)) - np.repeat(np.cumsum(length) - length, length)
        flow[where] = halves[at + rows]
        at += len(length)
        flow *= active > 0
        grads[1] += steps[:-1].T @ flow
        grads[2] += steps[1:].T @ flow
        grads[3] += flow.sum(0)
        to_bytes = np.zeros_like(steps)
        to_bytes[:-1] += flow @ net.now.T
        to_bytes[1:] += flow @ net.next.T
        flat = to_bytes.reshape(-1, VECTOR)
        for d in range(VECTOR):
            grads[0][:, d] += np.bincount(data, flat[:, d], 256).astype(np.float32)
    grads[4] += best.T @ error
    grads[5] += best.T**2 @ error
    grads[6] += error.sum()
    return Net(*grads)


def fit(texts: list[bytes], labels: list[int], epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Net:
    """Train on the given texts; the same rows in the same order give the same net. No rows give one that answers 0.5."""
    draw = np.random.default_rng(seed)
    fan = (2 / (2 * STEP * VECTOR)) ** 0.5
    shapes = [((256, VECTOR), 1.0), ((STEP * VECTOR, FILTERS), fan), ((STEP * VECTOR, FILTERS), fan)]
    start = [draw.normal(0, scale, shape).astype(np.float32) for shape, scale in shapes]
    net = Net(*start, *[np.zeros(FILTERS, np.float32) for _ in range(3)], np.zeros(1, np.float32))
    wanted = np.array(labels, np.float32)
    first, second, step = [np.zeros_like(x) for x in net], [np.zeros_like(x) for x in net], 0
    if texts:  # the average label is the first answer
        share = float(np.clip(wanted.mean(), 0.01, 0.99))
        net = net._replace(level=np.array([np.log(share / (1 - share))], np.float32), weight=draw.normal(0, 0.1, FILTERS).astype(np.float32))
    for epoch in range(epochs if texts else 0):
        order = draw.permutation(len(texts))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            grads = _gradients(net, [texts[i] for i in own], wanted[own])
            step += 1
            pace = rate * (1 - epoch / epochs) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            updated = []
            for k, (value, grad) in enumerate(zip(net, grads, strict=True)):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                updated.append((value - pace * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32))
            net = Net(*updated)
    return net


def learn(docs: DataFrame, labels: DataFrame, label: str, sample_rows: int = 2500, sample_bytes: int = 65_536) -> Net:
    """Fit on at most ``sample_rows`` labelled documents of at most ``sample_bytes`` bytes, picked by a hash of their ids.

    The sample, bounded by these two parameters, is the only thing that comes to the driver. Null
    labels and texts teach nothing; of several labels of one id the lowest counts.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("label"))
    fitting = docs.filter(F.octet_length("text") <= sample_bytes).select("doc_id", "text")
    picked = known.join(fitting.select("doc_id").distinct(), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = fitting.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fit([r["text"].encode("utf-8", "surrogatepass") for r in rows], [int(r["label"]) for r in rows])


def scored(docs: DataFrame, net: Net, keep: list[str] | None = None) -> DataFrame:
    """Add ``score``, the probability of the label, for each whole text; null reads as empty."""

    def fn(piece: pa.RecordBatch) -> dict[str, list]:
        return {"score": scores(net, [(t or "").encode("utf-8", "surrogatepass") for t in piece.column("text").to_pylist()]).tolist()}

    return mapped(docs, "text", SCORE, fn, keep=keep, rows=512, size=2 << 20)
