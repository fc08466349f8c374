"""Language identification with hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

import functools
import hashlib
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftbook.llm.batches import mapped

#: Length of all vectors; three letters make an n-gram.
DIMENSIONS = 1024
#: Code points read at a time from one text.
CHUNK = 1 << 19

LANGUAGE = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


@functools.cache
def letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 for what is no letter."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        if unicodedata.category(c)[0] == "L":
            low = c.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


class Profiles:
    """Bundles of n-gram vectors.

    A letter has a random vector of +1 and -1, drawn from its code point. The vector of an n-gram is
    the product of its letters' vectors, each rotated by its place (binding), and a text is the sum of
    the vectors of its n-grams (bundling). Runs of other characters count as one blank.
    """

    #: N-gram and letter vectors remembered at a time; they go with the object, that is at the end of a task.
    LIMIT, LETTERS = 60_000, 20_000
    #: N-gram vectors multiplied at a time.
    BLOCK = 2048

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions, self.known, self.drawn = dimensions, {}, {}
        # memory is only taken by rows that are filled, and goes back as a whole
        self.table = np.empty((self.LIMIT, dimensions), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.drawn:
            if len(self.drawn) >= self.LETTERS:
                self.drawn.clear()
            seed = hashlib.blake2b(f"letter {code}".encode(), digest_size=8).digest()
            self.drawn[code] = np.random.default_rng(int.from_bytes(seed, "little")).integers(0, 2, self.dimensions).astype(np.int8) * np.int8(2) - np.int8(1)
        return self.drawn[code]

    def vectors(self, codes: list[int]) -> np.ndarray:
        """A row for each of at most ``LIMIT`` different n-grams."""
        new = [code for code in codes if code not in self.known]
        if len(self.known) + len(new) > self.LIMIT:
            self.known.clear()
            new = codes
        for code in new:
            a, b, c = code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF
            self.known[code] = at = len(self.known)
            self.table[at] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
        return self.table[[self.known[code] for code in codes]].astype(np.float32)

    @staticmethod
    def grams(text: str) -> tuple[np.ndarray, bool]:
        """The text's trigrams as packed code points, and whether it has a letter. Texts start and end with a blank."""
        parts, carry, any_letter = [], np.zeros(1, np.int64), False
        for at in range(0, len(text), CHUNK):
            codes = letters()[np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
            any_letter |= bool(codes.any())
            codes = np.concatenate([carry, codes])
            blank = codes == 0
            codes = codes[~(blank & np.concatenate([[False], blank[:-1]]))]
            parts.append((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:])
            carry = codes[-2:]
        tail = carry if carry[-1] == 0 else np.concatenate([carry, [0]])
        if len(tail) == 3:
            parts.append((tail[:-2] << 42) | (tail[1:-1] << 21) | tail[2:])
        return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), any_letter

    def bundles(self, texts: list[str | None], block: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """A bundle for each text, and whether it has letters."""
        out, lettered = np.zeros((len(texts), self.dimensions), np.float32), np.zeros(len(texts), bool)
        for start in range(0, len(texts), block):
            rows, codes = [], []
            for i, text in enumerate(texts[start : start + block]):
                own, lettered[start + i] = self.grams(text or "")
                kinds, counts = _counted(own)
                rows.append((kinds, counts))
                codes.append(kinds)
            kinds = np.unique(np.concatenate(codes))
            for low in range(0, len(kinds), self.BLOCK):
                some = kinds[low : low + self.BLOCK]
                matrix = np.zeros((len(rows), len(some)), np.float32)
                for i, (own, counts) in enumerate(rows):
                    a, b = np.searchsorted(own, [some[0], some[-1] + 1])
                    matrix[i, np.searchsorted(some, own[a:b])] = counts[a:b]
                out[start : start + len(rows)] += matrix @ self.vectors(some.tolist())
        return out, lettered


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ordered = np.sort(codes)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)])
    return ordered[first], np.diff(np.append(first, len(ordered)))


def learn(docs: DataFrame, dimensions: int = DIMENSIONS, max_languages: int = 1000) -> dict[str, np.ndarray]:
    """Prototype of each language: the sum of the unit bundles of all given rows (``text``, ``lang``).

    Rows with a null ``lang`` or no letters teach nothing. Tasks sum their own rows, the sums of all
    tasks are added by Spark, number by number, and one vector for each language comes back. With
    more than ``max_languages`` codes, those with the most documents are learned.
    """

    def task(batches):
        profiles, sums, rows = Profiles(dimensions), {}, {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for at in range(0, len(texts), 64):
                bundles, lettered = profiles.bundles(texts[at : at + 64])
                bundles /= np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-9)
                for lang in {x for x, ok in zip(langs[at : at + 64], lettered, strict=True) if ok}:
                    own = [i for i, x in enumerate(langs[at : at + 64]) if x == lang and lettered[i]]
                    sums[lang] = sums.get(lang, 0) + bundles[own].astype(np.float64).sum(0)
                    rows[lang] = rows.get(lang, 0) + len(own)
        for lang, vector in sums.items():
            # fixed point, so that the order of addition does not matter
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([rows[lang]]), pa.array([np.rint(vector * 1e6).astype(np.int64)])], ["lang", "n", "vector"]
            )

    parts = docs.filter("lang IS NOT NULL").select("text", "lang").mapInArrow(task, "lang string, n long, vector array<long>")
    cells = parts.select("lang", "n", F.posexplode("vector").alias("at", "value")).groupBy("lang", "at").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
    whole = cells.groupBy("lang").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "value"))).alias("cells"))
    top = whole.orderBy(F.desc("n"), "lang").limit(max_languages).select("lang", "cells.value").collect()
    return {r["lang"]: np.array(r["value"], np.float64) for r in top}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: list[str] | None = None, unknown: str = "und") -> DataFrame:
    """Language of each whole ``text``: the prototype with the largest cosine, which is the score (0 at least).

    Null texts, texts without letters and all texts if nothing was learned are ``unknown`` with
    score 0. Equal cosines go to the first code in sorted order. Long texts are read in chunks.
    """
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] / max(np.linalg.norm(prototypes[n]), 1e-9) for n in names], np.float32)
    profiles: list[Profiles] = []

    def fn(piece: pa.RecordBatch) -> dict[str, list]:
        if not profiles:
            profiles.append(Profiles(matrix.shape[1] if len(names) else DIMENSIONS))
        texts = piece.column("text").to_pylist()
        if not names:
            return {"lang_pred": [unknown] * len(texts), "score": [0.0] * len(texts)}
        bundles, lettered = profiles[0].bundles(texts)
        cosines = bundles @ matrix.T / np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-9)
        best = cosines.argmax(1)
        scores = np.clip(cosines[np.arange(len(texts)), best], 0, 1)
        return {
            "lang_pred": [names[b] if ok else unknown for b, ok in zip(best, lettered, strict=True)],
            "score": [float(s) if ok else 0.0 for s, ok in zip(scores, lettered, strict=True)],
        }

    return mapped(docs, "text", LANGUAGE, fn, keep=keep, rows=512, size=2 << 20)
