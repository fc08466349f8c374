"""Language of texts by letter trigrams learned from labelled texts.

Trigrams lie inside a word with a blank on either side and hold a letter in the middle. A profile holds, for
each language, what each trigram adds to the log-likelihood beyond a trigram the language does not know, and,
under the empty trigram, what every letter costs. Weights are whole thousandths, so that sums do not depend on
the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftbook.session import stage

SHORTEST = 20
WEIGHT = 1000
SLICE_BYTES = 1 << 20
TABLE = 1 << 24
BLOCK = 1 << 20


def _letters(text: Column) -> Column:
    """Runs of letters, lower-cased, with one blank between them and blanks around."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\PL+", " "), F.lit(" "))


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows with about ``SLICE_BYTES`` of a string column, one row at least."""
    part = (np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)) - 1) // SLICE_BYTES
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
    for a, b in zip(first, np.append(first[1:], len(part)), strict=True):
        yield batch.slice(a, b - a)


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all trigrams with a letter in the middle, and the number of those before each text and behind all.

    Texts begin and end with a blank, so none lies in two of them.
    """
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    middle = np.flatnonzero(points[1:-1] != ord(" "))
    ends = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))
    return np.stack([points[middle + i] for i in range(3)]), np.append(0, np.searchsorted(middle, ends - 1))


def _keys(trigrams: np.ndarray) -> np.ndarray:
    """Three code points as one number."""
    return trigrams[0].astype(np.int64) << 42 | trigrams[1].astype(np.int64) << 21 | trigrams[2]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of each slice."""
    for batch in batches:
        for piece in _slices(batch, "body"):
            points, before = _trigrams(piece.column("body"))
            keys, names = _keys(points), piece.column("lang").dictionary_encode()
            of_text = names.indices.to_numpy(zero_copy_only=False)
            of_gram = np.repeat(of_text, np.diff(before))
            for number, name in enumerate(names.dictionary.to_pylist()):
                found, n = np.unique(keys[of_gram == number], return_counts=True)
                joined = np.stack([found >> 42, found >> 21 & 0x1FFFFF, found & 0x1FFFFF], axis=1).astype(np.uint32).tobytes().decode("utf-32-le")
                grams = [joined[i : i + 3] for i in range(0, len(joined), 3)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(n, pa.int64())], ["lang", "gram", "n"])


def learn(texts: DataFrame, text: str, label: str) -> DataFrame:
    """Profile rows (gram, lang, weight) of every label; rows without label or letters teach nothing.

    Trigrams are counted in each slice of texts, so few rows leave a task.
    """
    bodies = texts.filter(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("lang"), _letters(F.col(text)).alias("body"))
    grams = bodies.mapInArrow(_counted, "lang string, gram string, n long")
    grams = stage(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    known = grams.agg(F.countDistinct("gram").alias("_known"))
    totals = grams.groupBy("lang").agg(F.sum("n").alias("_all")).join(known).select("lang", (F.col("_all") + F.col("_known")).alias("_mass"))
    unknown = F.round(-WEIGHT * F.log("_mass")).cast("long")
    seen = F.round(WEIGHT * F.log((F.col("n") + 1) / F.col("_mass"))).cast("long")
    rows = grams.join(totals, "lang").select("gram", "lang", (seen - unknown).alias("weight"))
    return stage(rows.unionByName(totals.select(F.lit("").alias("gram"), "lang", unknown.alias("weight"))), "profiles")


def detect(texts: DataFrame, key: str, text: str, profiles: DataFrame, name: str = "detected_lang", shortest: int = SHORTEST, block: int = BLOCK) -> DataFrame:
    """Rows (key, name): the most likely language of each key, the earlier name if two are as likely.

    Texts of one key are judged together, those without a key too. 'unknown' is what has at most
    ``shortest`` characters, no letters, or no profile to compare with. A text leaves its task as one sum for
    each language. Profiles go out in blocks of about ``block`` rows with a pass over the texts for each; sums
    over trigrams add up over the blocks.
    """
    languages = profiles.select("lang").distinct().orderBy("lang")
    names = [r["lang"] for r in languages.collect()]
    blocks = max(-(-profiles.count() // block), 1)
    kind = texts.schema[key].dataType.simpleString()
    rows = texts.select(F.col(key).alias("_key"), F.length(F.trim(F.coalesce(F.col(text), F.lit("")))).cast("long").alias("_chars"), _letters(F.col(text)).alias("body"))
    parts = []
    for number in range(blocks):
        own = profiles.filter(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == number).select("gram", "lang", "weight")
        sent = profiles.sparkSession.sparkContext.broadcast(_Profile.of(own.toArrow(), names))
        parts.append(rows.mapInArrow(_scored(sent, names, number == 0), f"_key {kind}, lang string, _score long, _chars long, _letters long"))
    sums = reduce(DataFrame.unionByName, parts).groupBy("_key", "lang").agg(*[F.sum(c).alias(c) for c in ("_score", "_chars", "_letters")])
    ballot = F.when(F.col("lang").isNotNull(), F.struct((-F.col("_score")).alias("s"), F.col("lang").alias("l")))
    best = sums.groupBy("_key").agg(F.min(ballot).alias("_best"), F.max("_chars").alias("_chars"), F.max("_letters").alias("_letters"))
    found = F.when((F.col("_chars") > shortest) & (F.col("_letters") > 0), F.col("_best")["l"])
    return best.select(F.col("_key").alias(key), F.coalesce(found, F.lit("unknown")).alias(name))


@dataclass
class _Profile:
    """Weights of trigrams by language; trigrams are found by a table over their letters, or by search where that is large."""

    letter: np.ndarray  # number of each code point, 0 for those in no trigram
    size: int
    place: np.ndarray  # row of weights for three numbers, or the sorted keys
    weights: np.ndarray  # a row for each trigram behind one of zeros, a column for each language
    every: np.ndarray  # what every letter costs

    @classmethod
    def of(cls, table: pa.Table, names: list[str]) -> _Profile:
        grams, weight = table["gram"].to_pylist(), table["weight"].to_numpy()
        column = {name: i for i, name in enumerate(names)}
        lang = np.array([column[x] for x in table["lang"].to_pylist()], np.int64)
        whole = np.array([x == "" for x in grams], bool)
        every = np.zeros(len(names), np.int64)
        every[lang[whole]] = weight[whole]
        points = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(-1, 3).T
        keys, row = np.unique(_keys(points), return_inverse=True)
        weights = np.zeros((len(keys) + 1, len(names)), np.int64)
        weights[row + 1, lang[~whole]] = weight[~whole]
        alphabet = np.unique(points)
        letter = np.zeros(int(alphabet[-1]) + 2 if len(alphabet) else 1, np.int64)
        letter[alphabet] = np.arange(1, len(alphabet) + 1)
        size = len(alphabet) + 1
        if size**3 > TABLE:
            return cls(letter, 0, keys, weights, every)
        place = np.zeros(size**3, np.int32)
        a, b, c = letter[np.stack([keys >> 42, keys >> 21 & 0x1FFFFF, keys & 0x1FFFFF])]
        place[(a * size + b) * size + c] = np.arange(1, len(keys) + 1)
        return cls(letter, size, place, weights, every)

    def rows(self, points: np.ndarray) -> np.ndarray:
        """Row of weights of each trigram, 0 where it is unknown."""
        if self.size:
            a, b, c = self.letter[np.minimum(points, len(self.letter) - 1)]
            return self.place[(a * self.size + b) * self.size + c]
        keys = _keys(points)
        at = np.searchsorted(self.place, keys)
        return np.where(self.place[np.minimum(at, len(self.place) - 1)] == keys, at + 1, 0)


def _scored(sent, names: list[str], first: bool) -> Callable:
    """(_key, lang, _score, _chars, _letters) of each text and language; only the first block counts characters and letters."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profile: _Profile = sent.value
        for batch in batches:
            for piece in _slices(batch, "body"):
                points, before = _trigrams(piece.column("body"))
                rows, letters, n = profile.rows(points), np.diff(before), len(piece)
                once = [piece.column("_chars"), pa.array(letters)] if first else [pa.array(np.zeros(n, np.int64))] * 2
                for i, name in enumerate(names or [None]):
                    score = np.zeros(n, np.int64)
                    if names:
                        score = np.diff(np.append(0, np.cumsum(profile.weights[:, i][rows]))[before]) + letters * profile.every[i]
                    yield pa.RecordBatch.from_arrays([piece.column("_key"), pa.array([name] * n, pa.string()), pa.array(score), *once], ["_key", "lang", "_score", "_chars", "_letters"])

    return task
