"""Licence notices in whole texts, by a positional index of rare words; built-in expressions only."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Template(NamedTuple):
    """A notice and the phrase in it that must stand in a text, word by word."""

    label: str
    notice: str
    key: str
    base: bool = False


#: Base phrases and usual notices of public licences, as words.
TEMPLATES = (
    Template("mit", "mit license", "mit license", True),
    Template("apache", "apache license", "apache license", True),
    Template("gpl", "general public license", "general public license", True),
    Template("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license version 2 0", "mozilla public license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd 4 0"),
    Template("cc0", "dedicated to the public domain under cc0 1 0", "cc0 1 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def terms(text: str) -> Column:
    """Words of a text: A-Z in lower case; digits, letters and non-ASCII characters."""
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), _BREAKS), "")


def frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> tuple[int, dict[str, int]]:
    """Number of texts, and of texts with each word of the notices; one small row for each such word comes back."""
    known = sorted({w for t in templates for w in t.notice.split()})
    shared = F.array_intersect(terms("text"), F.array(*[F.lit(w) for w in known]))
    # every text counts once under '' so that one aggregate gives both
    rows = docs.select(F.explode(F.concat(F.array(F.lit("")), shared)).alias("word")).groupBy("word").count().collect()
    found = {r["word"]: r["count"] for r in rows}
    return found.pop("", 0), found


def _literal(value) -> str:
    if isinstance(value, str):
        return f"'{value}'"
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(map(_literal, value))})"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def scan(docs: DataFrame, keep: list[str] | None = None, templates: tuple[Template, ...] = TEMPLATES, anchors: int = 2) -> DataFrame:
    """Add n_words, base places, labels and score of each whole text.

    Each template is indexed by the rarest words of its key phrase, rarest in all texts of ``docs``.
    A text's words are looked up there; each posting gives the word at which the template's phrase
    would start, the starts of the first and second rarest words are intersected, and those where
    the whole phrase stands word by word are places. The score is the best share, weighted by
    rarity, of a found notice that stands around its phrase. Everything happens inside the row.

    Null and empty texts have no words, no labels ('') and score 0; an empty table gives no rows.
    Repeated rows are scanned one by one. ``keep`` names columns that stay; new ones replace them.
    """
    total, counts = frequencies(docs, templates)
    rarity = {w: math.log((total + 1) / (counts.get(w, 0) + 1)) + 1e-6 for t in templates for w in t.notice.split()}
    postings: list[dict[str, list[int]]] = [{} for _ in range(anchors)]  # word -> code of a start, less the word's place
    for number, t in enumerate(templates):
        words = t.key.split()
        rarest = sorted(set(words), key=lambda w: (-rarity[w], w))
        for k in range(anchors):
            word = rarest[min(k, len(rarest) - 1)]
            postings[k].setdefault(word, []).extend((number + 1 << 40) - at for at, w in enumerate(words) if w == word)

    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], terms("text").alias("_words"))
    looked_up = sorted({w for p in postings for w in p})
    hits = f"filter(transform(_words, (w, i) -> struct(w AS w, i AS i)), x -> x.w IN ({', '.join(map(_literal, looked_up))}))"
    rows = rows.withColumn("_hits", F.expr(f"CASE WHEN arrays_overlap(_words, {_literal(looked_up)}) THEN {hits} END"))
    starts = []
    for p in postings:
        table = ", ".join(f"{_literal(w)}, array({', '.join(f'{c}L' for c in codes)})" for w, codes in sorted(p.items()))
        starts.append(f"flatten(transform(_hits, h -> coalesce(transform(map({table})[h.w], c -> c + h.i), array())))")
    keys = _literal([t.key.split() for t in templates])
    number, at = f"CAST(c DIV {1 << 40} AS INT) - 1", f"c % {1 << 40}"
    # the code of a start before the text reads as one far behind it
    stands = f"{at} < size(_words) AND slice(_words, CAST({at} AS INT) + 1, size({keys}[{number}])) = {keys}[{number}]"
    found = f"filter(array_intersect({', '.join(starts)}), c -> {stands})"
    rows = rows.withColumn("_found", F.expr(f"coalesce(transform({found}, c -> struct({number} AS t, {at} AS at)), array())"))

    base = ", ".join(str(i) for i, t in enumerate(templates) if t.base)
    labels = _literal([t.label for t in templates])
    rows = rows.withColumn("_base", F.expr(f"filter(_found, x -> x.t IN ({base}))"))
    joined = "array_join(array_sort(array_distinct(transform({0}, x -> {1}[x.t]))), ',')"
    return rows.select(
        *[F.col(f"`{c}`") for c in keep], F.size("_words").cast("long").alias("n_words"), F.size("_base").cast("long").alias("n_base"),
        F.expr("array_min(transform(_base, x -> x.at))").alias("first_word"), F.expr("array_max(transform(_base, x -> x.at))").alias("last_word"),
        F.expr(joined.format("_base", labels)).alias("base_labels"), F.expr(joined.format("_found", labels)).alias("labels"),
        F.expr(f"round(coalesce(array_max(transform(_found, x -> {_share(templates, rarity)})), 0D), 6)").alias("score"),
    )


def _share(templates: tuple[Template, ...], rarity: dict[str, float]) -> str:
    """SQL: weight of the notice's words that stand at their place, of all its words."""
    notices = []
    for t in templates:
        words, key = t.notice.split(), t.key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        whole = sum(rarity[w] for w in words)
        notices.append("array(" + ", ".join(f"struct({_literal(w)} AS w, {i - at}L AS off, {rarity[w] / whole!r}D AS part)" for i, w in enumerate(words)) + ")")
    own = f"array({', '.join(notices)})[x.t]"
    return f"aggregate({own}, 0D, (a, n) -> a + CASE WHEN get(_words, CAST(x.at + n.off AS INT)) = n.w THEN n.part ELSE 0D END)"
