"""Licence scans by a positional index of rare words (operator 12).

A template is the wording of a licence or of its notice; the phrases in brackets are mandatory. Each template is
indexed under the rarest word of its mandatory phrases, by document frequency over all scanned texts (the highest
IDF; ties to the smaller word), with the word's place in the template. A text looks up the indexed words that it has;
each gives a relative position, the place where the template would start. There the whole first phrase must
stand, and every other one within ``SLACK`` words of its own place (names and years between phrases move them). A
template whose rarest word no text has is in no text. So nothing is lost: the index names every place
where all mandatory phrases stand.

One pass counts the words of the templates, one looks them up; both stay within a row, without a shuffle of
texts. Words are cut in Arrow batches, four times as fast here as by Spark's own functions. The counts are as many as the templates have words, which bounds what the driver holds.

Null and empty texts have no words and no labels, repeated rows are scanned each by itself, an empty table
gives an empty one. Very long texts are scanned whole; memory grows with the longest text. Result columns come
from the operator alone, so other columns cannot clash; ``keys`` that are named like them get an underscore.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, free_names, lower_ascii

#: Words are runs of ASCII letters and digits and of all beyond ASCII.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(WORDS)
#: Words by which a phrase may stand off its place relative to the first phrase.
SLACK = 12


@dataclass(frozen=True)
class Template:
    label: str
    wording: str
    base: bool = False

    @cached_property
    def words(self) -> list[str]:
        return re.findall(WORDS, self.wording)

    @cached_property
    def phrases(self) -> list[tuple[int, list[str]]]:
        """(place, words) of each mandatory phrase."""
        out, at = [], 0
        for part in re.split(r"(\[[^\]]*\])", self.wording):
            words = re.findall(WORDS, part)
            if part.startswith("["):
                out.append((at, words))
            at += len(words)
        return out


# Phrases of public licences, lower case.
BASE = (
    Template("gpl", "[gnu general public license]", True),
    Template("apache", "[apache license]", True),
    Template("cc-by", "[cc by]", True),
    Template("mit", "[mit license]", True),
)
NOTICES = (
    Template("0bsd", "[permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted] the [software is provided as is and the author disclaims all warranties]"),
    Template("agpl", "[gnu affero general public license]"),
    Template("apache-2.0", "licensed under the [apache license version 2 0]"),
    Template("apache-2.0", "[you may not use this file except in compliance with the license] you may [obtain a copy of the license at]"),
    Template("artistic", "the [artistic license 2 0]"),
    Template("bsd", "[redistribution and use in source and binary forms with or without modification are permitted] provided that the [following conditions are met]"),
    Template("bsd-3-clause", "neither the [name of] the copyright holder nor the names of its [contributors may be used to endorse or promote products derived from this software] without specific prior written permission"),
    Template("bsl-1.0", "[boost software license version 1 0]"),
    Template("cc0-1.0", "[cc0 1 0 universal]"),
    Template("cc-by", "licensed under a [creative commons attribution] 4 0 [international license]"),
    Template("cc-by-nc", "[cc by nc]"),
    Template("cc-by-nc", "licensed under a [creative commons attribution noncommercial] 4 0 international license"),
    Template("cc-by-nd", "[cc by nd]"),
    Template("cc-by-sa", "[cc by sa]"),
    Template("cc-by-sa", "licensed under a [creative commons attribution sharealike] 4 0 international license"),
    Template("epl", "[eclipse public license]"),
    Template("gpl", "this program is [free software you can redistribute it and or modify it under the terms of the gnu general public license] as [published by the free software foundation]"),
    Template("gpl-2.0", "[gnu general public license version 2]"),
    Template("gpl-3.0", "[gnu general public license version 3]"),
    Template("isc", "[permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted]"),
    Template("lgpl", "[gnu lesser general public license]"),
    Template("mit", "[permission is hereby granted free of charge to any person obtaining a copy] of this [software and associated documentation files] the software [to deal in the software without restriction]"),
    Template("mpl-2.0", "this source code form is [subject to the terms of the mozilla public license v 2 0]"),
    Template("spdx", "[spdx license identifier]"),
    Template("unlicense", "this is [free and unencumbered software released into the public domain]"),
    Template("zlib", "[this software is provided as is without any express or implied warranty] in no event will the [authors be held liable for any damages]"),
)


def words_of(text: str | None) -> list[str]:
    """The words of a text with A-Z in lower case."""
    return _WORD.findall(lower_ascii(text)) if text else []


def document_counts(df: DataFrame, text: Column, words: list[str]) -> dict[str, int]:
    """In how many texts each of ``words`` stands."""
    vocabulary = frozenset(words)

    @F.pandas_udf("array<string>")
    def present(texts: pd.Series) -> pd.Series:
        return pd.Series([list(vocabulary.intersection(words_of(t))) for t in texts])

    seen = df.select(F.explode(present(text)).alias("word")).groupBy("word").count()
    return {r.word: r["count"] for r in seen.collect()}


def _postings(templates: tuple[Template, ...], counts: dict[str, int]) -> dict[str, list[tuple[int, int, int]]]:
    """For each indexed word its templates: number, the word's place, and the reach of places where the template may start."""
    out: dict[str, list[tuple[int, int, int]]] = {}
    for n, t in enumerate(templates):
        _, word, k, at = min((counts.get(w, 0), w, k, at + j) for k, (at, words) in enumerate(t.phrases) for j, w in enumerate(words))
        if counts.get(word, 0):
            out.setdefault(word, []).append((n, at, SLACK if k else 0))
    return out


def _stands(words: list[str], start: int, t: Template) -> bool:
    """Whether every mandatory phrase of a template that starts at ``start`` has its place there."""
    for k, (at, phrase) in enumerate(t.phrases):
        slack, size = SLACK if k else 0, len(phrase)
        if not any(words[x : x + size] == phrase for x in range(max(0, start + at - slack), start + at + slack + 1)):
            return False
    return True


def _places(words: list[str], templates: tuple[Template, ...], index: dict[str, list[tuple[int, int, int]]]) -> list[tuple[str, bool, int, float]]:
    """(label, base, start, share) of each template found, by the relative places of the indexed words."""
    near = {(n, i - at + d) for i, w in enumerate(words) if w in index for n, at, reach in index[w] for d in range(-reach, reach + 1)}
    out = []
    for n, start in sorted(near):
        t = templates[n]
        if _stands(words, start, t):
            same = sum(words[start + j] == w for j, w in enumerate(t.words) if 0 <= start + j < len(words))
            out.append((t.label, t.base, start, same / len(t.words)))
    return out


def scan(df: DataFrame, keys: list[str], text: Column, templates: tuple[Template, ...] = BASE + NOTICES) -> DataFrame:
    """``keys``, n_words, places (label, base, start, share) of every template found, n_base, first_word, last_word, base_labels, labels, score.

    ``start`` is the word, from 0, with which the template would begin; ``share`` the part of its words that stand where it
    has them from there; ``score`` the largest share, 0 if none is found.
    """
    index = _postings(templates, document_counts(df, text, sorted({w for t in templates for _, ws in t.phrases for w in ws})))

    @F.pandas_udf("struct<n_words:long,places:array<struct<label:string,base:boolean,start:long,share:double>>>")
    def look_up(texts: pd.Series) -> pd.DataFrame:
        counts, found = [], []
        for t in texts:
            words = words_of(t)
            counts.append(len(words))
            found.append([dict(zip(("label", "base", "start", "share"), p)) for p in _places(words, templates, index)])
        return pd.DataFrame({"n_words": counts, "places": found})

    names = free_names(keys, ["n_words", "places", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
    own = [F.col(f"`{n}`") for n in names]
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keys, names)], look_up(text).alias("_x")).select(*own, "_x.*")
    rows = rows.withColumn("_base", F.filter("places", lambda p: p["base"]))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    starts = F.transform("_base", lambda p: p["start"])
    return rows.select(
        *own, "n_words", "places", F.size("_base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined("_base").alias("base_labels"), joined("places").alias("labels"), F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )


def oracle_sql() -> str:
    """The same places by joins over all words of all texts, without an index."""
    every = BASE + NOTICES
    quoted = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).lower() for x in r) + ")" for r in rows)
    phrases = [(n, k, at, SLACK if k else 0, len(ws), j, w) for n, t in enumerate(every) for k, (at, ws) in enumerate(t.phrases) for j, w in enumerate(ws)]
    return rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS w FROM documents),
    tok AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM d),
    template(t, label, base, n, phrases) AS (VALUES {quoted([(n, t.label, t.base, len(t.words), len(t.phrases)) for n, t in enumerate(every)])}),
    wording(t, j, w) AS (VALUES {quoted([(n, j, w) for n, t in enumerate(every) for j, w in enumerate(t.words)])}),
    phrase(t, k, pos, slack, len, j, w) AS (VALUES {quoted(phrases)}),
    stands AS (SELECT doc_id, t, k, pos, slack, i - j AS s FROM tok JOIN phrase USING (w) GROUP BY doc_id, t, k, pos, slack, len, i - j HAVING count(*) = len),
    first AS (SELECT doc_id, t, s - pos AS o FROM stands WHERE k = 0),
    found AS (SELECT f.doc_id, f.t, f.o FROM first f JOIN stands p ON p.doc_id = f.doc_id AND p.t = f.t AND abs(p.s - p.pos - f.o) <= p.slack JOIN template m ON m.t = f.t
              GROUP BY f.doc_id, f.t, f.o, m.phrases HAVING count(DISTINCT p.k) = m.phrases),
    place AS (SELECT f.doc_id, f.t, f.o, count(*) AS same FROM found f JOIN wording x ON x.t = f.t JOIN tok ON tok.doc_id = f.doc_id AND tok.i = f.o + x.j AND tok.w = x.w GROUP BY ALL),
    sums AS (SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(o) FILTER (WHERE base) AS first_word, max(o) FILTER (WHERE base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(same / n) AS score
             FROM place JOIN template USING (t) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
           coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN sums USING (doc_id)"""
