"""Licences in texts, by a positional index of rare licence words.

Each template's words are posted with their positions. How rare a licence word is, is counted over all documents. Of a
text's licence words those of highest IDF are looked up first, up to RARE for a template; each place gives the template's
start relative to it, and a template is a candidate where enough of its rare words agree on a start, give or take `slack`
words. A candidate holds if all its key phrases stand there word for word and enough of its words do: its score is that
share. Only the templates' words are known to tasks, and counts for them are all that comes to the driver.

Texts are read whole, and twice: once for the counts. Null texts are empty, rows are judged each by itself (repeated and
null ids make no difference), other columns don't matter; empty tables give no rows. Bytes that aren't UTF-8 are read as
U+FFFD, which is a letter of a word like all characters beyond ASCII.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, portions, utf8, word_arrays

# Phrases and labels of the base rule, and short public licence notices with the label and key phrases of each.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES: list[tuple[str, str, tuple[str, ...]]] = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        ("in compliance with the license", "as is basis"),
    ),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ("gnu general public license", "free software foundation"),
    ),
    (
        "gpl",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        ("in the hope that it will be useful", "gnu general public license"),
    ),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license",)),
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Licensed under the MIT License", ("mit license",)),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ("permission is hereby granted free of charge",),
    ),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("mozilla public license",)),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ("free and unencumbered software",)),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
]

#: Words of a template that are looked up, the rarest; the share of them that must agree on its start; the share of its words that must be there.
RARE, AGREED, COVERED = 8, 0.7, 0.8
#: Score of a text that only names a licence.
NAMED = 0.5

_OUT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label string, first long, last long, score double>>"

#: Bytes between words: all ASCII but letters and digits.
BETWEEN = np.ones(256, dtype=bool)
BETWEEN[128:] = False
for _a, _b in (b"09", b"AZ", b"az"):
    BETWEEN[_a : _b + 1] = False


def words_of(text: str) -> list[bytes]:
    data, bounds, _ = word_arrays([text.encode()], BETWEEN)
    return [data[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


class Index:
    """Templates as numbers of words with their postings, and the rarest words of each by IDF."""

    def __init__(self, templates, base: dict[str, str]):
        self.base = [([*words_of(p)], label) for p, label in base.items()]
        self.templates = [(label, words_of(text), [words_of(k) for k in keys]) for label, text, keys in templates]
        every = {w for p, _ in self.base for w in p} | {w for _, text, keys in self.templates for w in (*text, *(x for k in keys for x in k))}
        self.number = {w: k for k, w in enumerate(sorted(every))}
        numbers = lambda words: [self.number[w] for w in words]
        self.base = [(numbers(p), label) for p, label in self.base]
        self.templates = [(label, numbers(text), [numbers(k) for k in keys]) for label, text, keys in self.templates]
        self.idf = np.zeros(len(self.number))

    def learn(self, documents: int, holding: dict[bytes, int]) -> None:
        self.idf = np.array([math.log((documents + 1) / (holding.get(w, 0) + 1)) for w in sorted(self.number)])

    def postings(self, k: int) -> dict[int, list[int]]:
        """Of template k's words, the rarest first (RARE at most), the positions of each."""
        at: dict[int, list[int]] = {}
        for p, w in enumerate(self.templates[k][1]):
            at.setdefault(w, []).append(p)
        return {w: at[w] for w in sorted(at, key=lambda w: (-self.idf[w], w))[:RARE]}


def slack_of(length: int) -> int:
    """Words by which a start may be off: a few in any notice, more in a long one."""
    return 1 + length // 10


def best_match(index: Index, k: int, words: np.ndarray) -> tuple[int, float] | None:
    """Start and score of template k in a text (its words' numbers, -1 for others), the best and first one."""
    _, template, keys = index.templates[k]
    slack, postings = slack_of(len(template)), index.postings(k)
    need = math.ceil(AGREED * len(postings))
    starts, who = [], []
    for w, at in postings.items():
        places = np.flatnonzero(words == w)
        for p in at:
            starts.append(places - p)
            who.append(np.full(len(places), w))
    starts, who = np.concatenate(starts), np.concatenate(who)
    order = np.argsort(starts, kind="stable")
    starts, who = starts[order], who[order]
    ends = np.searchsorted(starts, starts + slack, side="right")
    best, wanted = None, Counter(template)
    for a in np.flatnonzero((ends - np.arange(len(starts)) >= need) & np.append(True, starts[1:] != starts[:-1])):
        if len(set(who[a : ends[a]].tolist())) < need:
            continue
        low = max(0, int(starts[a]) - slack)
        there = words[low : int(starts[a]) + len(template) + 2 * slack].tolist()
        if not all(any(there[i : i + len(key)] == key for i in range(len(there) - len(key) + 1)) for key in keys):
            continue
        score = sum(min(n, m) for w, n in wanted.items() if (m := there.count(w))) / len(template)
        if score >= COVERED and (best is None or score > best[1]):
            best = (max(0, int(starts[a])), score)
            if score == 1.0:
                break  # nothing is better
    return best


def _places(words: np.ndarray, of: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Where a phrase stands within one text."""
    at = np.flatnonzero(words == phrase[0])
    at = at[at + len(phrase) <= len(words)]
    for j in range(1, len(phrase)):
        at = at[words[at + j] == phrase[j]]
    return at[of[at] == of[at + len(phrase) - 1]]


def _numbers(index: Index, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Numbers of all words of texts (-1: in no template), where each text's words start, and the licence words found."""
    data, bounds, first = word_arrays(texts, BETWEEN)
    if len(bounds) == 1:
        return np.zeros(0, dtype=np.int64), first, []
    distinct, ids = numbered(data, bounds)
    of = np.array([index.number.get(w, -1) for w in distinct], dtype=np.int64)
    return of[ids], first, distinct


def _judged(index: Index, texts: list[bytes]):
    words, first, _ = _numbers(index, texts)
    of = np.repeat(np.arange(len(texts)), np.diff(first))
    named: dict[int, list[tuple[np.ndarray, str]]] = {}
    for phrase, label in index.base:
        at = _places(words, of, phrase)
        for t in np.unique(of[at]).tolist():
            named.setdefault(t, []).append((at[of[at] == t] - first[t], label))
    likely: dict[int, list[int]] = {}
    for k, (_, _, keys) in enumerate(index.templates):  # without its key phrases no template can hold
        for t in set.intersection(*(set(of[_places(words, of, key)].tolist()) for key in keys)):
            likely.setdefault(t, []).append(k)
    for t in range(len(texts)):
        matches = [(index.templates[k][0], m[0], m[0] + len(index.templates[k][1]) - 1, m[1]) for k in likely.get(t, ()) if (m := best_match(index, k, words[first[t] : first[t + 1]]))]
        base = named.get(t, [])
        labels = {label for _, label in base}
        starts = np.concatenate([at for at, _ in base]) if base else None
        score = max([m[3] for m in matches] + [NAMED if base else 0.0])
        yield (
            int(first[t + 1] - first[t]), 0 if starts is None else len(starts), None if starts is None else int(starts.min()), None if starts is None else int(starts.max()),
            ",".join(sorted(labels)), ",".join(sorted(labels | {m[0] for m in matches})), score, [dict(zip(("label", "first", "last", "score"), m, strict=True)) for m in matches],
        )


def licences(documents: DataFrame, templates=TEMPLATES, base: dict[str, str] = BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_base (places of the base phrases), first_word and last_word (their first and last start), base_labels, labels, score, matches (label, first and last word, score; the best of each template)."""
    spark, index = documents.sparkSession, Index(templates, base)

    def count(batches):
        holding, n = Counter(), 0
        for batch in batches:
            for texts in portions(utf8(batch.column(0))):
                words, first, _ = _numbers(index, texts)
                n += len(texts)
                of = np.repeat(np.arange(len(texts)), np.diff(first))
                holding.update((np.unique(of[words >= 0] * len(index.number) + words[words >= 0]) % len(index.number)).tolist())
        names = sorted(index.number)
        yield pa.RecordBatch.from_arrays([pa.array([*(names[k] for k in holding), b""], pa.binary()), pa.array([*holding.values(), n], pa.int64())], ["word", "n"])

    counts = documents.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    holding = {bytes(w): n for w, n in counts.collect()}  # the templates' words
    index.learn(holding.pop(b"", 0), holding)
    told = spark.sparkContext.broadcast(index)

    def judge(batches):
        names = [c.split()[0] for c in _OUT.split(", ")[:7]] + ["matches"]
        match = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), match]
        for batch in batches:
            at = 0
            for texts in portions(utf8(batch.column(1))):
                rows = list(_judged(told.value, texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]], [id_col, *names])
                at += len(texts)

    rows = documents.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(judge, f"`{id_col}` {documents.schema[id_col].dataType.simpleString()}, {_OUT}")
