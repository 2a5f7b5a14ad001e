"""Licences against plain loops: counts of the base phrases, and templates with words put in, left out or far away."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm import licences as li

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(texts):
    docs = [words(t) for t in texts]
    holding = Counter(w for d in docs for w in set(d))
    idf = lambda w: math.log((len(docs) + 1) / (holding[w] + 1))
    at = lambda d, phrase: [i for i in range(len(d)) if d[i : i + len(phrase)] == phrase]
    for d in docs:
        base = [(i, label) for phrase, label in li.BASE.items() for i in at(d, phrase.split())]
        labels, score = {x for _, x in base}, li.NAMED if base else 0.0
        for label, text, keys in li.TEMPLATES:
            t = words(text)
            slack = 1 + len(t) // 10
            rare = sorted(set(t), key=lambda w: (-idf(w), w))[: li.RARE]
            starts = sorted({i - p for w in rare for i in at(d, [w]) for p in at(t, [w])})
            for s in starts:
                agreed = [w for w in rare if any(s <= i - p <= s + slack for i in at(d, [w]) for p in at(t, [w]))]
                if len(agreed) < math.ceil(li.AGREED * len(rare)):
                    continue
                there = d[max(0, s - slack) : s + len(t) + 2 * slack]
                share = sum(min(n, there.count(w)) for w, n in Counter(t).items()) / len(t)
                if all(at(there, k.split()) for k in keys) and share >= li.COVERED:
                    labels.add(label)
                    score = max(score, share)
        yield len(d), len(base), min((i for i, _ in base), default=None), max((i for i, _ in base), default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score


def altered(rng, text):
    out = []
    for w in text.split():
        if rng.random() < 0.05:
            continue
        out.append(w)
        if rng.random() < 0.05:
            out.append(rng.choice(["also", "the", "—", "License"]))
    return " ".join(out)


def test_equals_plain_loops(spark):
    rng = random.Random(3)
    prose = ["the", "of", "work", "software", "under", "is", "Übung", "a", "cc", "by", "mit", "license", "gnu", "3"]
    texts = [None, "", " \n", "MIT License", "CC-BY", "gnu general public licence", "the Apache\nLicense, Version 2.0 " * 40]
    for _ in range(200):
        some = [" ".join(rng.choices(prose, k=rng.randrange(30)))]
        for _ in range(rng.randrange(3)):
            some += [altered(rng, rng.choice(li.TEMPLATES)[1]), " ".join(rng.choices(prose, k=rng.randrange(20)))]
        texts.append(rng.choice([". ", "\n", " "]).join(some))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"labels": F.lit(1), "n_words": F.lit("x")}).repartition(4)
    found = li.licences(df).orderBy("doc_id").drop("doc_id", "matches").collect()
    expected = list(slow(texts))
    assert [tuple(r) for r in found] == expected
    assert sum(e[5] != e[4] for e in expected) > 50


def test_every_template_is_found_and_prose_is_not(spark):
    rows = [(k, f"Some words before it. {text}. And some after.") for k, (_, text, _) in enumerate(li.TEMPLATES)]
    rows += [(100, "Ask the author for permission to use a copy of this software."), (101, "A work of the public domain; the mit campus.")]
    found = {r["doc_id"]: r for r in li.licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (label, text, _) in enumerate(li.TEMPLATES):
        assert label in found[k]["labels"].split(",") and found[k]["score"] == 1.0
        span = next(m for m in found[k]["matches"] if m["label"] == label and m["score"] == 1.0)
        assert span["last"] - span["first"] + 1 == len(words(text))
    assert found[100]["labels"] == found[101]["labels"] == ""


def test_odd_rows(spark):
    assert li.licences(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = spark.createDataFrame([(None, b"\xff\xfe MIT license \xe9"), (1, b"x"), (1, b"x")], "doc_id long, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"))
    assert sorted((r["doc_id"] or 0, r["labels"]) for r in li.licences(rows).collect()) == [(0, "mit"), (1, ""), (1, "")]
    long = "word " * 600_000 + "released under the mit license " + "word " * 10
    r = li.licences(spark.createDataFrame([(5, long)], "doc_id long, text string")).first()
    assert (r["n_words"], r["first_word"], r["labels"]) == (600_015, 600_003, "mit")
