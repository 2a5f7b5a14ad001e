"""Collocations against a plain count of all phrases, by one wave and by two, with odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import collocations as co

PIECES, WORDS = re.compile(r"[.,;:!?\n\x0b\x0c\r]"), re.compile(r"[^ \t]+")


def slow(rows, most, least, longest=5):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in PIECES.split(low):
            words = WORDS.findall(piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    candidates = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    inside = Counter()
    for (lang, p), a in candidates.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                inside[lang, p[i : i + m]] = max(inside[lang, p[i : i + m]], a)
    out = []
    for lang in n:
        told = []
        for (of, p), a in candidates.items():
            if of == lang and inside[lang, p] < a:
                score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
                told.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(told)[:most], 1)]
    return sorted(out)


def texts(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["É", "ÀB", "new", "york", "City"]
    rows = []
    for k in range(400):
        some = rng.choices(words, [1 / (1 + j) for j in range(len(words))], k=rng.randrange(60))
        for phrase in ("new york city hall now", "new york", "a b c d e f", "x x x x x x x"):
            if rng.random() < 0.4:
                some[len(some) // 2 : len(some) // 2] = phrase.split()
        rows.append((rng.choice(["en", "en", "en", "de", None]), rng.choice([" ", "\t", "  "]).join(some).replace("w3 ", rng.choice(["w3, ", "w3\n", "w3 "]))))
    return rows


@pytest.mark.parametrize(("most", "least", "share"), [(2000, 5, 0.125), (3, 5, 0.02), (12, 20, 0.9)])
def test_equals_counting_all_phrases(spark, most, least, share):
    rows = [*texts(most), ("en", None), ("en", ""), (None, " \t\n"), *[("fr", "lone pair")] * 30]
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("phrase", F.lit(1)).withColumn("n", F.lit("x")).repartition(5)
    found = sorted(map(tuple, co.collocations(docs, most, least, first_share=share).collect()))
    assert found == slow(rows, most, least)


def test_more_than_64_bits_and_ties(spark):
    """Scores stay exact where a product passes 64 bits; a full bitmap lets too much through and changes nothing."""
    rows = [("en", "p q")] * 40 + [("en", "r s")] * 40 + [("en", "t u v")] * 40
    docs = spark.createDataFrame(rows, "lang string, text string")
    old, co.MOST_BITS = co.MOST_BITS, 15
    try:
        assert sorted(map(tuple, co.collocations(docs, 2, 10).collect())) == slow(rows, 2, 10)
    finally:
        co.MOST_BITS = old
    big = spark.createDataFrame([(3 * 10**13, 9 * 10**14, 4 * 10**13, 5 * 10**13)], "a long, total long, l long, r long")
    score = big.selectExpr("(cast(1000 * a as decimal(20, 0)) * cast(total as decimal(18, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0))) as s").first()["s"]
    assert score == 1000 * 3 * 10**13 * 9 * 10**14 // (4 * 10**13 * 5 * 10**13)


def test_nothing(spark):
    assert co.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert co.collocations(spark.createDataFrame([("en", None)], "lang string, text string")).count() == 0
