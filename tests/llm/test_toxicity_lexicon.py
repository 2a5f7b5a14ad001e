"""What copies of one text can and can't do to the learned lexicon."""

import numpy as np

from tests.llm.test_operators import toxicity


def texts(copies, change=0.0):
    """300 varied toxic texts and as many others; one toxic text of many strange words in `copies` copies, some of their words changed."""
    rng = np.random.default_rng(7)
    words = [f"plain{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    say = lambda n: list(rng.choice(words, n))
    rows = [(" ".join([*say(6), "grubbler", *say(6)]), 1) for _ in range(300)] + [(" ".join(say(13)), 0) for _ in range(300)]
    copied = ["alpha", "grubbler", "beta", *[f"{chr(97 + k % 26)}qq{chr(97 + k // 26)}" for k in range(60)]]
    for _ in range(copies):
        rows.append((" ".join(w if rng.random() >= change else str(rng.choice(words)) for w in copied), 1))
    return rows


def learned(spark, rows):
    grammar = toxicity.seed_grammar()
    toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, label int").repartition(4), grammar)
    return grammar


def test_a_copied_text_hides_no_word(spark):
    for copies, change in ((0, 0.0), (2000, 0.0), (2000, 0.02)):
        grammar = learned(spark, texts(copies, change))
        read = toxicity._reader(grammar)
        assert read(["grubbler"])["grubbler"][0] == "insult", (copies, change)
        assert not any("qq" in w for w in [*grammar.words, *grammar.starts]), (copies, change)


def test_short_beginnings_go_at_every_size():
    for n in (10, 3000):
        words = [f"{k:08d}"[::-1].translate(str.maketrans("0123456789", "abcdefghij")) for k in range(n)]
        starts = {}
        for w in words:
            for k in toxicity.PREFIXES:
                starts[w[:k]] = starts.get(w[:k], 0) + 10
        assert set(toxicity.longest_starts(starts)) >= set(words)
        assert all(sum(x == w[: len(x)] for w in words) > 1 for x in toxicity.longest_starts(starts) if len(x) < 8)
