"""The prefix trie against one made of whole prefixes, with long, equal, empty and odd conversations."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import prefixtrie as pt

SCHEMA = "conv_id long, turn long, role string, text string"


def symbol(role, text):
    return hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()


def slow(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, symbol(role, text), role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole[c] = (*own.get(base, [])[:h], *turns[h:])
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    inner = {k[:-1] for k in nodes if k}
    children, saved, leaves = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for k, convs in nodes.items():
        if k:
            children[k[:-1]] += 1
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(convs) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += k not in inner
    ends = {}
    for c in sorted(whole):
        ends.setdefault(whole[c], []).append(str(c))
    return sorted((min(v), len(k), min(nodes[k[:-1]]) if k else None, len(v), children[k], leaves[k], saved[k], hashlib.sha256(",".join(ends.get(k, [])).encode()).hexdigest()) for k, v in nodes.items())


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit("x"), "n": F.lit(1), "name": F.lit(2.0)}).repartition(3)
    return sorted(map(tuple, pt.prefix_trie(df).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=lambda r: r[:2])


def conversations(seed, longest):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 400), 160):
        for t in range(rng.choice([1, 2, 3, 5, 8, longest])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "é", "", None, "long text"])))
    return rows


@pytest.mark.parametrize(("bits", "longest"), [(12, 9), (2, 30)])
def test_equals_whole_prefixes(spark, bits, longest):
    """Tiles of four turns put tries of tiles over tries of turns, several deep; one conversation has many of all rows."""
    rows = conversations(bits, longest)
    rows += [(1000, k, "user", f"t{k % 7}") for k in range(200)] + [(1001, k, "user", f"t{k % 7}") for k in range(30)]
    rows += [(None, 0, "user", "lost"), (7001, None, "user", "first"), (7001, 3, "x", "b"), (7001, 3, "x", "a"), *[(7002, 1, "same", "same")] * 5]
    old, pt.TILE_BITS = pt.TILE_BITS, bits
    try:
        assert found(spark, rows) == sorted(slow(rows), key=lambda r: r[:2])
    finally:
        pt.TILE_BITS = old


def test_many_ends_in_one_node(spark):
    """A node where a third of all conversations end is hashed from chunks, in the order of numbers and not of text."""
    rows = [(c, 0, "user", "same") for c in range(0, 1200)]
    old, pt.CHUNK = pt.CHUNK, 100
    try:
        assert found(spark, rows) == sorted(slow(rows), key=lambda r: r[:2])
    finally:
        pt.CHUNK = old


def test_nothing(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x")]) == []
    assert found(spark, [(3, 1, None, None)]) == slow([(3, 1, None, None)])
