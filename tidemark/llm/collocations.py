"""Collocations of each language: phrases of 2 to 5 words, grown best first by a bound that prefix counts give.

A phrase p with count a scores the least floor(1000 a n / (l r)) over its cuts into a first part (count l) and a rest
(count r). Of every phrase that begins with the word w, the cut after w gives at most floor(1000 n / f(w)), for a is at
most r: an admissible bound that the count of the shortest prefix tells. So first words are expanded rarest first, in two
waves. The first takes the rarest words that make up a share of all places; the score of its last kept phrase bounds the
final one from below, and so the second takes just the words whose bound reaches it (ties too) and settles the rest. The
common words, on which most places stand, are mostly never expanded. A wave is grown a word at a time: only extensions of
phrases with enough places are counted.

Texts are read once and written as numbers (portions of text with a dictionary each); all counting runs on these. Words
and phrases are known by 128 bits of hash, and taken as equal where these are: of ten thousand billion phrases two are
the same with a chance of 1e-13. Tasks test membership in bitmaps of bounded size (MOST_BITS); a full bitmap only lets
more phrases through, which the exact keys drop again. Only the phrases to be returned are spelt. Nothing is held whole
anywhere: a task holds one portion, and counts are summed before each shuffle.

Null texts are empty, a null lang is `und`; empty tables give no rows; equal rows count each; other columns don't matter.
Bytes that aren't UTF-8 are read as U+FFFD.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, materialize, numbered, portions, utf8

#: Bitmaps have at most so many bits, as a power of two: 32 MiB.
MOST_BITS = 28
#: Bytes of text in a portion (one longer text is one portion).
PORTION = 2_000_000
#: The first wave takes the rarest words that make up this share of a language's places.
FIRST_SHARE = 0.125
#: Phrases of one language are ranked in so many parts first.
PARTS = 64
LONGEST = 5

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[9, 32]] = 1
_KIND[[*b".,;:!?", 10, 11, 12, 13]] = 2
_STEPS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_KEY = ["h", "g"]
#: Keys of the first k words and of the words after them.
_PARTS_OF = [f"{s}{k}{x}" for k in range(1, LONGEST) for s in "pr" for x in "hg"]


class Bits:
    """A set of 64-bit hashes as a bitmap: says yes for all members, and for a few others."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bits_of(hashes: DataFrame):
    """The bitmap of column h, broadcast. Its blocks are made by Spark; they are all that comes to the driver, 2^MOST_BITS bits at most."""
    size = min(MOST_BITS, max(15, (16 * hashes.count()).bit_length()))
    at = F.col("h").bitwiseAND(F.lit((1 << size) - 1))
    blocks = hashes.groupBy(F.shiftright(at, 15).alias("block")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("bits"))
    bits = np.zeros(1 << (size - 3), dtype=np.uint8)
    for block, part in blocks.collect():
        bits[block * 4096 : block * 4096 + 4096] = np.frombuffer(part, dtype=np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(Bits(bits))


def _coded(batches):
    """Portions of one language's texts: their distinct words (spaces between) with two hashes each, and all words as numbers, -1 between pieces. Numbers go as bytes, which Spark needn't unpack."""
    for batch in batches:
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            texts.setdefault(lang, []).append(text)
        for lang, those in texts.items():
            seed = xxhash.xxh32_intdigest(lang)
            for portion in portions(those, PORTION):
                data = np.frombuffer(b"\n".join([*portion, b""]).lower(), dtype=np.uint8)
                kind = _KIND[data]
                word = kind == 0
                edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
                first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                if len(first) == 0:
                    continue
                distinct, ids = numbered(data[word], np.concatenate(([0], np.cumsum(last - first))))
                piece = np.cumsum(kind == 2)[first]
                moved = np.cumsum(np.concatenate(([False], piece[1:] != piece[:-1])))
                out = np.full(len(ids) + int(moved[-1]), -1, dtype=np.int32)
                out[np.arange(len(ids)) + moved] = ids
                both = [np.array([xxhash.xxh64_intdigest(x, s) for x in distinct], dtype=np.uint64).view(np.int64) for s in (seed, seed + (1 << 32))]
                yield pa.RecordBatch.from_arrays([pa.array([lang]), *[pa.array([x], pa.binary()) for x in (b" ".join(distinct), *(y.tobytes() for y in (*both, out)))]], ["lang", "words", "h", "g", "ids"])


class Portion:
    """The places of one portion: numbers of words, padded so that a place has LONGEST words after it and one before."""

    def __init__(self, h: np.ndarray, g: np.ndarray, ids: np.ndarray):
        self.both = h.view(np.uint64), g.view(np.uint64)
        self.ids = np.concatenate(([-1], ids, [-1] * LONGEST)).astype(np.int64)

    def flagged(self, bits: Bits) -> np.ndarray:
        """Per place: whether its word is in a set; never between pieces."""
        return np.append(bits.has(self.both[0]), False)[self.ids]

    def hashes(self, at: np.ndarray, n: int, which: int = 0) -> np.ndarray:
        of = self.both[which]
        h = of[self.ids[at]]
        for j in range(1, n):
            h = h * _STEPS[which] + of[self.ids[at + j]]
        return h

    def keys(self, at: np.ndarray, n: int) -> list[np.ndarray]:
        return [self.hashes(at, n, which).view(np.int64) for which in (0, 1)]


def _numbers(batch: pa.RecordBatch, k: int, first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """h, g and ids of a row."""
    return tuple(np.frombuffer(batch.column(first + c)[k].as_buffer(), dtype=t) for c, t in enumerate((np.int64, np.int64, np.int32)))


def _portions(batches):
    """Portions of the columns h, g, ids."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield Portion(*_numbers(batch, k))


def _summed(portion: Portion, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One place of each distinct phrase of n words, which of them each place is, and places by phrase."""
    h, g = portion.keys(at, n)
    _, one, of, counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    if (g[one][of] != g).any():  # two phrases with one first hash
        _, one, of, counts = np.unique(np.stack((h, g)), axis=1, return_index=True, return_inverse=True, return_counts=True)
    return at[one], of.ravel(), counts


def _batch(columns, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, dtype=np.int64)) for c in columns], names)


#: Counts of words that a task puts together before it hands them on.
HELD = 500_000


def _count_words(batches):
    """Counts of words, summed over the portions of a task as far as HELD goes, and of all words of a language."""

    def out():
        h, g, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((g, h))
        h, g, n = h[order], g[order], n[order]
        starts = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1]))))
        numbers = _batch([np.append(h[starts], 0), np.append(g[starts], 0), np.append(np.add.reduceat(n, starts), n.sum()), np.append(np.zeros(len(starts)), 1)], [*_KEY, "n", "whole"])
        return pa.RecordBatch.from_arrays([pa.array([lang] * numbers.num_rows, pa.string()), *numbers.columns], ["lang", *_KEY, "n", "whole"])

    lang, held, size = None, [], 0
    for batch in batches:
        for k in range(batch.num_rows):
            of = batch.column(0)[k].as_py()
            if held and (of != lang or size > HELD):
                yield out()
                held, size = [], 0
            h, g, ids = _numbers(batch, k, 1)
            lang, size = of, size + len(h)
            held.append((h.copy(), g.copy(), np.bincount(ids[ids >= 0], minlength=len(h))))
    if held:
        yield out()


def _grown(length: int, first, known, frontier):
    """Of a wave's phrases with length - 1 words, the extensions by one with their places."""

    def run(batches):
        for portion in _portions(batches):
            common = portion.flagged(known.value)
            at = np.flatnonzero(portion.flagged(first.value))
            for j in range(1, length):
                at = at[common[at + j]]
            if frontier is not None:
                at = at[frontier.value.has(portion.hashes(at, length - 1))]
            one, _, n = _summed(portion, at, length)
            yield _batch([*portion.keys(one, length), n], [*_KEY, "n"])

    return run


def _told(first, known, wanted, longest: int):
    """Of a wave's phrases: hashes of the words before and after (0 at an end of a piece; the least and the largest), and the keys of their parts."""

    def run(batches):
        names = [*_KEY, "length", "before", "before_too", "after", "after_too", *_PARTS_OF]
        for portion in _portions(batches):
            common, beside = portion.flagged(known.value), np.append(portion.both[0].view(np.int64), 0)[portion.ids]
            at = np.flatnonzero(portion.flagged(first.value))
            for length in range(2, longest + 1):
                at = at[common[at + length - 1]]
                hit = at[wanted.value.has(portion.hashes(at, length))]
                if len(hit) == 0:
                    continue
                one, of, n = _summed(portion, hit, length)
                order, starts = np.argsort(of, kind="stable"), np.concatenate(([0], np.cumsum(n)[:-1]))
                sides = [f.reduceat(beside[hit + d][order], starts) for d in (-1, length) for f in (np.minimum, np.maximum)]
                parts = []
                for k in range(1, LONGEST):
                    parts += [*portion.keys(one, k), *portion.keys(one + k, length - k)] if k < length else [np.zeros(len(one))] * 4
                yield _batch([*portion.keys(one, length), np.full(len(one), length), *sides, *parts], names)

    return run


def _counted(known, wanted, longest: int):
    """Places of the wanted phrases, whatever word they begin with."""

    def run(batches):
        for portion in _portions(batches):
            common = portion.flagged(known.value)
            at = np.flatnonzero(common)
            for length in range(2, longest + 1):
                at = at[common[at + length - 1]]
                hit = at[wanted.value.has(portion.hashes(at, length))]
                if len(hit):
                    one, _, n = _summed(portion, hit, length)
                    yield _batch([*portion.keys(one, length), n], [*_KEY, "n"])

    return run


def _spelt(wanted, longest: int):
    """The wanted phrases in letters, of columns words, h, g, ids."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                portion = Portion(*_numbers(batch, k, 1))
                words = batch.column(0)[k].as_py().split(b" ")
                at = np.flatnonzero(portion.ids >= 0)
                for length in range(2, longest + 1):
                    at = at[portion.ids[at + length - 1] >= 0]
                    hit = at[wanted.value.has(portion.hashes(at, length))]
                    if len(hit):
                        one, _, _ = _summed(portion, hit, length)
                        texts = [b" ".join(words[i] for i in portion.ids[x : x + length]) for x in one]
                        yield pa.RecordBatch.from_arrays([*_batch(portion.keys(one, length), _KEY).columns, pa.array(texts, pa.binary())], [*_KEY, "phrase"])

    return run


def word_counts(coded: DataFrame, least: int) -> DataFrame:
    """lang, h, g, n (places), total (of the language), of words with `least` places. The totals ride along as rows of their own."""
    counts = coded.select("lang", "h", "g", "ids").mapInArrow(_count_words, "lang string, h long, g long, n long, whole long").groupBy("lang", *_KEY, "whole").agg(F.sum("n").alias("n"))
    counts = materialize(counts.filter((F.col("n") >= least) | (F.col("whole") == 1)), "collocation-words")
    totals = counts.filter("whole = 1").select("lang", F.col("n").alias("total"))
    return counts.filter("whole = 0").drop("whole").join(F.broadcast(totals), "lang")  # one row a language


def _sums(rows: DataFrame, least: int) -> DataFrame:
    return rows.groupBy(*_KEY).agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _wave(coded: DataFrame, words: DataFrame, band: DataFrame, known, least: int, longest: int) -> DataFrame | None:
    """Scored phrases that begin with the band's words: h, g, lang, a, l, r, n, score, survives."""
    numbers = coded.select("h", "g", "ids")
    first, frontier, levels = bits_of(band.select("h")), None, None
    for length in range(2, longest + 1):
        level = materialize(_sums(numbers.mapInArrow(_grown(length, first, known, frontier), "h long, g long, n long"), least), f"collocation-level-{length}")
        if level.isEmpty():
            break
        levels = level if levels is None else levels.unionAll(level)
        frontier = bits_of(level.select("h"))
    if levels is None:
        return None
    columns = ", ".join(f"{c} long" for c in (*_KEY, "length", "before", "before_too", "after", "after_too", *_PARTS_OF))
    told = numbers.mapInArrow(_told(first, known, bits_of(levels.select("h")), longest), columns)
    lows, highs = ("before", "after"), ("length", "before_too", "after_too", *_PARTS_OF)
    told = told.groupBy(*_KEY).agg(*[F.min(c).alias(c) for c in lows], *[F.max(c).alias(c) for c in highs])
    phrases = materialize(levels.join(told, _KEY), "collocation-phrases")
    rests = phrases.select(F.explode(F.array(*[F.when(F.col("length") - k >= 2, F.struct(F.col(f"r{k}h").alias("h"), F.col(f"r{k}g").alias("g"))) for k in range(1, longest - 1)])).alias("r")) if longest > 2 else None
    counts = words.select(*_KEY, F.col("n").alias("f")).unionAll(levels.select(*_KEY, F.col("n").alias("f")))
    if rests is not None:
        rests = materialize(rests.filter("r is not null").select("r.*").distinct().join(levels, _KEY, "left_anti"), "collocation-rests")
        if not rests.isEmpty():
            more = _sums(numbers.mapInArrow(_counted(known, bits_of(rests), longest - 1), "h long, g long, n long"), least)
            counts = counts.unionAll(more.join(rests, _KEY, "left_semi").select(*_KEY, F.col("n").alias("f")))
    return _scored(phrases, counts, band, longest)


def _scored(phrases: DataFrame, counts: DataFrame, band: DataFrame, longest: int) -> DataFrame:
    """The least score of each phrase over its cuts. Counts of parts are looked up as keys; common ones meet by a bounded broadcast."""
    same = lambda x: (F.col(x) == F.col(f"{x}_too")) & (F.col(x) != 0)
    fixed = (F.col("length") < longest) & (same("before") | same("after"))
    part = lambda k, s: F.struct(F.lit(k).alias("k"), F.lit(s).alias("side"), F.col(f"{s}{k}h").alias("kh"), F.col(f"{s}{k}g").alias("kg"))
    parts = F.array(*[F.when(F.col("length") > k, part(k, s)) for k in range(1, longest) for s in "pr"])
    rows = phrases.select(*_KEY, F.col("n").alias("a"), (~fixed).alias("survives"), F.explode(F.array_compact(parts)).alias("part"))
    cuts = materialize(rows.select(*_KEY, "a", "survives", "part.*"), "collocation-cuts")
    needed = cuts.groupBy("kh", "kg").agg(F.count("*").alias("n"))
    table = materialize(needed.join(counts.withColumnsRenamed({"h": "kh", "g": "kg"}), ["kh", "kg"]).dropDuplicates(["kh", "kg"]), "collocation-counts")
    found = join_counted(cuts, table, ["kh", "kg"], max(1, cuts.count()))
    of = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c))).alias
    by_cut = found.groupBy(*_KEY, "a", "survives", "k").agg(of("p", "f")("l"), of("r", "f")("r"))
    # of equal l * r the smaller k counts; the first word's key comes from the first cut
    product = F.expr("cast(l as decimal(19, 0)) * cast(r as decimal(19, 0))")
    best = by_cut.withColumn("lr", product).groupBy(*_KEY, "a", "survives").agg(F.collect_list(F.struct("k", "l", "r", "lr")).alias("cuts"))  # four at most
    heads = phrases.select(*_KEY, F.col("p1h").alias("kh"), F.col("p1g").alias("kg"))
    sizes = heads.groupBy("kh", "kg").agg(F.count("*").alias("n"))
    first_words = materialize(sizes.join(band.select("lang", F.col("h").alias("kh"), F.col("g").alias("kg"), "total"), ["kh", "kg"]), "collocation-first-words")
    named = join_counted(heads, first_words, ["kh", "kg"], max(1, phrases.count())).select(*_KEY, "lang", "total")
    score = "(cast(1000 * a as decimal(20, 0)) * cast(total as decimal(18, 0))) div c.lr"
    told = best.join(named, _KEY).withColumn("cut", F.expr(f"array_min(transform(cuts, c -> struct({score} as score, c.k as k, c.l as l, c.r as r)))"))
    return materialize(told.select(*_KEY, "lang", "a", F.col("total").alias("n"), "survives", "cut.score", "cut.l", "cut.r"), "collocation-scores")


def _best(rows: DataFrame, most: int) -> DataFrame:
    """Rows that are among the first `most` of their language by score and count, ties too. Each language is ranked in parts first, so that no task sorts a whole one."""
    ranked = lambda df, *keys: df.withColumn("rank", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a")))).filter(F.col("rank") <= most)
    return ranked(ranked(rows, "lang", F.pmod("h", F.lit(PARTS))).drop("rank"), "lang")


def _rarest(words: DataFrame, share: float) -> DataFrame:
    """Words of each language, rarest first, until they make up the share of its places. Taken by bins of counts, so that nothing is sorted whole."""
    rows = words.withColumn("bin", F.floor(4 * F.log2("n")))
    sums = rows.groupBy("lang", "bin", "total").agg(F.sum("n").alias("mass"))
    before = F.sum("mass").over(Window.partitionBy("lang").orderBy("bin")) - F.col("mass")
    taken = sums.withColumn("before", before).filter(F.col("before") < share * F.col("total")).groupBy("lang").agg(F.max("bin").alias("up_to"))
    return rows.join(F.broadcast(taken), "lang").withColumn("first", F.col("bin") <= F.col("up_to")).drop("bin", "up_to")  # one row a language


def collocations(documents: DataFrame, most: int = 2000, least: int = 100, longest: int = LONGEST, first_share: float = FIRST_SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `most` best phrases of 2 to `longest` (5 at most) words with at least `least` places.

    Ties in score go by a, then by the phrase's bytes. A phrase that always stands in the same longer one (of `longest`
    words at most) is dropped: all its places have the same word before, or after, them.
    """
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"longest must be from 2 to {LONGEST}")
    spark = documents.sparkSession
    docs = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    coded = materialize(docs.mapInArrow(_coded, "lang string, words binary, h binary, g binary, ids binary"), "collocation-texts")
    words = materialize(_rarest(word_counts(coded, least), first_share), "collocation-vocabulary")
    known = bits_of(words.select("h"))
    scored = _wave(coded, words, words.filter("first"), known, least, longest)
    rest = words.filter("not first")
    if scored is not None:
        last = _best(scored.filter("survives"), most).groupBy("lang").agg(F.min("score").alias("reached"), F.count("*").alias("found")).filter(F.col("found") >= most)
        bound = F.expr("(1000 * cast(total as decimal(18, 0))) div n")
        rest = rest.join(F.broadcast(last), "lang", "left").filter(F.col("reached").isNull() | (bound >= F.col("reached"))).drop("reached", "found")  # one row a language
    rest = materialize(rest, "collocation-rest")
    more = None if rest.isEmpty() else _wave(coded, words, rest, known, least, longest)
    waves = [w for w in (scored, more) if w is not None]
    if not waves:
        return spark.createDataFrame([], "lang string, rank int, phrase string, a long, l long, r long, n long, score long")
    rows = waves[0] if len(waves) == 1 else waves[0].unionByName(waves[1])
    best = materialize(_best(rows.filter("survives"), most).drop("rank"), "collocation-best")
    spelt = coded.select("words", "h", "g", "ids").mapInArrow(_spelt(bits_of(best.select("h")), longest), "h long, g long, phrase binary").groupBy(*_KEY).agg(F.min("phrase").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    out = best.join(spelt, _KEY).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return out.select("lang", "rank", F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score")


#: The same in DuckDB, all phrases of all lengths counted.
ORACLE = """
with docs as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
pieces as (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\\n\\x0B\\f\\r]')) as piece from docs),
words as (select lang, regexp_extract_all(piece, '[^ \\t]+') as w from pieces),
grams as (select lang, m, w[i : i + m - 1] as p from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from words, (values (1), (2), (3), (4), (5)) t(m))),
f as materialized (select lang, m, p, count(*)::bigint as c from grams group by all having count(*) >= 100),
n as (select lang, sum(len(w))::bigint as n from words group by lang),
cand as materialized (select lang, m, p, c as a from f where m >= 2),
cuts as (select lang, m, p, a, unnest(range(1, m)) as k from cand),
scored as (select c.lang, c.m, c.p, c.a, k, x.c as l, y.c as r, n.n, ((1000::hugeint * c.a * n.n) // (x.c::hugeint * y.c))::bigint as score
    from cuts c join f x on x.lang = c.lang and x.p = c.p[1 : k] join f y on y.lang = c.lang and y.p = c.p[k + 1 : c.m] join n on n.lang = c.lang),
best as (select * from scored qualify row_number() over (partition by lang, p order by score, k) = 1),
inside as (select distinct c.lang, c.p[i : i + s - 1] as p, c.a from (select lang, p, a, s, unnest(range(1, m - s + 2)) as i from cand, (values (2), (3), (4)) t(s) where s < m) c),
kept as (select b.* from best b where not exists (select 1 from inside i where i.lang = b.lang and i.p = b.p and i.a >= b.a))
select lang, rank::int as rank, array_to_string(p, ' ') as phrase, a, l, r, n, score
from (select *, row_number() over (partition by lang order by score desc, a desc, array_to_string(p, ' ')) as rank from kept) where rank <= 2000"""
