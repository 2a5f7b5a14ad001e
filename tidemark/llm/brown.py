"""Class-based bigram language model in the manner of Brown: P(w | v) = P(class of w | class of v) * P(w | class of w).

Exchange clustering moves symbols between classes where that raises the likelihood of the class bigrams, until nothing is
gained. Its symbols are the most frequent words, one symbol for each of several hundred groups of all other words (by
their last bytes), and the end of a text. Then each other word of the training texts gets a class of its own, by its own
counts with the classes before and after it; these classes lie in a table and are joined. Only words that training doesn't
know are read as their group, and share the mass that absolute discounting takes from the group's words.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounds, first_tag, fold_of, materialize, narrow, numbered, portions, runs, utf8, word_arrays

#: Words that exchange clusters, groups of the other words, classes.
WORDS, GROUPS, CLASSES = 4096, 512, 64
#: Exchange ends when two turns, in which each symbol has its try, gain less than so many nats a token.
GAIN = 1e-3
#: Words whose counts and classes go to every task; the others' are joined.
KNOWN = 65_536
#: Pseudo-count of the class unigram in class transitions.
PRIOR = 5.0

END = -1  # of the hash of a word; no word has it (see _hashes)


def _hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words)).view(np.int64) & ~1  # even, so never END


def _groups(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, [w[-3:] for w in words]), dtype=np.int64, count=len(words)) % GROUPS


def _hash(word: bytes) -> int:
    return int(_hashes([word])[0])


def _group(word: bytes) -> int:
    return int(_groups([word])[0])


def _counted(batches):
    """Words' counts, summed within the task as far as memory allows."""
    schema = pa.schema([("h", pa.int64()), ("g", pa.int32()), ("c", pa.int64())])
    parts, texts = [], 0

    def summed():
        h, g, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        h, first, which = np.unique(h, return_index=True, return_inverse=True)
        return h, g[first], np.bincount(which, weights=c, minlength=len(h)).astype(np.int64)

    def out(h, g, c):
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(g.astype(np.int32)), pa.array(c)], schema=schema)

    for batch in batches:
        for some in portions(utf8(batch.column("text"))):
            words, which = numbered(*word_arrays(some)[:2])
            parts.append((_hashes(words), _groups(words), np.bincount(which, minlength=len(words))))
            texts += len(some)
            if sum(len(p[0]) for p in parts) > 1_000_000:
                parts = [summed()]
                if len(parts[0][0]) > 500_000:
                    yield out(*parts[0])
                    parts = []
    if parts:
        yield out(*summed())
    yield out(np.array([END]), np.array([-1]), np.array([texts]))


@dataclass
class Model:
    """What goes to every task. Its size is bounded by WORDS, GROUPS, CLASSES and KNOWN, whatever the corpus."""

    tokens: int
    types: int
    discount: float
    frequent: dict[int, int]  # hash of a clustered word to its symbol
    known: dict[int, int]  # hash to count
    group_types: np.ndarray
    classes: dict[int, int] = field(default_factory=dict)  # hash of a known word outside the clustered ones to its class
    of: np.ndarray = field(default=None)  # class of each symbol
    transition: np.ndarray = field(default=None)  # log10, from row to column
    total: np.ndarray = field(default=None)  # mass of each class
    emission: np.ndarray = field(default=None)  # log10 of a symbol in its class; of a group, of all its unknown words

    @property
    def end(self) -> int:
        return WORDS + GROUPS


class Symbols:
    """Symbols of words, and for words outside the clustered ones their hashes."""

    def __init__(self, model: Model):
        self.tables = []
        for found in (model.frequent, model.known, model.classes):
            h = np.fromiter(found.keys(), dtype=np.int64, count=len(found))
            order = np.argsort(h)
            self.tables.append((h[order], np.fromiter(found.values(), dtype=np.int64, count=len(found))[order]))

    def _of(self, table: int, h: np.ndarray) -> np.ndarray:
        """Values of these hashes, -1 where there is none."""
        keys, values = self.tables[table]
        if not len(keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, values[at], -1)

    def __call__(self, texts: list[bytes]):
        """Each text's first word (and the end), and of all words: symbol, count or -1 where a join must tell, own class or -1, hash."""
        data, at, first = word_arrays(texts)
        words, which = numbered(data, at)
        h = _hashes(words)
        s = self._of(0, h)
        far = np.flatnonzero(s < 0)
        s[far] = WORDS + _groups([words[i] for i in far.tolist()])
        return first, *(x[which] for x in (s, self._of(1, h), self._of(2, h), h))


def _bigrams(shared):
    """Counts of neighbouring symbols, each text with an end before and after."""
    schema = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("c", pa.int64())])

    def run(batches):
        symbols = Symbols(shared.value)
        end, base = shared.value.end, WORDS + GROUPS + 1
        parts, size = [], 0

        def out():
            pairs, c = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((pairs // base).astype(np.int32)), pa.array((pairs % base).astype(np.int32)), pa.array(c)], schema=schema)

        for batch in batches:
            for texts in portions(utf8(batch.column("text"))):
                first, s, *_ = symbols(texts)
                s = np.insert(s, first, end)  # an end between two texts is the one's last and the other's first
                parts.append(s[:-1] * base + s[1:])
                size += len(s)
                if size > 3_000_000:
                    yield out()
                    parts, size = [], 0
        if parts:
            yield out()

    return run


def _f(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-9)), 0.0)


def likelihood(n: np.ndarray) -> float:
    """The part of the log likelihood of class bigrams that the classes change."""
    return float(_f(n).sum() - _f(n.sum(axis=1)).sum() - _f(n.sum(axis=0)).sum())


def best_class(own: int, right: np.ndarray, left: np.ndarray, n: np.ndarray) -> tuple[int, float]:
    """The class to which a symbol should move, and the gain. right, left: its counts with each class after and before it."""
    w = right.sum()
    rows, cols, row_sum, col_sum = n.copy(), n.copy(), n.sum(axis=1), n.sum(axis=0)
    rows[own] -= right
    cols[:, own] -= left
    row_sum[own] -= w
    col_sum[own] -= w
    rows, cols, row_sum, col_sum = (np.maximum(x, 0) for x in (rows, cols, row_sum, col_sum))
    joined = (_f(rows + right) - _f(rows)).sum(axis=1) + (_f(cols + left[:, None]) - _f(cols)).sum(axis=0)
    joined -= _f(row_sum + w) - _f(row_sum) + _f(col_sum + w) - _f(col_sum)
    to = int(np.argmax(joined))
    return to, float(joined[to] - joined[own])


def _with_classes(batch, of, lists: str, counts: str) -> np.ndarray:
    """Per row of a batch the counts of its list with each class."""
    column, n = batch.column(lists), batch.num_rows
    row = np.repeat(np.arange(n), column.value_lengths().to_numpy(zero_copy_only=False))
    return np.bincount(row * CLASSES + of[column.flatten().to_numpy()], weights=batch.column(counts).flatten().to_numpy(), minlength=n * CLASSES).reshape(n, CLASSES)


def _class_counts(of):
    def run(batches):
        n = np.zeros((CLASSES, CLASSES))
        for batch in batches:
            np.add.at(n, of[batch.column("s").to_numpy()], _with_classes(batch, of, "after", "after_c"))
        i, j = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(n[i, j])], ["i", "j", "n"])

    return run


def _moves(of, n, turn: int):
    def run(batches):
        rows = []
        for batch in batches:
            right, left = _with_classes(batch, of, "after", "after_c"), _with_classes(batch, of, "before", "before_c")
            for k, s in enumerate(batch.column("s").to_pylist()):
                if (s * 2654435761 >> 7) % 2 != turn % 2:  # half of the symbols at a time, so that moves seldom work against each other
                    continue
                to, gain = best_class(int(of[s]), right[k], left[k], n)
                if gain > 1e-9 and to != of[s]:
                    rows.append((s, to, gain))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["s", "to", "gain"])

    return run


def _counts_matrix(lists: DataFrame, of: np.ndarray) -> np.ndarray:
    n = np.zeros((CLASSES, CLASSES))
    for i, j, c in lists.mapInArrow(_class_counts(of), "i long, j long, n double").groupBy("i", "j").agg(F.sum("n")).collect():  # CLASSES squared at most
        n[i, j] = c
    return n


def exchange(lists: DataFrame, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes and their bigram counts after exchange in parallel, half of the symbols in turn, until nothing is gained.

    Moves that together lower the likelihood are undone, and the better half of them is tried, down to a single one.
    """
    of, n = start, _counts_matrix(lists, start)
    best, turn, gains = likelihood(n), 0, [np.inf, np.inf]
    while sum(gains[-2:]) > GAIN * max(n.sum(), 1.0):
        moves = lists.mapInArrow(_moves(of, n, turn), "s long, to long, gain double").collect()  # one row a symbol at most
        moves = sorted((r for r in moves if r.s != len(of) - 1), key=lambda r: (-r.gain, r.s))  # the end keeps its class
        gains.append(0.0)
        while moves:
            now = of.copy()
            now[[r.s for r in moves]] = [r.to for r in moves]
            m = _counts_matrix(lists, now)
            if (value := likelihood(m)) > best:
                gains[-1] = value - best
                of, n, best = now, m, value
                break
            moves = moves[: len(moves) // 2]
        turn += 1
    return of, n


def _contexts(shared):
    """Counts of the words outside the clustered ones between the classes beside them: x is the group, then the class before, then the one after."""
    schema = pa.schema([("h", pa.int64()), ("x", pa.int32()), ("c", pa.int64())])
    wide = CLASSES * CLASSES

    def run(batches):
        symbols, m = Symbols(shared.value), shared.value
        hashes, places, size = [], [], 0

        def out():
            h, row = np.unique(np.concatenate(hashes), return_inverse=True)
            pairs, c = np.unique(row * (wide * GROUPS) + np.concatenate(places), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[pairs // (wide * GROUPS)]), pa.array((pairs % (wide * GROUPS)).astype(np.int32)), pa.array(c)], schema=schema)

        for batch in batches:
            for texts in portions(utf8(batch.column("text"))):
                first, s, _, _, h = symbols(texts)
                s, h = np.insert(s, first, m.end), np.insert(h, first, END)
                at = np.flatnonzero((s >= WORDS) & (s < m.end))
                if len(at) == 0:
                    continue
                k = m.of[s]
                hashes.append(h[at])
                places.append((s[at] - WORDS) * wide + k[at - 1] * CLASSES + k[at + 1])
                size += len(at)
                if size > 1_000_000:
                    yield out()
                    hashes, places, size = [], [], 0
        if hashes:
            yield out()

    return run


def _own_class(of: np.ndarray, transition: np.ndarray, total: np.ndarray):
    """Count and class of each word of _contexts, sorted by word: the likeliest class for its own places, but that of its group where that is no dearer than to name another."""
    price = np.vstack([transition.T, transition]) * np.log(10)
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("k", pa.int32())])

    def run(batches):
        for table in runs(batches, ["h"]):
            edges = bounds(table, ["h"])
            n = len(edges) - 1
            x, c = table.column("x").to_numpy().astype(np.int64), table.column("c").to_numpy()
            word = np.repeat(np.arange(n), np.diff(edges)) * CLASSES
            after, before = (np.bincount(word + k, weights=c, minlength=n * CLASSES).reshape(n, CLASSES) for k in (x % CLASSES, x // CLASSES % CLASSES))
            tokens = before.sum(axis=1)
            value = np.hstack([after, before]) @ price - tokens[:, None] * np.log(np.maximum(total, 1.0))
            own, to = of[WORDS + x[edges[:-1]] // CLASSES**2], value.argmax(axis=1)
            rows = np.arange(n)
            k = np.where(value[rows, to] - value[rows, own] > np.log(CLASSES), to, own)
            yield pa.RecordBatch.from_arrays([pa.array(table.column("h").to_numpy()[edges[:-1]]), pa.array(tokens.astype(np.int64)), pa.array(k.astype(np.int32))], schema=schema)

    return run


def _transition(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    unigram = (total + 1e-3) / (total + 1e-3).sum()
    return np.log10((n + PRIOR * unigram) / (n.sum(axis=1, keepdims=True) + PRIOR))


def _most_frequent(words: DataFrame) -> list:
    """The words above a count that at most KNOWN words exceed, most frequent first, ties by hash."""
    n = words.count()
    least = 0
    if n > KNOWN:
        least = words.agg(F.percentile_approx("c", 1 - 2 * KNOWN / max(n, 2 * KNOWN), 10_000)).first()[0]
    cut, found = 0, 0
    # of counts there are few: about the square root of twice the tokens at most, and far fewer above `least`
    for c, words_of in sorted(words.filter(F.col("c") >= least).groupBy("c").count().collect(), reverse=True):
        found += words_of
        if found > KNOWN:
            cut = c
            break
    return sorted(words.filter(F.col("c") > cut).collect(), key=lambda r: (-r.c, r.h))


def classify(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the texts (column text) but for its transitions, and count and class (h, c, k) of each word outside the clustered ones."""
    spark = docs.sparkSession
    words = materialize(docs.mapInArrow(_counted, "h long, g int, c long").groupBy("h", "g").agg(F.sum("c").alias("c")).filter("c > 0"), "words")
    tokens, types, once, twice = words.agg(F.sum("c"), F.count("*"), F.count(F.when(F.col("c") == 1, 1)), F.count(F.when(F.col("c") == 2, 1))).first()
    discount = once / (once + 2 * twice) if once and twice else 0.5
    top = _most_frequent(words.filter(F.col("h") != END))
    frequent = {r.h: s for s, r in enumerate(top[:WORDS])}
    group_types = np.zeros(GROUPS)
    rest = F.broadcast(spark.createDataFrame([(h,) for h in frequent], "h long"))  # WORDS rows at most
    for g, n in words.filter("g >= 0").join(rest, "h", "left_anti").groupBy("g").count().collect():
        group_types[g] = n
    ends = words.filter(F.col("h") == END).select("c").collect()  # one row
    model = Model(tokens or 0, types, discount, frequent, {**{r.h: r.c for r in top}, **{END: r.c for r in ends}}, group_types)

    shared = spark.sparkContext.broadcast(model)
    pairs = materialize(docs.mapInArrow(_bigrams(shared), "a int, b int, c long").groupBy("a", "b").agg(F.sum("c").alias("c")), "symbol-pairs")
    after = pairs.groupBy(F.col("a").alias("s")).agg(F.collect_list("b").alias("after"), F.collect_list("c").alias("after_c"))  # a list has one entry a symbol at most
    before = pairs.groupBy(F.col("b").alias("s")).agg(F.collect_list("a").alias("before"), F.collect_list("c").alias("before_c"))
    none = F.array().cast("array<int>"), F.array().cast("array<bigint>")
    lists = after.join(before, "s", "full").select(F.col("s").cast("long").alias("s"), *[F.coalesce(c, none[i % 2]).alias(c) for i, c in enumerate(("after", "after_c", "before", "before_c"))])
    lists = materialize(lists.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "s"), "symbol-lists")

    size = WORDS + GROUPS + 1
    start = np.arange(size, dtype=np.int64) % (CLASSES - 1)
    start[-1] = CLASSES - 1
    of, n = exchange(lists, start)
    count = np.zeros(size)
    for s, c in pairs.groupBy("b").agg(F.sum("c")).collect():  # one row a symbol at most
        count[s] = c
    total = np.bincount(of, weights=count, minlength=CLASSES)
    model.of = of

    shared = spark.sparkContext.broadcast(model)
    places = docs.mapInArrow(_contexts(shared), "h long, x int, c long").repartition("h").sortWithinPartitions("h")
    classed = materialize(places.mapInArrow(_own_class(of, _transition(n, total), total), "h long, c long, k int"), "word-classes")
    near = F.broadcast(spark.createDataFrame([(r.h,) for r in top[WORDS:]], "h long"))  # KNOWN rows at most
    model.classes = {r.h: r.k for r in classed.join(near, "h").collect()}

    # a group that training never saw gets a twentieth of a count; places of words that there aren't get nothing
    mass = count.copy()
    mass[len(frequent) : WORDS] = 1e-12
    mass[WORDS : WORDS + GROUPS] = np.maximum(discount * group_types, 0.05)
    mass[-1] = max(mass[-1], 0.1)
    model.total = np.bincount(of, weights=mass, minlength=CLASSES)
    for k, c, n_words in classed.groupBy("k").agg(F.sum("c"), F.count("*")).collect():  # CLASSES rows at most
        model.total[k] += c - discount * n_words
    model.emission = np.log10(mass / model.total[of])
    return model, classed


def _read(shared):
    """A row a text with the classes of its symbols, and a row for each place of a word whose class must be joined."""
    schema = pa.schema([("h", pa.int64()), ("tag", pa.int64()), ("id", pa.int64()), ("place", pa.int64()), ("g", pa.int32()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("classes", pa.binary())])

    def run(batches):
        m, tag = shared.value, first_tag()
        symbols, below, end = Symbols(m), np.log10(float(m.tokens + m.types + 1)), m.known.get(END, 0)
        for batch in batches:
            done = 0
            for texts in portions(utf8(batch.column("text"))):
                first, s, c, own, h = symbols(texts)
                n, words = len(texts), np.diff(first)
                text = np.repeat(np.arange(n), words)
                told, outside = c >= 0, s >= WORDS
                k = np.where(told & outside & (own >= 0), own, m.of[s])
                with np.errstate(divide="ignore"):
                    gain = np.where(outside, np.where(told, np.log10(np.maximum(c - m.discount, 1e-12)) - np.log10(m.total[k]), 0.0), m.emission[s])
                per_text = lambda x: np.bincount(text, weights=x, minlength=n)  # noqa: E731,B023
                base = per_text(np.where(told, np.log10(c + 1.0), 0.0)) + np.log10(end + 1.0) - (words + 1) * below
                known = per_text(c > 0).astype(np.int64) + int(end > 0)
                classes = np.insert(k, first, m.of[m.end]).astype(np.uint8).tobytes()
                at = first + np.arange(n + 1)
                classes = [classes[a : b + 1] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                tags, none = tag + np.arange(n), np.full(n, -1)
                # a text's own row; its hash only spreads such rows, for no word's hash is odd
                cols = [2 * (tags % (1 << 50)) + 1, tags, batch.column("id").slice(done, n), none, none.astype(np.int32), words + 1, known, base, per_text(gain) + m.emission[m.end], pa.array(classes, pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in cols], schema=schema)
                if len(far := np.flatnonzero(~told)):
                    zero, place = np.zeros(len(far), dtype=np.int64), far - first[text[far]] + 1
                    cols = [h[far], tag + text[far], pa.nulls(len(far), pa.int64()), place, (s[far] - WORDS).astype(np.int32), zero, zero, zero.astype(float), zero.astype(float), pa.nulls(len(far), pa.binary())]
                    yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in cols], schema=schema)
                tag += n
                done += n

    return run


def _filled(batches):
    """The classes of texts with those that were joined put in their places."""
    for batch in batches:
        classes = []
        for data, holes in zip(batch.column("classes").to_pylist(), batch.column("joined"), strict=True):
            x = np.frombuffer(data, dtype=np.uint8).copy()
            holes = holes.values.to_numpy()
            x[holes // CLASSES] = holes % CLASSES
            classes.append(x.tobytes())
        names = ["id", "n_tokens", "n_known", "base_score", "score"]
        yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in names], pa.array(classes, pa.binary())], [*names, "classes"])


def read(docs: DataFrame, model: Model, classed: DataFrame) -> DataFrame:
    """id, n_tokens, n_known, base_score, score (emissions only) and classes (a byte a symbol, ends too) of each row of id and text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.mapInArrow(_read(shared), "h long, tag long, id long, place long, g int, n long, known long, base double, score double, classes binary")
    rows = rows.join(classed, "h", "left")
    word, c = F.col("place") >= 0, F.coalesce("c", F.lit(0))
    one_of = lambda values, i: F.element_at(F.array(*[F.lit(x) for x in values.tolist()]), i + 1)
    groups = slice(WORDS, WORDS + GROUPS)
    k = F.coalesce("k", one_of(model.of[groups].astype(np.int32), F.col("g")))
    own = F.when(c > 0, F.log10(c - F.lit(float(model.discount))) - one_of(np.log10(np.maximum(model.total, 1e-12)), F.col("k"))).otherwise(one_of(model.emission[groups], F.col("g")))
    rows = rows.select(
        "tag", "id", F.when(~word, F.col("n")).alias("n_tokens"), F.when(word, (c > 0).cast("long")).otherwise(F.col("known")).alias("n_known"), F.when(word, F.log10(c + 1.0)).otherwise(F.col("base")).alias("base"),
        F.when(word, own).otherwise(F.col("score")).alias("score"), "classes", F.when(word, F.col("place") * CLASSES + k).alias("joined"),
    )
    sums = rows.groupBy("tag").agg(F.max("id").alias("id"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"), F.max("classes").alias("classes"), F.collect_list("joined").alias("joined"))  # a list has one entry a word of the text at most
    return materialize(sums.drop("tag").mapInArrow(_filled, "id long, n_tokens long, n_known long, base_score double, score double, classes binary"), "text-classes")


def _pairs(batches):
    n = np.zeros(CLASSES * CLASSES, dtype=np.int64)
    for batch in batches:
        for data in batch.column("classes").to_pylist():
            x = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
            n += np.bincount(x[:-1] * CLASSES + x[1:], minlength=CLASSES * CLASSES)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["x", "n"])


def link(model: Model, texts: DataFrame) -> None:
    """Gives the model its transitions, from the classes of all words of the training texts, as read() has them."""
    n = np.zeros(CLASSES * CLASSES)
    for x, c in texts.select("classes").mapInArrow(_pairs, "x long, n long").groupBy("x").agg(F.sum("n")).collect():  # CLASSES squared at most
        n[x] = c
    model.transition = _transition(n.reshape(CLASSES, CLASSES), n.reshape(CLASSES, CLASSES).sum(axis=0))


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The whole model of the texts (column text), and the table of classify()."""
    model, classed = classify(docs)
    link(model, read(docs.select(F.lit(None).cast("long").alias("id"), "text"), model, classed))
    return model, classed


def _linked(transition: np.ndarray):
    def run(batches):
        for batch in batches:
            score = batch.column("score").to_numpy().copy()
            for i, data in enumerate(batch.column("classes").to_pylist()):
                x = np.frombuffer(data, dtype=np.uint8)
                score[i] += transition[x[:-1], x[1:]].sum()
            names = ["id", "n_tokens", "n_known", "base_score"]
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in names], pa.array(score)], [*names, "score"])

    return run


def score_read(texts: DataFrame, model: Model) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score and score (log10) of each row of read()."""
    rows = texts.mapInArrow(_linked(model.transition), "id long, n_tokens long, n_known long, base_score double, score double")
    return rows.select("id", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def score(docs: DataFrame, model: Model, classed: DataFrame) -> DataFrame:
    """As score_read(), of each row of id and text."""
    return score_read(read(docs, model, classed), model)


def class_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2) -> DataFrame:
    """Scores of all texts by a model of those whose crc32(id as text) mod `folds` isn't `held_out`.

    id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity. Letters A-Z count as lower case; each
    text ends with an end, so that null and empty texts have one token. A null id counts as empty text in the fold.
    Without training texts, or on an empty table, every word is unknown. Rows with equal ids and repeated rows are scored
    each for itself.
    """
    docs = narrow(docs, id_col, text_col).toDF("id", "text").withColumn("id", F.col("id").cast("long"))
    out = fold_of(F.col("id"), folds) == held_out
    model, classed = classify(docs.filter(~out))
    texts = read(docs, model, classed)
    link(model, texts.filter(~out))
    rows = score_read(texts, model).withColumn("held_out", out).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
    return rows.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
