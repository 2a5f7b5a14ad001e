"""Toxicity by a weighted finite-state grammar over clauses.

Two transducers read a word by its letters and put out an insult or a threat with its weight; targets, negations, verbs of
reported speech and words of intent are symbols, too, and all else is "other". Over a clause's symbols run the machines
of intent (a threat that is meant), negation, reported speech and target (before a match, or right after it), composed
into one machine that puts out each match's kind: what it is, and what governs it. A document's score is a logistic
regression on its matches' weights by kind, so that the weights of the composed arcs are fitted on labelled documents; a
match that nothing aims at counts apart from one that has a target.

Insults are learned besides a few fixed ones: words and word beginnings that labelled toxic documents have and others
don't, of a bounded number of labelled documents.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, utf8

#: Labelled documents that the grammar is fitted on, at most: those whose ids have the smallest hashes.
SAMPLE = 200_000
#: Toxic texts that a learned entry must occur in; lengths of word beginnings. The lexicon is no larger than the sample makes it.
SUPPORT, PREFIXES = 8, range(4, 9)
#: Documents whose matches the regression takes from the sample, at most.
FITTED = 20_000

# Word lists of the grammar.
INSULTS = "idiot moron imbecile loser scum trash clown stupid pathetic worthless disgusting dumb filth vermin".split()
THREATS = "kill hurt destroy beat shoot stab burn".split()
INTENTS = "will shall going gonna must should werde werden wird vais va vont voy vas".split()
TARGETS = "you your yours u ur he she they them him her his their du dein deine ihr sie tu ton ta tes vous il elle ils tú tu usted ustedes él ella ellos".split()
NEGATIONS = "not no never isn't aren't don't doesn't wasn't without nicht kein keine nie ne pas jamais sin nunca jamás".split()
REPORTS = "said says say told tells claimed claims wrote called calls sagte sagt schrieb nannte dit disait écrit dijo dice escribió llamó".split()

#: Words that a negation, an intent or a target reaches, and words after a match at which a target still counts.
REACH, AFTER = 4, 2

#: What a match can be: insult, threat or meant threat; negated; reported; with a target.
KINDS = list(product(("insult", "threat", "meant"), (False, True), (False, True), (False, True)))
_KIND = {k: i for i, k in enumerate(KINDS)}

_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[.!?;:,\n]")
_BREAK = frozenset(".!?;:,\n")


def prior_slope(kind: tuple[str, bool, bool, bool]) -> float:
    """What a match of a kind weighs before any label is seen; a threat without a target is none."""
    what, negated, reported, aimed = kind
    start = (3.9 if aimed else 1.5) if what == "insult" else (3.0 if what == "meant" else 1.8) * aimed
    return start * (0.4 if negated else 1.0) * (0.7 if reported else 1.0)


@dataclass
class Grammar:
    words: dict[str, tuple[str, float]]  # word to symbol and weight
    starts: dict[str, float]  # beginning of a word to weight of an insult
    bias: float = -4.0
    slopes: tuple[float, ...] = tuple(map(prior_slope, KINDS))


def seed_grammar() -> Grammar:
    words: dict[str, tuple[str, float]] = {}
    for symbol, weight, listed in (("intent", 0.0, INTENTS), ("report", 0.0, REPORTS), ("target", 0.0, TARGETS), ("negation", 0.0, NEGATIONS), ("threat", 2.0, THREATS), ("insult", 2.0, INSULTS)):
        words.update(dict.fromkeys(listed, (symbol, weight)))
    return Grammar(words, {})


class Letters:
    """A weighted transducer over letters: a state for each beginning of an entry. It puts out a weight where a whole entry ends, or that of the longest open entry, after which any letters may follow."""

    def __init__(self, whole: dict[str, float], open_: dict[str, float]):
        self.arcs: dict[tuple[int, str], int] = {}
        self.final, self.open, states = {}, {}, 1
        for entries, ends in ((whole, self.final), (open_, self.open)):
            for word, weight in entries.items():
                state = 0
                for x in word:
                    if (to := self.arcs.get((state, x))) is None:
                        to = self.arcs[state, x] = states
                        states += 1
                    state = to
                ends[state] = weight

    def weight(self, word: str) -> float | None:
        state, found = 0, self.open.get(0)
        for x in word:
            if (state := self.arcs.get((state, x))) is None:
                return found
            found = self.open.get(state, found)
        return self.final.get(state, found)


def _reader(grammar: Grammar):
    """Words to (symbol, weight) or None, remembered."""
    insults = Letters({w: x for w, (symbol, x) in grammar.words.items() if symbol == "insult"}, grammar.starts)
    threats = Letters({w: x for w, (symbol, x) in grammar.words.items() if symbol == "threat"}, {})
    others = {w: s for w, s in grammar.words.items() if s[0] not in ("insult", "threat")}
    breaks: dict[str, tuple[str, float] | None] = {x: ("break", 0.0) for x in _BREAK}
    seen = dict(breaks)

    def read(tokens: list[str]) -> dict[str, tuple[str, float] | None]:
        if len(seen) > 300_000:
            seen.clear()
            seen.update(breaks)
        for t in set(tokens).difference(seen):
            found = others.get(t)
            if found is None and (weight := threats.weight(t)) is not None:
                found = ("threat", weight)
            if found is None and (weight := insults.weight(t)) is not None:
                found = ("insult", weight)
            seen[t] = found
        return seen

    return read


# The machines over symbols: each gives its next state, and whether what stands at this symbol is governed.


def scope(opening: str):
    """Open for the REACH words after a symbol."""

    def step(left: int, symbol: str) -> tuple[int, bool]:
        return (REACH if symbol == opening else max(left - 1, 0)), left > 0

    return step


def rest(opening: str):
    """Open from a symbol to the clause's end."""

    def step(said: int, symbol: str) -> tuple[int, bool]:
        return int(said or symbol == opening), bool(said)

    return step


MACHINES = (scope("intent"), scope("negation"), rest("report"), scope("target"))


def await_target(waiting: tuple, symbol: str, match: tuple | None) -> tuple[tuple, list]:
    """The machine that waits for a target after a match: waiting has the last AFTER places' matches without one. Puts out (places back, kind)."""
    out = []
    if symbol == "target":
        out = [(len(waiting) - i, (*m, True)) for i, m in enumerate(waiting) if m]
        waiting = (None,) * AFTER
    elif waiting[0]:
        out = [(AFTER, (*waiting[0], False))]
    return (*waiting[1:], match), out


class Composed:
    """All machines as one: states are made when a clause first meets them, and arcs give the next state and (places back, number of a kind) of the matches that are settled."""

    start = ((0,) * len(MACHINES), (None,) * AFTER)

    def __init__(self):
        self.arcs: dict[tuple, tuple[tuple, tuple]] = {}

    def arc(self, state: tuple, symbol: str) -> tuple[tuple, tuple]:
        if (found := self.arcs.get((state, symbol))) is None:
            states, waiting = state
            steps = [m(x, symbol) for m, x in zip(MACHINES, states, strict=True)]
            meant, negated, reported, aimed = (governed for _, governed in steps)
            match, out = None, []
            if symbol in ("insult", "threat"):
                match = ("meant" if symbol == "threat" and meant else symbol, negated, reported)
                if aimed:
                    match, out = None, [(0, (*match, True))]
            waiting, late = await_target(waiting, symbol, match)
            found = self.arcs[state, symbol] = ((tuple(x for x, _ in steps), waiting), tuple((back, _KIND[k]) for back, k in late + out))
        return found

    def matches(self, clause: list[tuple[int, str, float]]) -> list[tuple[int, float]]:
        """(number of a kind, weight) of a clause's matches. clause: place, symbol and weight of all but other words."""
        weights = {place: weight for place, _, weight in clause}
        state, at, found = self.start, clause[0][0], []
        for place, symbol, _ in clause:
            for k in range(at, min(place, at + REACH + AFTER)):  # other words; after so many, more of them change nothing
                state, out = self.arc(state, "other")
                found += [(kind, weights[k - back]) for back, kind in out]
            state, out = self.arc(state, symbol)
            found += [(kind, weights[place - back]) for back, kind in out]
            at = place + 1
        for k in range(at, at + AFTER):
            state, out = self.arc(state, "other")
            found += [(kind, weights[k - back]) for back, kind in out]
        return found


def clause_matches(text: str, read, machine: Composed) -> list[list[tuple[int, float]]]:
    """The matches of each clause that has some. A clause ends at a punctuation mark or a line's end."""
    tokens = _TOKEN.findall(text.lower())
    seen = read(tokens)
    found, clause, any_match = [], [], False
    for i, t in enumerate(tokens):
        if (s := seen[t]) is None:
            continue
        if s[0] == "break":
            if any_match:
                found.append(machine.matches(clause))
            clause, any_match = [], False
        else:
            clause.append((i, *s))
            any_match = any_match or s[1] > 0
    if any_match:
        found.append(machine.matches(clause))
    return found


def features(clauses: list[list[tuple[int, float]]]) -> list[float]:
    """What the regression sees: of each kind the logarithm of 1 and the weights of its matches."""
    sums = [0.0] * len(KINDS)
    for clause in clauses:
        for kind, weight in clause:
            sums[kind] += weight
    return np.log1p(sums).tolist()


def probability(g: Grammar, clauses: list[list[tuple[int, float]]]) -> float:
    x = g.bias + (float(np.dot(g.slopes, features(clauses))) if clauses else 0.0)
    return float(1 / (1 + np.exp(-min(max(x, -30.0), 30.0))))


def _terms(batches):
    """Toxic and other documents that have a word or a word beginning (with * after it)."""
    toxic, other, letters = Counter(), Counter(), 0
    schema = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("other", pa.int64())])

    def out():
        terms = list(toxic.keys() | other.keys())
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([other[t] for t in terms], pa.int64())], schema=schema)

    for batch in batches:
        for data, label in zip(utf8(batch.column("text")), batch.column("label").to_pylist(), strict=True):
            words = {t for t in _TOKEN.findall(data.decode().lower()) if t not in _BREAK}
            starts = {w[:n] + "*" for w in words for n in PREFIXES if len(w) >= n}
            counts = toxic if label else other
            counts.update(words)
            counts.update(starts)
            letters += sum(map(len, words))
            if len(toxic) + len(other) > 600_000 or letters > 1 << 26:
                yield out()
                toxic.clear()
                other.clear()
                letters = 0
    yield out()


def _contexts(wanted):
    """(term, hash of the word before, hash of the word after), each once or more, for the wanted terms."""
    schema = pa.schema([("term", pa.string()), ("before", pa.int64()), ("after", pa.int64())])

    def run(batches):
        terms, found = wanted.value, set()

        def out():
            term, before, after = zip(*found, strict=True) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(before, pa.int64()), pa.array(after, pa.int64())], schema=schema)

        for batch in batches:
            for data in utf8(batch.column("text")):
                tokens = ["", *_TOKEN.findall(data.decode().lower()), ""]
                for i, t in enumerate(tokens[1:-1], 1):
                    if t in _BREAK:
                        continue
                    hit = [x for x in (t, *(t[:n] + "*" for n in PREFIXES if len(t) >= n)) if x in terms]
                    if hit:
                        before, after = zlib.crc32(tokens[i - 1].encode()), zlib.crc32(tokens[i + 1].encode())
                        found.update((x, before, after) for x in hit)
                if len(found) > 300_000:
                    yield out()
                    found.clear()
        yield out()

    return run


def _apart(batches):
    """Terms, of rows sorted by term, with SUPPORT contexts that share neither the word before nor the one after.

    A text's copies, even with some words changed, give only few of those, however many they are.
    """
    term, before, after = None, set(), set()
    for batch in batches:
        free = []
        for t, b, a in zip(*(batch.column(k).to_pylist() for k in ("term", "before", "after")), strict=True):
            if t != term:
                term, before, after = t, set(), set()
            if len(before) < SUPPORT and b not in before and a not in after:
                before.add(b)
                after.add(a)
                if len(before) == SUPPORT:
                    free.append(t)
        yield pa.RecordBatch.from_arrays([pa.array(free, pa.string())], ["term"])


def _features(grammar: Grammar):
    def run(batches):
        read, machine = _reader(grammar), Composed()
        for batch in batches:
            rows = [features(clause_matches(x.decode(), read, machine)) for x in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.list_(pa.float64())), batch.column("label")], ["id", "x", "label"])

    return run


def longest_starts(toxic: dict[str, int]) -> list[str]:
    """Of beginnings and their toxic documents, those that no beginning longer by a letter has next to all documents of."""
    longer: dict[str, int] = {}
    for x, n in toxic.items():
        longer[x[:-1]] = max(n, longer.get(x[:-1], 0))
    return [x for x in sorted(toxic, key=len) if longer.get(x, -1) < 0.98 * toxic[x]]


def learn_lexicon(sample: DataFrame, grammar: Grammar) -> None:
    """Adds the words and word beginnings that mark toxic documents of the sample (text, label)."""
    sample = sample.groupBy("text").agg(F.max("label").alias("label"))  # copies say nothing more
    n_toxic, n = sample.agg(F.sum("label"), F.count("*")).first()
    if not n_toxic or n_toxic == n:
        return
    base = n_toxic / n
    terms = sample.mapInArrow(_terms, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    precision = F.col("toxic") / (F.col("toxic") + F.col("other"))
    # precise, and so by far more than chance: of the other documents next to none has it
    candidates = terms.filter((F.col("toxic") >= SUPPORT) & (precision >= max(0.9, (1 + base) / 2))).collect()  # each is in SUPPORT or more of SAMPLE texts
    # words of one much copied text stand between the same words each time; they say nothing about other texts
    wanted = sample.sparkSession.sparkContext.broadcast({r.term for r in candidates})
    places = sample.filter("label = 1").mapInArrow(_contexts(wanted), "term string, before long, after long")
    free = {r.term for r in places.repartition("term").sortWithinPartitions("term", "before", "after").mapInArrow(_apart, "term string").collect()}
    found = [r for r in candidates if r.term in free]
    weight = lambda r: float(min(3.0, 0.5 * np.log((r.toxic + 0.5) / (r.other + 0.5) / (base / (1 - base)))))
    starts = {r.term[:-1]: r for r in found if r.term.endswith("*")}
    grammar.starts.update((x, weight(starts[x])) for x in longest_starts({x: r.toxic for x, r in starts.items()}))
    # of words under a beginning none stays
    for r in found:
        if not r.term.endswith("*") and r.term not in grammar.words and not any(r.term[:k] in grammar.starts for k in PREFIXES):
            grammar.words[r.term] = ("insult", weight(r))


def fit_regression(rows: np.ndarray, labels: np.ndarray, prior: np.ndarray, ridge: float = 1.0) -> tuple[float, tuple[float, ...]]:
    """Bias and slopes by Newton steps, drawn towards the prior slopes; a negative slope is set to 0, so that a match never lowers a score."""
    used = list(range(rows.shape[1]))
    while True:
        x = np.column_stack([np.ones(len(rows)), rows[:, used]])
        w = mean = np.concatenate(([0.0], prior[used]))
        pull = np.diag([1e-3] + [ridge] * len(used))
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x.T * (p * (1 - p))) @ x + pull, x.T @ (labels - p) - pull @ (w - mean))
            w = w + step * min(1.0, 3.0 / max(np.abs(step).max(), 1e-9))
        negative = [k for k, v in zip(used, w[1:], strict=True) if v < 0]
        if not negative:
            break
        used = [k for k in used if k not in negative]
    slopes = np.zeros(rows.shape[1])
    slopes[used] = w[1:]
    return float(w[0]), tuple(map(float, slopes))


def fit(docs: DataFrame, labels: DataFrame) -> Grammar:
    """A grammar from docs (id, text) and labels (id, label 0/1). Ids that bear both labels count as toxic.

    Without labelled documents of both kinds the fixed words and weights stand.
    """
    grammar = seed_grammar()
    chosen = labels.filter("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    n = chosen.count()
    share = lambda most: F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < (int(0.97 * most / n * (1 << 30)) if n > most else 1 << 30)  # noqa: E731  of ids by their hashes; a little less than `most`, so that chance doesn't exceed it
    few, chosen = chosen.filter(share(FITTED)), chosen.filter(share(SAMPLE))
    sample = docs.join(F.broadcast(chosen), "id").select("text", F.col("label").cast("int").alias("label"))  # SAMPLE rows of two numbers at most
    learn_lexicon(sample, grammar)
    few = docs.join(F.broadcast(few), "id").select("id", "text", F.col("label").cast("int").alias("label")).mapInArrow(_features(grammar), "id long, x array<double>, label int")
    rows = few.groupBy("id").agg(F.max("x").alias("x"), F.max("label").alias("label")).toPandas()  # FITTED rows at most
    if rows["label"].nunique() == 2:
        grammar.bias, grammar.slopes = fit_regression(np.array(rows["x"].tolist()), rows["label"].to_numpy(dtype=float), np.array(grammar.slopes))
    return grammar


def score_texts(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """id, score, n_clauses (that match) and worst_clause of each row of id and text."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches):
        g = shared.value
        read, machine = _reader(g), Composed()
        for batch in batches:
            found = [clause_matches(x.decode(), read, machine) for x in utf8(batch.column("text"))]
            worst = [max((sum(g.slopes[k] * w for k, w in c) for c in clauses), default=0.0) for clauses in found]
            cols = [pa.array([probability(g, x) for x in found], pa.float64()), pa.array(list(map(len, found)), pa.int64()), pa.array(worst, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *cols], ["id", "score", "n_clauses", "worst_clause"])

    return docs.mapInArrow(run, "id long, score double, n_clauses long, worst_clause double")


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose texts score below threshold, by a grammar fitted on all their labels.

    Each row is judged by its own text where it is read: null ids, repeated ids and repeated rows change nothing. A null
    or empty text stays.
    """
    texts = narrow(docs, id_col, text_col).toDF("id", "text").withColumn("id", F.col("id").cast("long"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(texts, narrow(labels, id_col, label_col).toDF("id", "label").withColumn("id", F.col("id").cast("long"))))
    at = docs.columns.index(text_col)

    def run(batches):
        g = shared.value
        read, machine = _reader(g), Composed()
        for batch in batches:
            yield batch.filter(pa.array([probability(g, clause_matches(x.decode(), read, machine)) < threshold for x in utf8(batch.column(at))], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 4, held_out: int = 2, threshold: float = 0.3) -> DataFrame:
    """id, held_out, score, predicted, n_clauses, worst_clause of each row of docs; labels of held-out ids aren't used.

    A null, empty or blank text has no clause and gets the lowest score. Rows with equal ids are scored each for itself;
    repeated rows come out as they went in; a null id is as empty text in the fold. Only ids, texts and labels are read.
    """
    from .common import fold_of

    docs = narrow(docs, id_col, text_col).toDF("id", "text").withColumn("id", F.col("id").cast("long"))
    labels = narrow(labels, id_col, label_col).toDF("id", "label").withColumn("id", F.col("id").cast("long"))
    grammar = fit(docs, labels.filter(fold_of(F.col("id"), folds) != held_out))
    out = score_texts(docs, grammar)
    return out.select(
        F.col("id").alias(id_col), (fold_of(F.col("id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_clauses", "worst_clause"
    )
