"""Each operator against brute force, an exact round trip, held-out accuracy or its SQL, on small tables."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pyarrow as pa
import pytest

from tests.conftest import SMALL
from tests.test_queries import TABLES, text
from tidemark.llm import brown, bytebpe, neardup, orcids, packing, permindex, preference, quality, queries, tokens, toxicity, warc

MIDDLE = "/root/testdata/sf0.01"
WHITE = b" \t\n\r\x0b\x0c"
ODD = [None, "", "   \n\t ", "one", "One one", "a b c d e f g", "a\xa0b  \xa0 c  d\x1ce", "naïve ÉCOLE straße,fin. Mr.X don't \U0001f600\U0001f600 é", "x" * 5000, "<|endoftext|> \x01 a\x01b 12 345,6", "word, " * 3000]


def documents(spark, texts=ODD):
    rows = [(i, t, "clash", 1.0) for i, t in enumerate(texts)] + [(3, texts[3], "clash", 2.0), (None, "no id here", "clash", 3.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, score double")


@pytest.fixture(scope="module")
def table():
    return pd.read_parquet(f"{MIDDLE}/documents.parquet").assign(text=lambda d: d.text.fillna(""))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    assert text(queries.QUERIES[name](spark, SMALL).toPandas()) == text(con.execute(queries.SQL[name]).df())


# 1


def test_permutation_index_recall_and_scores(spark):
    found = queries.op1_permutation_index(spark, "/root/testdata/sf0.1").toPandas()
    t = pd.read_parquet("/root/testdata/sf0.1/embeddings.parquet")
    x, ids = np.stack(t.embedding).astype(float), t.vec_id.to_numpy()
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = (x * x[q]).sum(axis=1)
        s[q] = -9
        best = ids[np.lexsort((ids, -s))[:20]]
        own = found[found.query_id == ids[q]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        assert np.array_equal(own.score.to_numpy(), s[[np.flatnonzero(ids == i)[0] for i in own.vec_id]])
        hits += len(set(best) & set(own.vec_id))
        total += 20
    assert hits / total >= 0.9


def test_permutation_index_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = permindex.nearest(df, df.filter("vec_id = 0"), k=5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(1, 1.0), (2, 0.5)]
    assert permindex.nearest(df.filter("false"), df, k=5).count() == 0
    same = spark.createDataFrame([(i, [0.6, 0.8]) for i in range(3000)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in permindex.nearest(same, same.filter("vec_id = 2"), k=4).orderBy("rank").collect()] == [0, 1, 3, 4]


def test_footrule():
    order = np.random.default_rng(0).permuted(np.tile(np.arange(30), (50, 1)), axis=1)[:, :8]
    place = np.full((50, 30), 8)
    np.put_along_axis(place, order, np.arange(8)[None], 1)
    assert np.array_equal(permindex.InvertedFiles(order, 30).footrules(order), np.abs(place[:, None] - place[None]).sum(axis=2))


# 2, 7, 9


def plain(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(name))


def ids_of(t, x):
    return t.encode(x or "", add_special_tokens=False).ids


def test_packing(spark):
    found = packing.pack(documents(spark), P.path("word_bpe_49k.json"), 2, size=64).toPandas()
    t, seen = plain("word_bpe_49k.json"), Counter()
    for r in found.itertuples():
        whole = ids_of(t, "no id here" if pd.isna(r.doc_id) else ODD[int(r.doc_id)]) + [2]
        assert list(r.ids) == whole[r.start : r.start + r.length] and r.doc_tokens == len(whole)
        seen[None if pd.isna(r.doc_id) else int(r.doc_id)] += r.length
    assert all(seen[i] == (len(ids_of(t, x)) + 1) * (1 + (i == 3)) for i, x in enumerate(ODD))
    for _, g in found.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 64
    assert packing.pack(documents(spark).filter("false"), P.path("word_bpe_49k.json"), 2).count() == 0
    lengths = packing.padded_lengths(packing.pack(documents(spark), P.path("word_bpe_49k.json"), 2, size=64), 64).toPandas()
    assert all(r.padded_length == (r.length if r.length & (r.length - 1) == 0 else 64) for r in lengths.itertuples())


def test_first_fit():
    sizes = np.random.default_rng(1).integers(1, 101, 500).tolist()
    bins, free = packing.Bins(100, len(sizes)), []
    for n in sizes:
        at = next((i for i, f in enumerate(free) if f >= n), len(free))
        if at == len(free):
            free.append(100)
        assert bins.first_fit(n) == (at, free[at])
        free[at] -= n


def test_packing_fills(spark):
    found = queries.op2_ffd_packing(spark, MIDDLE).toPandas()
    assert found.length.sum() / (4096 * found.sequence_id.nunique()) > 0.99


def test_orc(spark, tmp_path):
    folder, t = str(tmp_path / "ids"), plain("byte_bpe_50k.json")
    orcids.write_ids(documents(spark), folder, P.path("byte_bpe_50k.json"), 0)
    found = orcids.read_ids(spark, folder).orderBy("start").collect()
    want = sorted([(i, x) for i, x in enumerate(ODD)] + [(3, ODD[3])], key=lambda r: r[0])
    want, at = [(None, "no id here"), *want], 0
    for r, (i, x) in zip(found, want, strict=True):
        assert (r.doc_id, r.start, r.ids) == (i, at, ids_of(t, x) + [0])
        at += len(r.ids)
    assert [len(r.ids) for r in orcids.find_ids(spark, folder, [4]).collect()] == [len(ids_of(t, ODD[4])) + 1]
    orcids.write_ids(documents(spark).filter("false"), folder + "2", P.path("byte_bpe_50k.json"), 0)
    assert orcids.read_ids(spark, folder + "2").count() == 0


def test_chunks_are_where_the_patterns_cut(table):
    """Chunk by chunk is as whole, for texts of many kinds."""
    rng = np.random.default_rng(5)
    alphabet = list("abZ'sét .,!“;\n\t\r\x0b\x1c\x85\xa0  　​0१Ⅷ²_-́\U0001f600中ß")
    texts = ["".join(rng.choice(alphabet, rng.integers(1, 40))) for _ in range(1500)] + table.text[:100].tolist()
    for kind, name in (("words", "word_bpe_49k.json"), ("bytes", "byte_bpe_50k.json")):
        encoder, t = tokens.Encoder(P.path(name), kind), plain(name)
        for end in (None, 7):
            values, at = encoder.ids([x.encode() for x in texts], end)
            bad = [x for x, a, b in zip(texts, at[:-1], at[1:], strict=True) if values[a:b].tolist() != ids_of(t, x) + [7] * (end == 7)]
            assert not bad, bad[:3]


def test_special_tokens_are_as_the_library_has_them():
    texts = ["hello <|endoftext|> world.", "HELLO <|ENDOFTEXT|> <|startoftext|>x", "", "<|endoftext|>", "plain text, and more"] * 3
    for kind, name in (("words", "word_bpe_49k.json"), ("bytes", "byte_bpe_50k.json")):
        values, at = tokens.Encoder(P.path(name), kind).ids([x.encode() for x in texts])
        assert [values[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [ids_of(plain(name), x) for x in texts]


def test_encoder_forgets_and_takes_parts(table, monkeypatch):
    """Few chunks remembered, few at once, one very long text: ids are the same."""
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    monkeypatch.setattr(tokens, "TOGETHER", 7)
    monkeypatch.setattr(tokens, "JOINED", 3)
    texts = [*table.text[:40], "y" * 70_000 + " \n\n" + "word, and. " * 3000, "\n \t x"]
    for kind, name in (("words", "word_bpe_49k.json"), ("bytes", "byte_bpe_50k.json")):
        values, at = tokens.Encoder(P.path(name), kind).ids([x.encode() for x in texts])
        assert [values[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [ids_of(plain(name), x) for x in texts]


def test_words_are_learned_apart_from_marks_and_often_met_ones_stay(monkeypatch):
    """A known word before another known mark is nothing new, nor is one that was met in many portions after many others."""
    monkeypatch.setattr(tokens, "REMEMBERED", 60)
    for kind, name in (("words", "word_bpe_49k.json"), ("bytes", "byte_bpe_50k.json")):
        encoder, new = tokens.Encoder(P.path(name), kind), []
        learned = encoder._learned
        monkeypatch.setattr(encoder, "_learned", lambda chunks, learned=learned, new=new: new.append(len(chunks)) or learned(chunks))
        want = lambda x, name=name: ids_of(plain(name), x)
        for x in ("one two, three. f\u00eate; \u00c9T\u00c9!", "one three, f\u00eate, two! one; three! \u00c9T\u00c9."):
            assert encoder.ids([x.encode()])[0].tolist() == want(x)
        assert sum(new[1:]) <= (kind == "bytes")  # " one" and "one" differ there
        for i in range(9):
            other = " ".join(f"w{chr(97 + i)}{chr(97 + j)}x" for j in range(20))
            assert encoder.ids([other.encode()])[0].tolist() == want(other)
            del new[:]
            encoder.ids([b"one two, three."])
            assert sum(new) == 0


@pytest.fixture(scope="module")
def judge():
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark, table, judge):
    path = P.path("byte_bpe_50k.tiktoken")
    found = bytebpe.decode(bytebpe.encode(documents(spark), path, P.PATTERN), path, P.PATTERN).collect()
    for r in found:
        x = "no id here" if r.doc_id is None else ODD[r.doc_id] or ""
        assert r.ids == judge.encode_ordinary(x) and r.decoded == x
    d = queries.op9_byte_bpe(spark, SMALL).toPandas().set_index("doc_id")
    small = pd.read_parquet(f"{SMALL}/documents.parquet")
    for i, x in zip(small.doc_id, small.text.fillna(""), strict=True):
        ids = judge.encode_ordinary(x)
        assert (d.n_tokens[i], d.ids_sha256[i], d.decoded_sha256[i]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(x.encode()).hexdigest())


def test_byte_bpe_runs_and_offsets(spark, judge):
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("aab  \n--==eé\U0001f600'"), rng.integers(1, 60))) for _ in range(1500)]
    encoder = tokens.Encoder(P.path("byte_bpe_50k.tiktoken"), "ranks", P.PATTERN)
    values, at = encoder.ids([x.encode() for x in texts])
    for x, a, b in zip(texts, at[:-1], at[1:], strict=True):
        ids, spans = values[a:b].tolist(), encoder.offsets(x.encode())
        assert ids == judge.encode_ordinary(x)
        for i, (s, e) in zip(ids, spans.tolist(), strict=True):
            piece = judge.decode_single_token_bytes(i)
            assert piece in x[s:e].encode()


def test_decoding_in_pieces(spark, judge):
    """One id at a time: characters of several tokens are put together."""
    path = P.path("byte_bpe_50k.tiktoken")
    assert bytebpe.token_bytes(path, P.PATTERN) == [judge.decode_single_token_bytes(i) for i in range(50256)]
    texts = ["\U0001f600é中" * 3, "", "plain"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    found = bytebpe.decode(bytebpe.encode(df, path, P.PATTERN, offsets=True), path, P.PATTERN, at_once=1).orderBy("doc_id").collect()
    assert [r.decoded for r in found] == texts and all(len(r.ids) == len(r.starts) == len(r.ends) for r in found)


def test_split_characters():
    data = "aé\U0001f600b".encode()
    assert "".join(bytebpe.text_pieces([data[i : i + 1] for i in range(len(data))])) == "aé\U0001f600b"
    assert list(bytebpe.text_pieces([data[:2]])) == ["a", "�"]


# 3


def test_toxicity_held_out(spark):
    d = queries.op3_toxicity_grammar(spark, "/root/testdata/sf0.1").toPandas().merge(pd.read_parquet("/root/testdata/sf0.1/labels.parquet"), on="doc_id").merge(pd.read_parquet("/root/testdata/sf0.1/documents.parquet")[["doc_id", "lang"]], on="doc_id")
    own = d[d.held_out & (d.lang == "en")]
    assert own.predicted[own.toxic == 1].mean() > 0.9 and own.predicted[own.toxic == 0].mean() < 0.05
    assert (d.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in d.doc_id]).all()


def test_transducers():
    g, machine = toxicity.seed_grammar(), toxicity.Composed()
    read = toxicity._reader(g)
    score = lambda x: toxicity.probability(g, toxicity.clause_matches(x, read, machine))
    assert score("you are an idiot") > 0.3 > score("an idiot came") > score("people said an idiot came") > score("")
    assert score("he is not an idiot") < score("he is an idiot")
    assert score("i will kill the lights") == score("") == score("a quiet day") < score("we kill you") < score("i will kill you")
    assert score("take out the trash") < 0.3 and score("what trash you are") > score("what trash this is")
    assert len(toxicity.clause_matches("idiot. fine day; moron", read, machine)) == 2


def slow_matches(symbols):
    """Kinds of a clause's matches by their definitions, machine by machine."""
    found, near = [], lambda i, s: any(x == s for x in symbols[max(0, i - toxicity.REACH) : i])
    for i, s in enumerate(symbols):
        if s in ("insult", "threat"):
            what = "meant" if s == "threat" and near(i, "intent") else s
            aimed = near(i, "target") or "target" in symbols[i + 1 : i + 1 + toxicity.AFTER]
            found.append((toxicity.KINDS.index((what, near(i, "negation"), "report" in symbols[:i], aimed)), float(i + 1)))
    return sorted(found)


def test_the_composed_machine_is_its_parts():
    rng, machine = np.random.default_rng(11), toxicity.Composed()
    names = ["other", "insult", "threat", "intent", "negation", "report", "target"]
    for _ in range(4000):
        symbols = [names[k] for k in rng.choice(7, rng.integers(1, 25), p=[0.52, 0.1, 0.1, 0.07, 0.07, 0.04, 0.1])]
        clause = [(i, s, float(i + 1) if s in ("insult", "threat") else 0.0) for i, s in enumerate(symbols) if s != "other"]
        assert sorted(machine.matches(clause) if clause else []) == slow_matches(symbols), symbols


def test_letters():
    words, starts = {"idiot": 2.0, "id": 1.0}, {"mor": 3.0, "moro": 4.0}
    machine = toxicity.Letters(words, starts)
    assert [machine.weight(x) for x in ("idiot", "idiots", "id", "i", "mor", "morals", "moron", "mo", "")] == [2.0, None, 1.0, None, 3.0, 3.0, 4.0, None, None]


def test_toxicity_scores_are_the_grammar_s(spark):
    """The query's scores, text by text, from the fitted grammar alone."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    fold = labels.filter("pmod(crc32(cast(cast(doc_id as string) as binary)), 4) <> 2")
    g = toxicity.fit(docs.selectExpr("doc_id as id", "text"), fold.selectExpr("doc_id as id", "toxic as label"))
    found = {r.doc_id: r.score for r in queries.op3_toxicity_grammar(spark, SMALL).collect()}
    read = toxicity._reader(g)
    for r in docs.collect():
        x = g.bias
        sums = Counter()
        for clause in re.split(r"[.!?;:,\n]", (r.text or "").lower()):
            tokens = re.findall(r"[^\W_]+(?:'[^\W_]+)?", clause)
            seen = read(tokens)
            symbols = [(seen[t] or ("other", 0.0))[0] for t in tokens]
            for kind, place in slow_matches(symbols):
                sums[kind] += seen[tokens[int(place) - 1]][1]
        x += sum(g.slopes[k] * math.log1p(v) for k, v in sums.items())
        assert found[r.doc_id] == pytest.approx(1 / (1 + math.exp(-min(max(x, -30), 30))), rel=1e-9)


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    found = toxicity.toxicity(documents(spark), labels).toPandas()
    assert len(found) == len(ODD) + 2 and found.score.between(0, 1).all()
    assert len(toxicity.toxicity(documents(spark), labels.filter("false")).toPandas()) == len(ODD) + 2
    assert toxicity.toxicity(documents(spark).filter("false"), labels).count() == 0


# 4


def slow_counts(x):
    words = re.findall(r"[^\x20\x09-\x0D]+", x)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [y for y in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality(spark, table):
    d = queries.op4_line_quality(spark, MIDDLE).toPandas().set_index("doc_id")
    for i, x in zip(table.doc_id, table.text, strict=True):
        assert tuple(d.loc[i][["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]]) == slow_counts(x)
    m = d.reset_index().merge(pd.read_parquet(f"{MIDDLE}/labels.parquet"), on="doc_id")
    m = m[~m.base_failed]
    assert m.kept[m.quality == 1].mean() > 0.99 and m.kept[m.quality == 0].mean() < 0.05


def test_quality_lines(spark):
    body = "This is a plain line of prose that says something and ends.\nAnother one follows it, with more to say about things."
    assert quality.clean(body) == (body, [], True)
    text_, faults, kept = quality.clean(body + "\nHome | About | Contact | More\nAccept all cookies\nAll rights reserved.")
    assert text_ == body and [r for _, r in faults] == ["navigation", "boilerplate", "notice"] and kept
    assert not quality.clean("a | b | c | d | e | f\ng | h | i | j")[2]
    found = quality.quality_rules(documents(spark)).toPandas()
    assert len(found) == len(ODD) + 2 and found.base_failed[0] and not found.kept[0]
    for x, r in zip(ODD, found.itertuples(), strict=False):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == slow_counts(x or "")
    assert quality.quality_rules(documents(spark).filter("false")).count() == 0


# 5


def test_preferences(spark):
    turn = lambda r, t: {"role": r, "text": t}
    a = [turn("user", "hi"), turn("assistant", "yes"), turn("user", None)]
    rows = [(1, a, [*a[:1], turn("assistant", "no")]), (2, a, a), (3, None, a), (4, [], None), (5, a[:1], a)]
    df = spark.createDataFrame(rows, "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    found = {r.pair_id: r for r in preference.format_preferences(df).collect()}
    assert [found[i].n_prompt_turns for i in range(1, 6)] == [1, 3, 0, 0, 1]
    assert found[1].prompt == "<|user|>\nhi<|end|>\n" and found[1].rejected == "<|assistant|>\nno<|end|>\n"
    assert found[2].chosen == "" == found[2].rejected and found[3].prompt == ""
    for r in found.values():
        for done, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            assert sum(m.length for m in mask) == len(done)
    at, kept = 0, ""
    for m in found[1].chosen_mask:
        kept += found[1].chosen[at : at + m.length] if m.loss else ""
        at += m.length
    assert kept == "yes<|end|>\n"


# 6


def slow_components(ids, texts, words, percent=80):
    sets = []
    for x in texts:
        w = (x or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    index, pairs = defaultdict(list), Counter()
    for i, s in enumerate(sets):
        for x in s:
            index[x].append(i)
    for found in index.values():
        if len(found) <= 400:
            pairs.update(combinations(found, 2))
    group = {i: i for i in ids}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for (i, j), both in pairs.items():
        n = len(sets[i]) + len(sets[j])
        if n < 9 * both and 100 * sum(x in sets[j] for x in sets[i]) >= percent * (n - sum(x in sets[j] for x in sets[i])):
            a, b = sorted((find(ids[i]), find(ids[j])))
            group[b] = a
    return {i: (len(s), find(i)) for i, s in zip(ids, sets, strict=True)}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, table, words):
    df = spark.createDataFrame(table[["doc_id", "text"]])
    found = neardup.near_duplicates(df, shingle_words=words).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == slow_components(table.doc_id.tolist(), table.text.tolist(), words)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicates_of_a_hot_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "KEY_BLOCK", 16)
    monkeypatch.setattr(neardup, "FAMILY_BLOCK", 16)
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(120):
        w = list(base)
        for k in rng.integers(0, 120, rng.integers(1, 7)):
            w[k] = f"x{rng.integers(10**6)}"
        texts.append(" ".join(w))
    texts += [texts[0].upper()] * 30
    found = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shingle_words=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == slow_components(list(range(len(texts))), texts, 2)


def test_near_duplicates_odd_rows(spark):
    found = neardup.near_duplicates(documents(spark, [*ODD, "ONE", "one  \n"]), shingle_words=2).toPandas()
    assert len(found) == len(ODD) + 4
    by = {r.doc_id: r for r in found.itertuples() if r.doc_id == r.doc_id}
    assert by[0].n_shingles == by[1].n_shingles == by[2].n_shingles == 0 and by[0].kept and by[2].kept
    assert by[len(ODD)].component_id == by[len(ODD) + 1].component_id == 3
    assert found[found.doc_id.isna()].kept.all()
    assert neardup.near_duplicates(documents(spark).filter("false")).count() == 0
    kept = neardup.keep_one_of_each(documents(spark, [*ODD, "ONE", "one  \n"]), shingle_words=2)
    assert kept.columns == ["doc_id", "text", "id", "score"] and kept.filter("doc_id >= 11").count() == 0


# 8


def test_warc_round_trip_with_copies(spark):
    long = "é" * 60
    rows = [(5, "u\r\nv", long), (2, None, long), (9, "w", long), (1, "x", "short"), (3, "x", "short"), (4, "y", None), (None, "z", long), (2, None, long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = warc.read_archives(warc.write_archives(warc.first_of_equal(df))).toPandas()
    assert found.reason.isna().all() and len(found) == len(rows)
    kinds = Counter(zip(found.record_id, found.record_type, found.refers_to.fillna(""), strict=True))
    assert kinds["<urn:page:5>", "revisit", "<urn:page:2>"] == 1 == kinds["<urn:page:9>", "revisit", "<urn:page:2>"]
    assert kinds["<urn:page:2>", "response", ""] == 2 and kinds["<urn:page:>", "response", ""] == 1 and kinds["<urn:page:3>", "response", ""] == 1
    assert set(found.payload_length) == {120, 5, 0}
    assert warc.read_archives(warc.write_archives(warc.first_of_equal(df.filter("false")))).count() == 0


def members(n, packed=True):
    out = []
    for i in range(n):
        payload = f"payload {i} ".encode() * 30
        record = warc.record_bytes(i, f"u{i}", payload, hashlib.sha256(payload).hexdigest(), "response", None)
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(pack.compress(record) + pack.flush() if packed else record)
    return out


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    parts = members(6, packed)
    hurt = bytearray(parts[2])
    hurt[len(hurt) // 2] ^= 0xFF
    data = b"junk" + parts[0] + parts[1] + bytes(hurt) + parts[3] + b"\x00" * 50 + parts[4] + parts[5][:-9]
    reader = warc.Salvage(warc.BytesSource(data))
    found = list(reader.records())
    assert [h["warc-record-id"] for _, _, h, _ in found] == [f"<urn:page:{i}>" for i in (0, 1, 3, 4)]
    inside = [(s, e) for s, e, *_ in found] + [(s, e) for s, e, _ in reader.gaps]
    assert sorted(inside)[0][0] == 0 and sorted(inside)[-1][1] == len(data) and sum(e - s for s, e in inside) == len(data)
    assert len(reader.gaps) == 4
    whole = warc.Salvage(warc.BytesSource(b"".join(parts)))
    assert len(list(whole.records())) == 6 and not whole.gaps
    empty = warc.Salvage(warc.BytesSource(b""))
    assert not list(empty.records()) and not empty.gaps


# 10


def test_brown(spark, table):
    found = queries.op10_brown_classes(spark, MIDDLE).toPandas().set_index("doc_id")
    words = {i: [*x.encode().lower().split(), None] for i, x in zip(table.doc_id, table.text, strict=True)}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    count = Counter(w for i, ws in words.items() if not out[i] for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in words.items():
        r = found.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(ws), sum(w in count for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
    own = found[found.held_out]
    assert own.score.sum() > own.base_score.sum() and (found.score < 0).all()


def test_brown_is_a_distribution(spark):
    """Over all known words, the end, and one unknown word for each group, which has all that its group leaves to unknown words."""
    texts = ["the cat sat", "the dog sat down", "a cat ran", "the cat ran away now", "dogs bark", "the mouse hid"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    model, words = brown.train(docs)
    known = sorted({w for x in texts for w in x.split()})
    strange = {}
    for k in range(20_000):
        strange.setdefault(brown._group(f"q{k}".encode()), f"q{k}")
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    rows = [(i, w) for i, w in enumerate([*known, *strange.values(), ""])]
    found = brown.score(spark.createDataFrame(rows, "id long, text string"), model, words).toPandas().set_index("id").score
    # P(word, end) is P(word) * P(end | word): divided by the latter, the words' probabilities and the end's add up to 1
    total = 0.0
    for i, w in rows:
        s = model.end if not w else model.frequent.get(brown._hash(w.encode()), brown.WORDS + brown._group(w.encode()))
        last = 0.0 if not w else model.transition[model.of[s], model.of[model.end]] + model.emission[model.end]
        total += 10 ** (found[i] - last)
    assert abs(total - 1) < 1e-6


def test_brown_exchange_raises_the_likelihood():
    rng = np.random.default_rng(3)
    n = rng.integers(0, 50, (8, 8)).astype(float)
    right, left = n[2] * 0.3, n[:, 2] * 0.3
    to, gain = brown.best_class(2, right, left, n)
    assert gain >= 0 and 0 <= to < 8


def test_brown_words_outside_the_core_get_their_own_class(spark):
    """Two rare words of one group of last bytes get the classes of the frequent words in whose places they stand."""
    rng = np.random.default_rng(5)
    nouns, verbs = ["cat", "dog", "cow"], ["eats", "sees", "hears"]
    texts = [f"the {rng.choice(nouns)} {rng.choice(verbs)} a {rng.choice(nouns)}" for _ in range(4000)]
    texts += ["the zzending eats a dog"] * 9 + ["the cat yyending a dog"] * 9
    texts += [" ".join(f"w{k}" for k in rng.permutation(4200)) for _ in range(12)]  # fills the core
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    assert brown._group(b"zzending") == brown._group(b"yyending")
    model, classed = brown.train(docs)
    of = {r.h: (r.c, r.k) for r in classed.collect()}
    noun, verb = of[brown._hash(b"zzending")], of[brown._hash(b"yyending")]
    assert noun[0] == verb[0] == 9 and noun[1] != verb[1]
    asked = spark.createDataFrame([(0, "the zzending eats a dog"), (1, "the yyending eats a dog"), (2, "the cat yyending a dog"), (3, "the cat zzending a dog")], "id long, text string")
    found = brown.score(asked, model, classed).toPandas().set_index("id").score
    assert found[0] > found[1] and found[2] > found[3]
    model.known, model.classes = {h: c for h, c in model.known.items() if h in model.frequent or h == brown.END}, {}
    joined = brown.score(asked, model, classed).toPandas().set_index("id").score
    assert np.allclose(joined.sort_index(), found.sort_index())


def test_brown_a_place_outside_the_core_is_one_row():
    """Counts of a word's places by both classes beside it, against a plain loop: no more rows than kinds of places."""
    import xxhash

    words = [f"w{i * i}" for i in range(60)] + ["z", "\u00e9"]
    assert brown._hashes([w.encode() for w in words]).tolist() == [int.from_bytes(xxhash.xxh64_digest(w.encode()), "big", signed=True) & ~1 for w in words]
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(words, rng.integers(0, 30))) for _ in range(300)]
    frequent = {brown._hash(w.encode()): i for i, w in enumerate(words[:20])}
    of = rng.integers(0, brown.CLASSES, brown.WORDS + brown.GROUPS + 1)
    model = brown.Model(1, 1, 0.5, frequent, {}, np.zeros(brown.GROUPS), of=of)
    want = {}
    for x in texts:
        s = [model.end, *[frequent.get(brown._hash(w.encode()), brown.WORDS + brown._group(w.encode())) for w in x.split()], model.end]
        for i, w in enumerate(x.split(), 1):
            if s[i] >= brown.WORDS:
                place = (brown._hash(w.encode()), s[i] - brown.WORDS, int(of[s[i - 1]]), int(of[s[i + 1]]))
                want[place] = want.get(place, 0) + 1
    shared = type("Shared", (), {"value": model})
    rows = pa.Table.from_batches(brown._contexts(shared)([pa.RecordBatch.from_pydict({"text": texts})])).to_pylist()
    k = brown.CLASSES
    found = {(r["h"], r["x"] // k**2, r["x"] // k % k, r["x"] % k): r["c"] for r in rows}
    assert len(rows) == len(want) and found == want


def test_brown_odd_rows(spark):
    found = brown.class_model_scores(documents(spark)).toPandas()
    assert len(found) == len(ODD) + 2 and found.score.lt(0).all() and (found.n_tokens >= 1).all()
    assert brown.class_model_scores(documents(spark).filter("false")).count() == 0


# pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_dedup", "packing"]
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, MIDDLE)
        ids, before = {r.doc_id for r in after.select("doc_id").collect()}, docs.toPandas()
        assert after.columns == docs.columns and ids < set(before.doc_id)
        gone = before[~before.doc_id.isin(ids)]
        if name == "quality_rules":
            assert set(gone.doc_id) == {i for i, x in zip(before.doc_id, before.text, strict=True) if quality.base_counts((x or "").encode())[-1] or not quality.clean(x or "")[2]}
        if name == "near_dedup":
            assert ids == {c for _, c in slow_components(before.doc_id.tolist(), before.text.tolist(), 5).values()}
        docs = spark.createDataFrame(after.toPandas(), after.schema)
    packed = corpus_pipeline.pack_sequences(spark, docs, MIDDLE)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
