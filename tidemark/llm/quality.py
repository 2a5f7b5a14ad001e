"""Line-first cleaning: rules judge each line, failing lines go, and a text that loses too much is rejected."""

from __future__ import annotations

import re
from collections import Counter
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, utf8

#: Share of a text's words that failing lines may hold.
MOST_LOST = 0.5
#: Words from which a line counts as prose: it may break off without an end mark, but not be without any mark.
PROSE = 8

# Characters that end a sentence or a quotation, that part menu entries, and that count as symbols.
_ENDS = tuple(".!?:;…。！？\"'”’»)]")
_MENU = re.compile(r"\s[|»›·•>]\s|^[|»›·•>]\s|\s[|»›·•>]$")
_MARKS = re.compile(r"[.!?:;,…。！？，、;\"'”’»)\]-]")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Each phrase below has one of these in it, which is quicker to look for.
_HINTS = ("all rights", "licen", "copyright", "terms of", "policy", "cookies", "javascript", "subscribe", "sign in", "sign up", "login", "log in", "click here", "share ", "read more", "lorem")
_NOTICE = re.compile(r"all rights reserved|licen[sc]ed under|released under the .* licen[sc]e|copyright (?:\(c\)|©|\d)", re.IGNORECASE)
_BOILERPLATE = re.compile(
    r"terms of (?:use|service)|privacy policy|cookie policy|accept (?:all )?cookies|enable javascript|subscribe to our|sign (?:in|up)\b.{0,20}$|log ?in\b.{0,12}$|click here|share (?:this|on)|read more\W*$|lorem ipsum",
    re.IGNORECASE,
)


#: Words of a sentence that are judged together.
PIECE = 20
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\s[|»›·•]\s")


def _phrase(piece: str) -> str | None:
    if _BOILERPLATE.search(piece):
        return "boilerplate"
    return "notice" if _NOTICE.search(piece) else None


def _phrase_fault(line: str) -> str | None:
    """The rule by which more than half of a line's words fail, by sentence (pieces of PIECE words of it) whatever the line's length."""
    if not any(map(line.lower().__contains__, _HINTS)):
        return None
    lost, total = Counter(), 0
    for sentence in _SENTENCE.split(line):
        words = sentence.split()
        for i in range(0, len(words), PIECE):
            n = len(words[i : i + PIECE])
            total += n
            lost[_phrase(" ".join(words[i : i + PIECE]))] += n
    del lost[None]
    return lost.most_common(1)[0][0] if 2 * sum(lost.values()) > total else None


def line_fault(line: str) -> str | None:
    """The first rule that a line with a word fails, or None."""
    words = line.split()
    n = len(words)
    if n == 0:
        return None
    if len(_SYMBOLS.findall(line)) > 0.3 * n:
        menu = len(_MENU.findall(line))
        return "navigation" if menu > 0.2 * n else "symbols"
    if fault := _phrase_fault(line):
        return fault
    if n >= 4:
        if line.count("!! ") + line.count("?? ") > 0.3 * n:
            return "shouting"
        if n >= PROSE and sum(map(str.isupper, words)) > 0.6 * n:
            return "shouting"
        if n >= PROSE and sum(map(eq, words, words[1:])) > 0.3 * n:
            return "stutter"
    if n >= 2 and n < PROSE and not line.rstrip().endswith(_ENDS) and n * 2 <= len(_MENU.findall(line)) * 3:
        return "navigation"
    if n < 3 and not line.rstrip().endswith(_ENDS):
        return "navigation"
    if n >= PROSE and not _MARKS.search(line):
        return "unpunctuated"
    return None


def clean(text: str) -> tuple[str, list[tuple[int, str]], bool]:
    """The text without failing lines, (number of a failing line, rule) for each, and whether it is kept.

    A line that fails, notices of rights and licences too, counts with its words as lost; so does one that repeats an
    earlier line of PROSE words or more.
    """
    lines = text.split("\n")
    faults, lost, total, seen = [], 0, 0, set()
    for i, line in enumerate(lines):
        n = len(line.split())
        fault = line_fault(line)
        total += n
        if fault is None and n >= PROSE and line in seen:
            fault = "repeated"
        seen.add(line)
        if fault:
            faults.append((i, fault))
            lost += n
    gone = {i for i, _ in faults}
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), faults, lost <= MOST_LOST * total


def base_counts(data: bytes) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    words = data.split()
    n = len(words)
    chars = len(b"".join(words).decode())
    symbols = sum(map(data.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    repeats = 0
    if n >= 6:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        if len(set(windows)) < len(windows):
            times, covered = Counter(windows), -1
            for i, w in enumerate(windows):
                if times[w] > 1:
                    repeats += i + 5 - max(i, covered)
                    covered = i + 5
    lines = [x for x in data.split(b"\n") if x.strip()]
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, n < 10 or 100 * repeats > 20 * n


_OUT = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("clean_text", pa.string()), ("faults", pa.list_(pa.struct([("line", pa.int32()), ("rule", pa.string())])))]


def _judged(with_text: bool):
    def run(batches):
        for batch in batches:
            rows = []
            for data in utf8(batch.column("text")):
                counts = base_counts(data)
                text, faults, kept = clean(data.decode())
                rows.append((*counts, kept and not counts[-1], text if with_text else None, faults if with_text else None))
            if rows:
                cols = [pa.array(c, type=t) for c, (_, t) in zip(zip(*rows, strict=True), _OUT, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *cols], ["id", *[n for n, _ in _OUT]])

    return run


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, all columns, with the text that cleaning leaves in place of text_col.

    Each row is judged by its own text where it is read: nulls elsewhere, repeated rows and repeated ids change nothing.
    """
    at, names, kind = docs.columns.index(text_col), docs.columns, docs.schema

    def run(batches):
        for batch in batches:
            taken, texts = [], []
            for i, data in enumerate(utf8(batch.column(at))):
                if not base_counts(data)[-1]:
                    text, _, kept = clean(data.decode())
                    if kept:
                        taken.append(i)
                        texts.append(text)
            rest = batch.take(pa.array(taken, type=pa.int64()))
            cols = [pa.array(texts, type=pa.string()) if k == at else c for k, c in enumerate(rest.columns)]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, kind)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Per row: id, base counts, base_failed, kept, clean_text and faults (line, rule); the last two null without with_text.

    A null text is an empty one: no words, so base_failed. Lines end at \\n alone. Repeated rows, null ids and ties come
    out as they went in; other columns aren't read. Texts are judged whole, whatever their length.
    """
    docs = narrow(docs, id_col, text_col).toDF("id", "text").withColumn("id", F.col("id").cast("long"))
    schema = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, clean_text string, faults array<struct<line: int, rule: string>>"
    return docs.mapInArrow(_judged(with_text), schema).withColumnRenamed("id", id_col)
