"""Token ids by public tokenizers over Arrow batches.

A batch of texts is cut, as one array of bytes, where no merge can reach across, for the tokenizers' own patterns cut there
too: at white space, and between a plain word and the marks after it. Arrow numbers the distinct chunks; each goes through
the tokenizers library once while a worker remembers it; a text's ids are its chunks' ids in a row. A text
that holds one of a JSON file's special tokens goes through the library whole.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import WHITE, dictionary, word_arrays

#: First bytes of characters beyond ASCII that may be white space (Unicode White_Space).
_DOUBTFUL = np.zeros(256, dtype=bool)
_DOUBTFUL[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Letters of ASCII, second bytes of the Latin letters that begin with C3, and marks that end a plain word: those of ASCII but the apostrophe.
_LETTER, _LATIN, _MARK = (np.zeros(256, dtype=bool) for _ in range(3))
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LATIN[[*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]] = True
_MARK[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True

#: Chunks that a worker remembers, the longest of these, and chunks and plain words that go together.
REMEMBERED, LONGEST, TOGETHER, JOINED = 400_000, 64, 1_000_000, 2000


@functools.cache
def _from_json(path: str, special: bool):
    """special: whether the strings of special tokens in a text are these tokens, as the file has it, or ordinary text."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = not special
    return t


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in shown else next(free)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.cache
def _from_ranks(path: str, pattern: str):
    """A tokenizers BPE for a rank file: any two neighbours whose bytes together have a rank may merge, lowest rank first."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    ranks, char = read_ranks(path), byte_characters()
    shown = {token: "".join([char[b] for b in token]) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        for i in range(len(token) - 1, 0, -1):
            if token[:i] in shown and token[i:] in shown:
                merges.append((shown[token[:i]], shown[token[i:]]))
    t = Tokenizer(models.BPE(vocab={shown[x]: r for x, r in ranks.items()}, merges=merges))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return t


def _model_alone(t):
    """The model of a tokenizer over pieces that are parted by spaces already."""
    from tokenizers import Tokenizer, pre_tokenizers

    bare = Tokenizer(t.model)
    bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
    return bare


def _white_after(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the characters that start at these places, of several bytes each, are white space."""
    a, b, c = (data[np.minimum(at + k, len(data) - 1)] for k in range(3))
    wide = (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F)
    return (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & wide | (a == 0xE3) & (b == 0x80) & (c == 0x80)


def _plain(data: np.ndarray) -> np.ndarray:
    """Which bytes are of letters of ASCII or of Latin letters that begin with C3."""
    plain = _LETTER[data]
    at = np.flatnonzero(data[:-1] == 0xC3)
    at = at[_LATIN[data[at + 1]]]
    plain[at] = plain[at + 1] = True
    return plain


def _word_ends(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where a mark follows a plain word, with the space before it or without, that a chunk begins with. begins: where chunks do."""
    stop = np.flatnonzero(~_plain(data))
    before = np.concatenate(([-1], stop))[:-1]
    fits = (stop - before > 1) & _MARK[data[stop]]
    stop, before = stop[fits], before[fits]
    begin = begins[np.searchsorted(begins, stop, side="right") - 1]
    # only letters, from the chunk's first byte or the one after its space
    return stop[(begin < stop) & (before < begin + (data[begin] == 32))]


def _spans(starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of all these spans, one after the other."""
    return np.repeat(starts - (np.cumsum(length) - length), length) + np.arange(length.sum())


class Encoder:
    """Texts (as UTF-8 bytes) to ids; kind: "words", "bytes" (both JSON files) or "ranks" (a rank file and a pattern)."""

    def __init__(self, path: str, kind: str, pattern: str | None = None):
        self.by_space = kind == "words"
        self.tokenizer = _from_ranks(path, pattern) if kind == "ranks" else _from_json(path, False)
        self.path, self.special = path, [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # remembered chunks, the bounds of their ids, the ids, and in how many portions each was met: the seldom met are forgotten
        self.chunks, self.bounds, self.values, self.met = pa.array([], pa.binary()), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        vocab = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocab.values()) + 1, dtype=bool)  # ids that end a word, or that begin one after a space
        self.edge[[i for t, i in vocab.items() if (t.endswith("</w>") if self.by_space else t.startswith("\u0120"))]] = True
        self.line_feed = vocab.get(byte_characters()[10])
        self.bare, self.shown = _model_alone(self.tokenizer), np.array(list(map(ord, byte_characters())), dtype=np.uint16)

    def _chunks(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, the chunks' bounds in them, each text's first chunk (and the end), and which chunks are no text's."""
        if self.by_space:
            data, at, first = word_arrays(texts)
            cuts = _word_ends(data, at[:-1])
            return data, np.insert(at, np.searchsorted(at, cuts), cuts), first + np.searchsorted(cuts, at[first]), np.zeros(0, dtype=np.int64)
        data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)  # a line feed after each text
        ends = np.cumsum([len(x) + 1 for x in texts]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        white = WHITE[data]
        # before other text, the last of a run of white space belongs to it if it is a space, and else stands alone
        last = np.flatnonzero(white[:-1] & ~white[1:])
        doubt = np.flatnonzero(_DOUBTFUL[data[last + 1]])
        last = np.delete(last, doubt[_white_after(data, last[doubt] + 1)])
        mark = np.zeros(len(data) + 1, dtype=bool)
        mark[last] = mark[last[data[last] != 32] + 1] = mark[starts] = mark[ends] = True
        mark[_word_ends(data, np.flatnonzero(mark[:-1]))] = True
        first = np.flatnonzero(mark[:-1])
        return data, np.append(first, len(data)), np.append(np.searchsorted(first, starts), len(first)), np.searchsorted(first, ends)

    def _encoded(self, chunks: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of these distinct chunks: where each chunk's start in the ids, how many there are, and the ids."""
        found = pc.index_in(chunks, value_set=self.chunks)
        new = chunks.filter(found.is_null())
        found = found.fill_null(-1).to_numpy()
        known = found >= 0
        self.met[found[known]] += 1
        values, length = self._learned(new)
        ends, n = np.cumsum(length), len(self.values)
        start, size = np.empty(len(found), dtype=np.int64), np.empty(len(found), dtype=np.int64)
        start[known], size[known] = self.bounds[found[known]], np.diff(self.bounds)[found[known]]
        start[~known], size[~known] = n + ends - length, length
        everything = np.concatenate((self.values, values))
        if len(new):
            self._remember(new, length, everything)
        return start, size, everything

    def _remember(self, new: pa.BinaryArray, length: np.ndarray, values: np.ndarray) -> None:
        """values: the ids of remembered and new chunks."""
        chunks, met = pa.concat_arrays([self.chunks, new]), np.append(self.met, np.ones(len(new), dtype=np.int64))
        bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum(length)))
        kept = np.flatnonzero(pc.binary_length(chunks).to_numpy() <= LONGEST)
        if len(kept) > REMEMBERED:
            kept = np.sort(kept[np.lexsort((kept, met[kept]))[-(REMEMBERED // 2) :]])  # of chunks met as often, the last learned
            met = met - met // 2
        if len(kept) < len(chunks):
            length = np.diff(bounds)[kept]
            chunks, met, values = chunks.take(pa.array(kept)), met[kept], values[_spans(bounds[kept], length)]
            bounds = np.concatenate(([0], np.cumsum(length)))
        self.chunks, self.bounds, self.values, self.met = chunks, bounds, values, met

    def _learned(self, new: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks that aren't remembered, in a row, and how many each has."""
        n = len(new)
        if not n:
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        at = np.frombuffer(new.buffers()[1], dtype=np.int32)[new.offset : new.offset + n + 1].astype(np.int64)
        data = np.frombuffer(new.buffers()[2], dtype=np.uint8)[: at[-1]]
        letters = np.concatenate(([0], np.cumsum(_plain(data))))[at]
        spaced = data[at[:-1]] == 32
        plain = (np.diff(letters) == np.diff(at) - spaced) & (np.diff(letters) > 0)
        alone = [np.flatnonzero(~plain)]
        which, length, parts = [], [], []
        for among, mark in ((plain, None),) if self.by_space else ((plain & spaced, None), (plain & ~spaced, self.line_feed)):
            rows = np.flatnonzero(among)
            for lo in range(0, len(rows), JOINED):
                group = rows[lo : lo + JOINED]
                own = np.diff(at)[group]
                made = self._joined(data[_spans(at[group], own)], own, mark)
                if made is None:
                    alone.append(group)
                else:
                    which.append(group), parts.append(made[0]), length.append(made[1])
        alone = np.concatenate(alone)
        texts = [c.decode() for c in new.take(pa.array(alone)).to_pylist()]
        for lo in range(0, len(texts), 4 * JOINED):
            made = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts[lo : lo + 4 * JOINED], add_special_tokens=False)]
            which.append(alone[lo : lo + 4 * JOINED]), parts.extend(made), length.append(np.array(list(map(len, made)), dtype=np.int64))
        which, length = np.concatenate(which), np.concatenate(length)
        order = np.argsort(which)
        return np.concatenate(parts)[_spans((np.cumsum(length) - length)[order], length[order])], length[order]

    def _joined(self, data: np.ndarray, length: np.ndarray, mark: int | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of many plain words, each a piece of its own to the library's model, in one call; and how many each has. data: the words in a row.

        Their ids tell where a word ends, or where one begins after a space, or a mark between words does. None where they don't.
        """
        starts = np.cumsum(length) - length
        if self.by_space:  # its vocabulary is in lower case; the capitals among these Latin letters lie 32 before the small ones
            data = np.where((data >= 0x80) & (data < 0x9F) & (np.append(np.uint8(0), data[:-1]) == 0xC3) | (data >= 65) & (data <= 90), data + 32, data)
        if mark is None:
            shown = np.insert(self.shown[data], starts[1:], 32)
        else:
            shown = np.append(np.insert(self.shown[data], np.repeat(starts, 3), np.tile(np.array([32, self.shown[10], 32], dtype=np.uint16), len(starts))), np.array([32, self.shown[10]], dtype=np.uint16))[1:]
        (made,) = self.bare.encode_batch_fast([shown.astype("<u2").tobytes().decode("utf-16-le")], add_special_tokens=False)
        ids = np.array(made.ids, dtype=np.uint32)
        at = np.flatnonzero(self.edge[ids] if mark is None else ids == mark)
        if mark is not None:
            sizes = np.diff(at) - 1
            ids = ids[ids != mark]
        else:
            sizes = np.diff(at, prepend=-1) if self.by_space else np.diff(at, append=len(ids))
        return (ids, sizes) if len(sizes) == len(length) and sizes.sum() == len(ids) else None

    def ids(self, texts: list[bytes], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row (unsigned 32-bit), and the bounds of each text's. end: an id that is put after each text."""
        odd = [i for i, x in enumerate(texts) if any(s in x for s in self.special)]
        data, at, first, none = self._chunks([b"" if i in set(odd) else x for i, x in enumerate(texts)] if odd else texts)
        flat, size = [], np.zeros(len(at), dtype=np.int64)
        for lo in range(0, len(at) - 1, TOGETHER):
            chunks, which = dictionary(data, at[lo : lo + TOGETHER + 1])
            start, length, pool = self._encoded(chunks)
            own = length[which]
            own[none[(none >= lo) & (none < lo + len(own))] - lo] = 0
            flat.append(pool[_spans(start[which], own)])
            size[lo : lo + len(own)] = own
        values = np.concatenate(flat) if flat else np.zeros(0, dtype=np.uint32)
        bounds = np.concatenate(([0], np.cumsum(size)))[first]
        if odd or end is not None:
            values, bounds = self._finished(texts, values, bounds, odd, end)
        return values, bounds

    def _finished(self, texts, values, bounds, odd, end):
        """With the ids of texts that have special tokens, and the end after each."""
        if odd:
            parts = np.split(values, bounds[1:-1])
            for i in odd:
                parts[i] = np.array(_from_json(self.path, True).encode(texts[i].decode(), add_special_tokens=False).ids, dtype=np.uint32)
            values, bounds = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        if end is not None:
            values, bounds = np.insert(values, bounds[1:], np.uint32(end)), bounds + np.arange(len(bounds))
        return values, bounds

    def offsets(self, text: bytes) -> np.ndarray:
        """For each id of a text the first and the end character (code point) that it covers, whole characters where it has a part of one."""
        if self.by_space or any(s in text for s in self.special):
            raise ValueError("offsets are for texts that the tokenizer doesn't change")
        data, at, _, none = self._chunks([text])
        spans, done = [np.zeros((0, 2), dtype=np.int64)], 0
        chunks = [data[a:b].tobytes().decode() for a, b in zip(at[: none[0]], at[1:], strict=False)]
        for c, e in zip(chunks, self.tokenizer.encode_batch(chunks, add_special_tokens=False), strict=True):
            spans.append(np.array(e.offsets, dtype=np.int64).reshape(-1, 2) + done)
            done += len(c)
        return np.concatenate(spans)


@functools.cache
def encoder(path: str, kind: str, pattern: str | None = None) -> Encoder:
    """One for all tasks that a worker runs: what it remembers serves the next task, too."""
    return Encoder(path, kind, pattern)


def id_lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    """Arrow lists of 32-bit integers: the values between each two bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(np.ascontiguousarray(values).view(np.int32)))


def id_bytes(lists) -> list[memoryview]:
    """The other way: each list's ids as little-endian bytes; null is no ids."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    if lists.null_count:
        return [np.array(x or [], dtype=np.uint32).tobytes() for x in lists.to_pylist()]
    values = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype(np.uint32, copy=False)).view(np.uint8))
    ends = lists.offsets.to_numpy()
    return [values[4 * a : 4 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
