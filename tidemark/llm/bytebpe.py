"""Byte-level BPE: ids and offsets by the tokenizers library, and the way back by the byte table."""

from __future__ import annotations

import codecs

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, portions, utf8
from .tokens import byte_characters, encoder as encoder_of, id_bytes, id_lists

#: Ids that are decoded at once.
AT_ONCE = 8192


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """id and ids (array of int) of each row; with offsets also starts and ends, in code points.

    Null and empty texts have no ids. A token that holds part of a character covers the whole of it in the offsets.
    Nothing in a text is a special token. Repeated rows and null ids pass through; other columns aren't read.
    """

    def run(batches):
        encoder = encoder_of(ranks_path, "ranks", pattern)
        for batch in batches:
            done = 0
            for texts in portions(utf8(batch.column("text"))):
                key = batch.column("id").slice(done, len(texts))
                done += len(texts)
                values, at = encoder.ids(texts)
                cols = [key, id_lists(values, at)]
                if offsets:
                    spans = np.concatenate(list(map(encoder.offsets, texts))).astype(np.int32)
                    cols += [id_lists(np.ascontiguousarray(spans[:, k]), at) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(cols, ["id", "ids", "starts", "ends"][: len(cols)])

    docs = narrow(docs, id_col, text_col).toDF("id", "text").withColumn("id", F.col("id").cast("long"))
    schema = "id long, ids array<int>" + ", starts array<int>, ends array<int>" * offsets
    return docs.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def token_bytes(ranks_path: str, pattern: str) -> list[bytes]:
    """Each id's bytes: the token's characters as the vocabulary has them, taken back through the byte table."""
    byte_of = {c: b for b, c in enumerate(byte_characters())}
    vocab = encoder_of(ranks_path, "ranks", pattern).tokenizer.get_vocab()
    table = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        table[i] = bytes(map(byte_of.__getitem__, token))
    return table


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded", at_once: int = AT_ONCE) -> DataFrame:
    """All columns, and the ids' text as out_col.

    Ids are decoded at_once at a time, so that a character split between two such pieces is put together by
    text_pieces(). Null ids decode to no text; an unknown id is an error; bytes that aren't UTF-8 become U+FFFD.
    """
    names = encoded.columns

    def run(batches):
        table = token_bytes(ranks_path, pattern)
        for batch in batches:
            out = []
            for data in id_bytes(batch.column(names.index(ids_col))):
                ids = np.frombuffer(data, dtype=np.uint32)
                pieces = (b"".join(map(table.__getitem__, ids[lo : lo + at_once].tolist())) for lo in range(0, len(ids), at_once))
                out.append("".join(text_pieces(pieces)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, type=pa.string())], [*names, out_col])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{kept}, `{out_col}` string")


def text_pieces(pieces):
    """Decoded byte pieces as text pieces: a character that is split between pieces comes out whole with the later one.

    Bytes that can't be UTF-8 become U+FFFD, an unfinished character at the end too.
    """
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for piece in pieces:
        yield decoder.decode(piece)
    if rest := decoder.decode(b"", True):
        yield rest
