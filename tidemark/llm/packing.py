"""Sequence packing: first-fit decreasing in randomised groups, with a tournament tree over the bins' free space."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounds, first_tag, narrow, portions, runs, utf8
from .tokens import encoder as encoder_of, id_lists

#: Pieces of a group on average, at most; each piece has at most one sequence's ids, so a group's memory is bounded.
GROUP = 2048


class Bins:
    """Bins of equal size; first_fit() puts an item into the first that has room."""

    def __init__(self, size: int, most: int):
        self.leaves = 1 << max(0, most - 1).bit_length()
        self.free = [size] * (2 * self.leaves)  # of each leaf, and above it the largest of its two children

    def first_fit(self, length: int) -> tuple[int, int]:
        """The bin and its free space before."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < length:
                node += 1
        before = free[node]
        free[node] -= length
        at = node
        while node > 1:
            node //= 2
            largest = max(free[2 * node], free[2 * node + 1])
            if free[node] == largest:
                break
            free[node] = largest
        return at - self.leaves, before


def _pieces(path: str, end_id: int, size: int):
    def run(batches):
        encoder, tag = encoder_of(path, "words"), first_tag()
        for batch in batches:
            done = 0
            for texts in portions(utf8(batch.column("text"))):
                values, at = encoder.ids(texts, end_id)
                total = np.diff(at)
                n = -(-total // size)  # pieces of each text
                text = np.repeat(np.arange(len(texts)), n)
                start = size * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))
                first = at[text] + start
                cols = [tag + text, None, start, np.minimum(size, total[text] - start), total[text]]
                cols = [batch.column("id").take(pa.array(done + text)) if c is None else pa.array(c) for c in cols]
                yield pa.RecordBatch.from_arrays([*cols, id_lists(values, np.append(first, at[-1]))], ["tag", "id", "start", "length", "doc_tokens", "ids"])
                done += len(texts)
                tag += len(texts)

    return run


def _packed(size: int):
    def run(batches):
        for table in runs(batches, ["group"]):
            at = bounds(table, ["group"])
            length, group = table.column("length").to_numpy(), table.column("group").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                bins = Bins(size, int(hi - lo))
                for r, n in enumerate(length[lo:hi].tolist(), lo):
                    b, free = bins.first_fit(n)
                    sequence[r], offset[r] = (int(group[r]) << 24) | b, size - free
            for name, column in (("sequence_id", sequence), ("offset", offset)):
                table = table.append_column(name, pa.array(column))
            yield from table.drop_columns(["group"]).to_batches()

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, size: int = 4096, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """Pieces with their place: id, start, length, doc_tokens, ids, sequence_id, offset.

    A text's ids (null: none) and end_id are cut at every `size` ids; nothing else is cut, so that each id is in exactly
    one piece. Pieces are dealt into groups at random (by row, start and seed; equal rows go apart), and each group is
    packed on its own, longest first, ties by id and start. sequence_id is unique over all groups; offsets in a
    sequence have no gaps. padded_lengths() has the padding.
    An empty table gives no rows; repeated rows are packed as often as they occur; null ids stay null.
    """
    docs = narrow(docs, id_col, text_col).toDF("id", "text").withColumn("id", F.col("id").cast("long"))
    rows, most = docs.agg(F.count("*"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()
    groups = max(1, -(-(rows + (most or 0) // size) // GROUP))  # a text has no more ids than bytes
    parts = min(groups, max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    pieces = docs.mapInArrow(_pieces(tokenizer_path, end_id, size), "tag long, id long, start long, length long, doc_tokens long, ids array<int>")
    pieces = pieces.withColumn("group", F.pmod(F.xxhash64("tag", "start", F.lit(seed)), F.lit(groups))).drop("tag")
    placed = pieces.repartition(parts, "group").sortWithinPartitions("group", F.desc("length"), "id", "start")
    out = placed.mapInArrow(_packed(size), "id long, start long, length long, doc_tokens long, ids array<int>, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def padded_lengths(pieces: DataFrame, size: int = 4096) -> DataFrame:
    """Of each sequence: sequence_id, length, padded_length (the length where that is a power of two, else `size`)."""
    n = F.col("length")
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length")).withColumn("padded_length", F.when(n.bitwiseAND(n - 1) == 0, n).otherwise(F.lit(size)).cast("long"))
