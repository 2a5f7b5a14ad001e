"""Token ids in ORC: run-length encoded integers in stripes, with row indexes and Bloom filters on document ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import first_tag, narrow, portions, utf8
from .tokens import encoder as encoder_of, id_lists

#: Bytes of a stripe, rows between two entries of the row index, false positives of the Bloom filters.
STRIPE, STRIDE, FALSE_POSITIVES = 16 << 20, 1000, 0.01


def _encoded(path: str, end_id: int):
    def run(batches):
        encoder, part, start = encoder_of(path, "bytes"), first_tag() >> 33, 0
        for batch in batches:
            done = 0
            for texts in portions(utf8(batch.column("text"))):
                values, at = encoder.ids(texts, end_id)
                key = batch.column("id").slice(done, len(texts))
                yield pa.RecordBatch.from_arrays([key, pa.array(np.full(len(texts), part)), pa.array(start + at[:-1]), pa.array(np.diff(at)), id_lists(values, at)], ["doc_id", "part", "start_in_part", "n_tokens", "ids"])
                done += len(texts)
                start += int(at[-1])

    return run


def write_ids(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes ORC files to folder: doc_id, part, start_in_part (ids of the file before the document), n_tokens, ids.

    Files hold ascending ranges of ids and rows ascend within (nulls first; rows with equal ids in the order of the input). Each document's
    ids end with end_id, those of null and empty texts are that alone. Rows with one id may go to several files.
    """
    docs = narrow(docs, id_col, text_col).toDF("id", "text").withColumn("id", F.col("id").cast("long")).withColumn("tie", F.monotonically_increasing_id())
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = docs.repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie")
    rows = placed.mapInArrow(_encoded(tokenizer_path, end_id), "doc_id long, part long, start_in_part long, n_tokens long, ids array<int>")
    options = {"compression": "lz4", "orc.stripe.size": STRIPE, "orc.row.index.stride": STRIDE, "orc.create.index": True, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": FALSE_POSITIVES}
    rows.write.options(**options).orc(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The files' rows with start, the number of ids in all documents before. Stripes are read in parallel; of the ids' column nothing is read unless it is used."""
    rows = spark.read.schema("doc_id long, part long, start_in_part long, n_tokens long, ids array<int>").orc(folder)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row a file, so that the broadcast is small and the ids aren't shuffled
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def find_ids(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """Rows of a few documents: files, stripes and row groups whose statistics or Bloom filters rule them out aren't read."""
    return spark.read.schema("doc_id long, n_tokens long, ids array<int>").orc(folder).filter(F.col("doc_id").isin(doc_ids))
