"""Texts whose bytes aren't UTF-8 (a cast from binary makes them) are read with U+FFFD in their place and lose no job."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bytebpe, orcids, packing, quality, toxicity
from tidemark.llm.common import new_folder, read_table

BAD = b"\xff\x61 \xc3( bad\xe9 ten words of text are here to be read as they are."
MENDED = BAD.decode("utf-8", "replace")


@pytest.fixture
def pairs(spark):
    """The bad text and, as another row, what it is read as."""
    return spark.createDataFrame([(1, BAD), (2, MENDED.encode())], "doc_id long, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"))


def _same(rows):
    one, two = sorted(rows, key=lambda r: r[0])
    assert tuple(one)[1:] == tuple(two)[1:]


def test_quality_and_encoders(spark, pairs):
    _same(quality.quality_rules(pairs).collect())
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    told = bytebpe.decode(bytebpe.encode(pairs, ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN)
    rows = told.select("doc_id", "ids", "decoded").collect()
    _same(rows)
    assert rows[0]["decoded"] == MENDED
    _same(packing.pack(pairs, public_tokenizers.path("word_bpe_49k.json"), end_id=2).select("doc_id", "ids", "doc_tokens").collect())
    folder = new_folder(spark, "bad-utf8")
    orcids.write_ids(pairs, folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    _same(orcids.read_ids(spark, folder).select("doc_id", "ids").collect())


def test_toxicity(spark, pairs):
    docs, labels = (read_table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "labels"))
    both = docs.select("doc_id", "text").unionByName(pairs.withColumn("doc_id", F.col("doc_id") + 10_000_000))
    found = toxicity.toxicity(both, labels).filter("doc_id > 10000000").select("doc_id", "score").collect()
    _same(found)
