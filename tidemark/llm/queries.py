"""One query for each operator of this subpackage, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

import zlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, bytebpe, collocations, licences, neardup, orcids, packing, permindex, preference, prefixtrie, quality, toxicity, warc
from .common import new_folder, read_table
from .tokens import id_bytes


def with_crc32(df: DataFrame, ids_col: str = "ids") -> DataFrame:
    """ids_crc32 (unsigned, of the ids as little-endian unsigned 32-bit integers) in place of the ids."""
    names = df.columns

    def run(batches):
        for batch in batches:
            crc = pa.array([zlib.crc32(x) for x in id_bytes(batch.column(names.index(ids_col)))], type=pa.int64())
            yield pa.RecordBatch.from_arrays([crc if n == ids_col else batch.column(i) for i, n in enumerate(names)], ["ids_crc32" if n == ids_col else n for n in names])

    return df.mapInArrow(run, ", ".join("ids_crc32 long" if f.name == ids_col else f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth vector."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return permindex.nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op2_ffd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 4096 tokens."""
    return with_crc32(packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2))


def op3_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of documents, learned from the labels outside the held-out fold."""
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdicts of line-first cleaning."""
    return quality.quality_rules(read_table(spark, sf_dir, "documents"), with_text=False).drop("clean_text", "faults")


def op5_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations against the same with another's ending, formatted as prompt and two masked completions."""
    rows = preference.format_preferences(preference.with_borrowed_endings(preference.conversations_of(read_table(spark, sf_dir, "conversations"))))
    counted = lambda mask: F.aggregate(mask, F.lit(0).cast("long"), lambda n, run: n + F.when(run["loss"], run["length"]).otherwise(0))
    return rows.select("pair_id", "n_prompt_turns", "prompt", "chosen", "rejected", counted("chosen_mask").alias("chosen_loss_chars"), counted("rejected_mask").alias("rejected_loss_chars"))


def op6_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of documents on two-word shingles."""
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), shingle_words=2)


def op7_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written as ORC and read back."""
    folder = new_folder(spark, "token-ids")
    orcids.write_ids(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return with_crc32(orcids.read_ids(spark, folder))


def op8_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives and read back by the salvage reader."""
    rows = warc.read_archives(warc.write_archives(warc.first_of_equal(read_table(spark, sf_dir, "pages")))).filter("reason is null")
    number = lambda c: F.expr(f"try_cast(substring({c}, 11, length({c}) - 11) as long)")  # noqa: E731  <urn:page:7>
    digest = F.when(F.col("record_type") == "revisit", F.regexp_replace("digest", "^sha256:", "")).otherwise(F.sha2("payload", 256))
    return rows.select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded by byte-level BPE and decoded again."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = bytebpe.decode(bytebpe.encode(read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op10_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of documents by a class-based model, and by the base model."""
    return brown.class_model_scores(read_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best collocations of each language."""
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def op12_licence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that documents name or quote."""
    return licences.licences(read_table(spark, sf_dir, "documents")).drop("matches")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return prefixtrie.prefix_trie(read_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_permutation_index, op2_ffd_packing, op3_toxicity_grammar, op4_line_quality, op5_preference_pairs, op6_bbit_minhash, op7_orc_token_ids, op8_warc_salvage, op9_byte_bpe, op10_brown_classes, op11_collocations, op12_licence_index, op13_prefix_trie)}

SQL: dict[str, str] = {
    "op5_preference_pairs": preference.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op13_prefix_trie": prefixtrie.ORACLE,
    "op8_warc_salvage": """
        with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
             d as (select page_id, octet_length(payload)::bigint as payload_bytes, sha256(payload) as payload_digest from p),
             f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as first from d)
        select page_id, payload_bytes, payload_digest,
               case when first < page_id then 'revisit' else 'response' end as record_type,
               case when first < page_id then first end as refers_to
        from f""",
}
