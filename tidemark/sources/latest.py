"""A table that holds the latest value of each key, as a compacted topic does: buckets by key, of which a batch rewrites those it touches.

A batch is folded to one row a key before anything is read; only its buckets are read and overwritten. Folding again
what is there already changes nothing, so a batch that is repeated, even after it was cut off between two buckets,
leaves the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256


def _latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    one = F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order))
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(one.alias("_row")).select(key, "_row.*")


def merge_latest(batch: DataFrame, root: str, key: str, order: list[str], buckets: int = BUCKETS) -> None:
    """Folds rows into the table at root. Of rows of one key that with the greatest `order` stays; it must tell rows apart, by offset in the end. Rows without a key are skipped."""
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    new = _latest(batch, key, order).withColumn("bucket", bucket)
    new.persist()
    try:
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # numbers below `buckets`
        if not touched:
            return
        try:
            old = read_table(spark, root, new).filter(F.col("bucket").isin(touched))
            rows = _latest(old.unionByName(new), key, order).withColumn("bucket", bucket)
        except _Missing:
            rows = new
        # one task a bucket: a table of more rows wants more buckets
        rows.repartition(len(touched), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(root)
    finally:
        new.unpersist()


class _Missing(Exception):
    pass


def read_table(spark: SparkSession, root: str, like: DataFrame) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        raise _Missing(root)
    return spark.read.schema(like.schema).parquet(root)


def read_latest(spark: SparkSession, root: str, schema, value: str) -> DataFrame:
    """One row a key. Keys whose latest value is null have been deleted by it and aren't shown."""
    return spark.read.schema(schema).parquet(root).filter(F.col(value).isNotNull()).drop("bucket")


def latest_sink(root: str, key: str, order: list[str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch or fan_out."""
    return lambda batch, _: merge_latest(batch, root, key, order, buckets)
