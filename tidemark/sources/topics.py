"""Topics: Kafka where its package is on the cluster, and folders of message-shaped files in tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import MESSAGE


def read_stream(spark: SparkSession, servers: str, topic: str, from_beginning: bool = True, per_batch: int | None = None) -> DataFrame:
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest" if from_beginning else "latest", "includeHeaders": "true"}
    if per_batch:
        options["maxOffsetsPerTrigger"] = str(per_batch)
    return spark.readStream.format("kafka").options(**options).load()


def read_batch(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """All messages of a topic with key, value, partition and offset, for audits and snapshots."""
    return spark.read.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic}).load()


def read_folder(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(MESSAGE)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def keyed(rows: DataFrame, key: str = "employee_id") -> DataFrame:
    """key and value (JSON) of rows, as a topic takes them: all of one person's messages go to one partition."""
    return rows.select(F.col(key).cast("binary").alias("key"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).cast("binary").alias("value"))


def write_batch(rows: DataFrame, servers: str, topic: str) -> None:
    """key, value and, where there are some, headers. Producers are idempotent and wait for all replicas."""
    options = {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.compression.type": "lz4", "kafka.acks": "all", "kafka.enable.idempotence": "true", "includeHeaders": str("headers" in rows.columns).lower()}
    rows.write.format("kafka").options(**options).save()
