"""The lake: events as JSON lines by event date, raw vendor records by source and date, the people document."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import is_high_value
from .schemas import EMPLOYEE_DOCUMENT, EVENT


def write_events(events: DataFrame, root: str, form: str = "json", mode: str = "append") -> None:
    """Appends events to dt=YYYY-MM-DD folders by the date on which they occurred. Rebalanced by size: a large day is split over tasks and files, small ones share a task."""
    rows = events.select(*EVENT.fieldNames()).withColumn("dt", F.date_format("occurred_at", "yyyy-MM-dd"))
    rows.hint("rebalance", "dt").write.partitionBy("dt").mode(mode).format(form).save(root)


def read_events(spark: SparkSession, root: str, since: Column | str | None = None, form: str = "json") -> DataFrame:
    """Events of the lake; blank lines are skipped. `since` is a date: folders before it aren't listed or read."""
    rows = spark.read.schema(EVENT).option("basePath", root).format(form).load(f"{root}/dt=*")
    return rows if since is None else rows.filter(F.col("dt") >= since)


def write_raw(records: DataFrame, root: str) -> None:
    """Raw records (source, occurred_at, source_event_id, payload) as they came, by source and event date; all of them, parsed or not."""
    rows = records.select("source", F.coalesce(F.date_format("occurred_at", "yyyy-MM-dd"), F.lit("unknown")).alias("dt"), "source_event_id", "payload")
    rows.hint("rebalance", "source", "dt").write.partitionBy("source", "dt").mode("append").parquet(root)


def read_raw(spark: SparkSession, root: str, source: str | None = None, dt: str | None = None) -> DataFrame:
    """source, dt, source_event_id, payload and the file as raw_ref; predicates on source and dt prune folders."""
    rows = spark.read.schema("source_event_id string, payload string, source string, dt string").parquet(root).withColumn("raw_ref", F.input_file_name())
    if source is not None:
        rows = rows.filter(F.col("source") == source)
    return rows if dt is None else rows.filter(F.col("dt") == dt)


def _files(spark: SparkSession, root: str):
    """Hadoop's file system of root, and a way to make its paths: deleting is a matter of names, not of rows."""
    make = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    return make(root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), make


def drop_days(spark: SparkSession, root: str, before: str) -> list[str]:
    """Removes the dt folders of days before a date, without reading them. The days that went; one row a folder is all that is looked at."""
    fs, make = _files(spark, root)
    found = fs.globStatus(make(f"{root}/dt=*"))
    days = sorted(s.getPath().getName()[3:] for s in found or [])
    gone = [d for d in days if d < before]
    for d in gone:
        fs.delete(make(f"{root}/dt={d}"), True)
    return gone


def forget(spark: SparkSession, root: str, subjects: DataFrame, key: str = "employee_id", form: str = "json") -> int:
    """Removes people's rows: only files that hold one are read whole and written anew; all others stay as they are. How many were.

    The new files are written before the old ones go, so that nothing is lost if it is cut off in between; then rows of
    both are there, which event ids tell apart. What comes to the driver are the names of the files that hold a person.
    """
    gone = subjects.select(key).distinct()
    rows = spark.read.schema(EVENT).option("basePath", root).format(form).load(f"{root}/dt=*")
    held = rows.select(key, F.input_file_name().alias("_file")).join(gone, key, "left_semi").select("_file").distinct()
    files = [r["_file"] for r in held.collect()]
    if files:
        rest = spark.read.schema(EVENT).option("basePath", root).format(form).load(files).join(gone, key, "left_anti")
        rest.write.partitionBy("dt").mode("append").format(form).save(root)
        fs, make = _files(spark, root)
        for f in files:
            fs.delete(make(f), False)
    return len(files)


def read_raw_files(spark: SparkSession, root: str) -> DataFrame:
    """Landing-zone files with one record each: payload, raw_ref, and source and dt from the folders."""
    return spark.read.schema("value string, source string, dt string").option("wholetext", True).option("basePath", root).text(f"{root}/source=*/dt=*").select(F.col("value").alias("payload"), "source", "dt", F.input_file_name().alias("raw_ref"))


def read_people(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """People of a document, and employee_id with label, which serve evaluation only."""
    document = spark.read.schema(EMPLOYEE_DOCUMENT).option("multiLine", True).json(path)
    people = document.select(F.inline("employees")).withColumn("is_high_value", is_high_value(F.col("is_executive"), F.col("handles_financial_data"), F.col("has_admin_access")))
    return people, document.select(F.explode("_generator_personas").alias("employee_id", "label"))


def people_of(table: DataFrame, tenant_id: str | None = None) -> DataFrame:
    """The dimension's columns and no others, of one tenant or all; both reach the scan, be it Parquet or JDBC."""
    rows = table.select(*[f.name for f in EMPLOYEE_DOCUMENT["employees"].dataType.elementType])
    return rows if tenant_id is None else rows.filter(F.col("tenant_id") == tenant_id)


def read_people_jdbc(spark: SparkSession, url: str, table: str, tenant_id: str | None = None, **options: str) -> DataFrame:
    return people_of(spark.read.format("jdbc").options(url=url, dbtable=table, **options).load(), tenant_id)


def snapshot(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table of people for a running stream: kept in memory and on disk, and read anew after refresh(), from the next batch on."""
    return spark.read.schema(schema).parquet(path).cache()


def refresh(spark: SparkSession, path: str) -> None:
    """To be called when files at path have changed: plans that are made from now on, those of running streams too, see what is there now."""
    spark.catalog.refreshByPath(path)


@contextmanager
def refreshed_every(spark: SparkSession, path: str, seconds: float) -> Iterator[None]:
    """While the block runs, a table that others write is refreshed at this interval."""
    done = threading.Event()

    def again() -> None:
        while not done.wait(seconds):
            refresh(spark, path)

    thread = threading.Thread(target=again, daemon=True)
    thread.start()
    try:
        yield
    finally:
        done.set()
        thread.join()


def fan_out(sinks: Sequence[Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch is computed once and given to all sinks, which must bear repeats of a batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, batch_id)
        finally:
            batch.unpersist()

    return write


def batch_folder(root: str, form: str = "parquet") -> Callable[[DataFrame, int], None]:
    """A sink that overwrites batch=N of a folder, so that a repeated batch changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").format(form).save(f"{root}/batch={batch_id:08d}")

    return write
