"""Runs of streams: duplicates told, counters heard, limits kept, sinks that fail half way, latest values."""

import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.sources import lake, latest
from tidemark.sources.schemas import MESSAGE
from tidemark.sources.topics import read_folder
from tidemark.streaming import bounded, counters, normalizer, scorer

from .test_normalizer import BASE, NOW


def _message(i):
    return json.dumps({**BASE, "event_id": i}).encode()


def test_duplicates_are_told_and_forgotten_after_a_week(spark, tmp_path):
    """Seven days run from the first message and duplicates don't prolong them; the counters of two runs are those of all messages."""
    days = [("a", 0), ("b", 0), ("a", 3), ("a", 6.9), ("a", 7), ("a", 8), ("b", 20), ("c", 20)]
    rows = [(b"k", _message(i), "t", 0, k, NOW + timedelta(days=d)) for k, (i, d) in enumerate(days)] + [(b"k", b"broken", "t", 0, 90 + k, NOW) for k in range(2)]
    with counters.following(spark) as totals:
        for part in (rows[:3] + rows[8:], rows[3:8]):
            spark.createDataFrame(part, MESSAGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "topic"))
            stream = normalizer.with_counters(normalizer.tagged_stream(read_folder(spark, str(tmp_path / "topic")), expire=False))
            query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
            query.awaitTermination()
            totals.after(query)
    found = {r.offset: r.outcome for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert [found[k] for k in range(8)] == ["emitted", "emitted", "duplicate", "duplicate", "emitted", "duplicate", "emitted", "emitted"]
    assert found[90] == found[91] == "dead_lettered"
    assert totals.sums["normalizer"] == {"total": 10, "emitted": 5, "duplicate": 3, "dead_lettered": 2, "forwarded_unknown_version": 0}


def _numbers(spark, folder, files):
    for k in range(files):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(folder)


def test_run_stops_at_its_limit_and_goes_on(spark, tmp_path):
    _numbers(spark, str(tmp_path / "in"), 5)
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = lambda **k: bounded.run_bounded(stream(), lake.batch_folder(str(tmp_path / "out")), str(tmp_path / "check"), **k)
    assert run(most=15, idle_seconds=None) == 20  # the batch that passes the limit is the last
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
    assert run(idle_seconds=2.0) == 30
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(50))
    with pytest.raises(ValueError, match="most or idle"):
        run(idle_seconds=None)


def test_a_sink_that_fails_between_two_writes(spark, tmp_path):
    """The batch is repeated by the next run, and both outputs are those of a run that nothing disturbed."""
    _numbers(spark, str(tmp_path / "in"), 2)
    failed = []

    def second(batch, batch_id):
        if not failed:
            failed.append(batch_id)
            raise OSError("disk gone")
        lake.batch_folder(str(tmp_path / "b"))(batch, batch_id)

    write = lake.fan_out([lake.batch_folder(str(tmp_path / "a")), second])
    start = lambda: spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="disk gone"):
        start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "a")).count() == 20 and not (tmp_path / "b").exists()
    start().awaitTermination()
    for x in "ab":
        assert sorted(r.id for r in spark.read.parquet(str(tmp_path / x)).collect()) == list(range(20))


def test_latest_value_of_each_key(spark, tmp_path):
    """Only touched buckets are rewritten; older rows, repeats and null keys change nothing; a null value deletes."""
    root, schema = str(tmp_path / "latest"), "k string, at long, v double"
    merge = lambda rows: latest.merge_latest(spark.createDataFrame(rows, schema), root, "k", ["at"], buckets=4)
    merge([])
    first = [("a", 1, 1.0), ("a", 3, 3.0), ("b", 1, 5.0), (None, 1, 9.0)]
    for rows in (first, first, [("a", 2, 2.0), ("c", 1, 7.0)]):
        merge(rows)
    table = lambda: sorted(tuple(r) for r in latest.read_latest(spark, root, f"{schema}, bucket int", "v").collect())
    assert table() == [("a", 3, 3.0), ("b", 1, 5.0), ("c", 1, 7.0)]
    bucket = {r.k: r.b for r in spark.createDataFrame([("a",), ("b",), ("c",)], "k string").select("k", F.pmod(F.xxhash64("k"), F.lit(4)).alias("b")).collect()}
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "latest").rglob("*.parquet")}
    before = files()
    merge([("b", 2, None)])
    untouched = [p for p in before if f"bucket={bucket['b']}" not in p]
    assert all(files()[p] == before[p] for p in untouched)
    assert [r[0] for r in table()] == ["a", "c"]


def test_people_are_read_anew_at_each_batch(spark, tmp_path):
    """A person added between two batches of one running query is scored from the second on."""
    schema = "event_id string, employee_id string, signal string, occurred_at timestamp, ingested_at timestamp, seq long"
    rows = lambda i: spark.createDataFrame([(f"{i}{p}", p, "phish_sim_clicked", NOW, NOW, 1) for p in ("E1", "E2")], schema).coalesce(1)
    people = lambda names: spark.createDataFrame([(n, False) for n in names], "employee_id string, is_high_value boolean").coalesce(1)
    people(["E1"]).write.parquet(str(tmp_path / "people"))
    rows("x").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    scores = scorer.score_stream(stream, lake.snapshot(spark, str(tmp_path / "people"), "employee_id string, is_high_value boolean"), as_of="occurred_at", expire=False)
    query = scores.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        query.processAllAvailable()
        people(["E2"]).write.mode("append").parquet(str(tmp_path / "people"))
        lake.refresh(spark, str(tmp_path / "people"))
        rows("y").write.mode("append").parquet(str(tmp_path / "in"))
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["xE1", "yE1", "yE2"]
