"""Lake, raw archive, people document, fan-out and stream scoring on small input."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.functions.scoring import event_id
from tidemark.operators import parsers, replay
from tidemark.sources import lake, topics
from tidemark.sources.adapter import employees, events
from tidemark.streaming import scorer

from .conftest import SMALL


def test_event_id_is_a_version_5_uuid(spark):
    import uuid

    space = uuid.UUID("6f9619ff-8b86-d011-b42d-00c04fc964ff")
    names = [("okta", f"x/{i}é") for i in range(50)]
    found = spark.createDataFrame(names, "s string, i string").select("i", event_id(F.col("s"), F.col("i")).alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(space, f"okta:{r.i}")) for r in found)


def test_people_document(spark, tmp_path):
    person = {"employee_id": "E1", "tenant_id": "acme", "is_executive": True, "email": "a@b"}
    (tmp_path / "p.json").write_text(json.dumps({"employees": [person, {**person, "employee_id": "E2", "is_executive": False, "tenant_id": "x"}], "_generator_personas": {"E1": "typical"}}, indent=1))
    people, labels = lake.read_people(spark, str(tmp_path / "p.json"))
    assert {r.employee_id: r.is_high_value for r in people.collect()} == {"E1": True, "E2": False}
    assert labels.collect() == [("E1", "typical")]
    assert [r.employee_id for r in lake.people_of(people, "acme").collect()] == ["E1"]


def test_raw_archive(spark, tmp_path):
    rows = [("okta", datetime(2026, 7, 1), "a/b", "{}"), ("okta", None, "c", "broken"), ("slack", datetime(2026, 7, 2), "d", "{}")]
    lake.write_raw(spark.createDataFrame(rows, "source string, occurred_at timestamp, source_event_id string, payload string"), str(tmp_path / "raw"))
    assert lake.read_raw(spark, str(tmp_path / "raw"), source="okta").count() == 2
    assert lake.read_raw(spark, str(tmp_path / "raw"), dt="unknown").first().payload == "broken"
    ref = spark.createDataFrame(rows[:1], "s string, t timestamp, i string, p string").select(parsers.archive_reference(F.col("s"), F.col("t"), F.col("i"), "null://")).first()[0]
    assert ref == "null://raw/source=okta/dt=2026-07-01/a_b.json"


def test_parsers_bear_broken_records(spark):
    bad = [None, "", "[]", "{}", "not json", '{"eventType": "user.password.breach_detected"}', '{"eventType": 5, "events": 7, "action": [], "telemetry_type": {}}']
    df = spark.createDataFrame([(x,) for x in bad], "payload string")
    for parse in parsers.PARSERS.values():
        found = parse(df).collect()
        assert len(found) == len(bad) and all(r.drop_reason in ("malformed", "unknown_event_type") for r in found)
    parameters = [{"name": "a", "value": "1"}, {"value": "x"}, {"name": "a", "value": "2"}]
    record = json.dumps({"id": {"time": "2026-07-01T00:00:00Z", "uniqueQualifier": "q"}, "actor": {"email": "a"}, "events": [{"name": "download", "parameters": parameters}, {"name": "authorize"}]})
    r = parsers.parse_google_workspace(spark.createDataFrame([(record,)], "payload string")).first()
    assert r.signal == "bulk_download_detected" and json.loads(r.attributes) == {"a": "2"}


def test_fan_out(spark, tmp_path):
    sinks = [lake.batch_folder(str(tmp_path / x)) for x in "ab"]
    for _ in range(2):  # a repeated batch changes nothing
        lake.fan_out(sinks)(spark.range(5), 3)
    assert spark.read.parquet(str(tmp_path / "a")).count() == 5 == spark.read.parquet(str(tmp_path / "b")).count()


def test_keyed(spark):
    r = topics.keyed(spark.createDataFrame([("E1", None)], "employee_id string, band string")).first()
    assert bytes(r.key) == b"E1" and json.loads(r.value) == {"employee_id": "E1", "band": None}


def test_stream_scores_over_two_runs(spark, tmp_path):
    """The second run goes on from the first one's state; events that come again don't count twice."""
    rows = events(spark, SMALL).select("event_id", "employee_id", "signal", "occurred_at", "ingested_at", "seq")
    people, middle = employees(spark, SMALL), F.lit("2024-01-15").cast("timestamp")
    for part in (rows.filter(F.col("occurred_at") < middle), rows.filter(F.col("occurred_at") >= middle).unionAll(rows.filter(F.col("occurred_at") >= middle + timedelta(days=14)))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        scorer.run(scorer.score_stream(stream, people, as_of="occurred_at", arrival="occurred_at", expire=False), str(tmp_path / "out"), str(tmp_path / "check"))
    found = spark.read.parquet(str(tmp_path / "out")).select("event_id", "score", "events_considered").distinct()
    batch = replay.replay_scores(rows, people).select("event_id", "score", F.col("events_considered").cast("int").alias("events_considered"))
    assert found.exceptAll(batch).count() == 0 == batch.exceptAll(found).count()


def test_forgetting_rewrites_only_files_that_hold_the_person(spark, tmp_path):
    root = str(tmp_path / "lake")
    rows = events(spark, SMALL)
    lake.write_events(rows, root)
    names = lambda: {str(p) for p in (tmp_path / "lake").rglob("*.json")}
    before, person = names(), rows.select("employee_id").first()[0]
    days = {str(r[0]) for r in rows.filter(F.col("employee_id") == person).select(F.to_date("occurred_at")).distinct().collect()}
    n = lake.forget(spark, root, spark.createDataFrame([(person,), (person,)], "employee_id string"))
    assert 0 < n <= len(before) and {p for p in before if not any(f"dt={d}" in p for d in days)} <= names()
    assert len(before - names()) == n
    left = lake.read_events(spark, root)
    assert left.filter(F.col("employee_id") == person).count() == 0
    assert left.count() == rows.filter(F.col("employee_id") != person).count()
    assert lake.forget(spark, root, spark.createDataFrame([(person,)], "employee_id string")) == 0
    gone = lake.drop_days(spark, root, "2024-01-15")
    assert gone == sorted(gone) and all(d < "2024-01-15" for d in gone) and lake.read_events(spark, root).filter("dt < '2024-01-15'").count() == 0


def test_records_of_unknown_sources_are_told(spark):
    rows = spark.createDataFrame([("fax", "{}", 1), (None, "{}", 2), ("okta", "{}", 3)], "source string, payload string, seq long")
    people = spark.createDataFrame([("E1", "a@b")], "employee_id string, email string")
    assert {r.seq: r.drop_reason for r in parsers.ingest(rows, people, "acme").collect()} == {1: "unknown_source", 2: "unknown_source", 3: "malformed"}


def test_an_unpriced_signal_is_an_error_everywhere(spark, tmp_path):
    import pytest

    rows = events(spark, SMALL).select("event_id", "employee_id", F.lit("made_up").alias("signal"), "occurred_at", "ingested_at", "seq").limit(20)
    people = employees(spark, SMALL)
    with pytest.raises(Exception, match="no price for signal made_up"):
        replay.replay_scores(rows, people).collect()
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="no price for signal made_up"):
        scorer.run(scorer.score_stream(stream, people, as_of="occurred_at", expire=False), str(tmp_path / "out"), str(tmp_path / "check"))
