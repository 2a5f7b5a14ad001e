"""Every outcome of the normalizer, batch and stream."""

import json
from datetime import datetime, timedelta, timezone

from tidemark.operators import normalize
from tidemark.sources.schemas import MESSAGE
from tidemark.streaming import normalizer as streaming

NOW = datetime(2026, 7, 1, 12, tzinfo=timezone.utc)
BASE = {"event_id": "e1", "schema_version": 1, "tenant_id": "acme", "employee_id": "E0042", "signal": "phish_sim_clicked", "source": "email_gateway", "occurred_at": "2026-07-01T12:00:00Z", "ingested_at": "2026-07-01T12:00:00Z", "source_event_id": "ms_1", "raw_ref": None, "attributes": {}}


def message(i, **change):
    return json.dumps({**BASE, "event_id": f"e{i}", **change}).encode()


CASES = [
    (message(0), "emitted"), (message(1, extra_field=5), "emitted"), (message(0), "duplicate"), (message(2, signal="not_a_signal"), "dead_lettered"), (message(2, signal="not_a_signal"), "duplicate"),
    (message(3, schema_version=6, signal="something_invented_later"), "forwarded_unknown_version"), (b"not json at all", "dead_lettered"), (b"[1, 2, 3]", "dead_lettered"), (b'"a string"', "dead_lettered"), (b"\xff\xfe\x00", "dead_lettered"),
    (message(4, employee_id=""), "dead_lettered"), (message(5, event_id=""), "dead_lettered"), (message(6, occurred_at="2026-07-01T12:00:00"), "dead_lettered"), (message(7, occurred_at="2026-07-01T12:00:00-07:00"), "emitted"),
    (message(8, event_id=5), "dead_lettered"), (message(9, schema_version="6", signal="later"), "dead_lettered"),
    (message(10, attributes="text"), "dead_lettered"), (message(11, attributes=[1]), "dead_lettered"), (message(12, attributes=None), "dead_lettered"), (message(13, schema_version=None), "dead_lettered"), (message(14, ingested_at=None), "dead_lettered"),
    (message(15, schema_version=True), "emitted"), (message(16, occurred_at=1782907200000), "emitted"), (message(17, occurred_at=1782907200), "emitted"), (message(18, schema_version=2.5), "dead_lettered"), (message(19, schema_version=1.0), "emitted"),
    (message(20, occurred_at=True), "dead_lettered"), (message(21, attributes={"a": {"b": [1, None]}}), "emitted"), (message(22, raw_ref=5), "dead_lettered"), (message(23, occurred_at="1782907200"), "emitted"), (message(24, schema_version={}), "dead_lettered"),
    (message(26) + b" x", "dead_lettered"), (b"{}],[", "dead_lettered"), (message(27) + b"{}", "dead_lettered"), (message(28) + b" \n", "emitted"), (b"\xef\xbb\xbf" + message(29), "emitted"), (message(30)[:-1] + b', "tenant_id": "other"}', "emitted"),
    (message(31, schema_version=12345678901234567890, signal="later"), "forwarded_unknown_version"), (message(32, schema_version=2.0, signal="later"), "dead_lettered"), (message(33, occurred_at=" 2026-07-01T12:00:00Z"), "dead_lettered"),
    (message(34, attributes={"x": float("nan"), "y": float("-inf")}), "emitted"), (message(35, schema_version=12345678901234567890), "emitted"), (b"", "dead_lettered"), (b"null", "dead_lettered"),
    (json.dumps({k: v for k, v in {**BASE, "event_id": "e25"}.items() if k not in ("schema_version", "ingested_at", "attributes", "raw_ref", "source_event_id")}).encode(), "emitted"),
]


def rows(spark, values):
    data = [(b"k", v, "t", 0, i, NOW + timedelta(seconds=i)) for i, v in enumerate(values)]
    return spark.createDataFrame(data, MESSAGE)


def test_batch(spark):
    found = {r.offset: r for r in normalize.normalize(rows(spark, [*[v for v, _ in CASES], None])).collect()}
    assert [found[i].outcome for i in range(len(CASES))] == [o for _, o in CASES]
    assert len(found) == len(CASES)  # a message without a value is skipped
    out = json.loads(found[1].out_value)
    assert "extra_field" not in out and out["event_id"] == "e1" and bytes(found[1].out_key) == b"E0042"
    assert json.loads(found[13].out_value)["occurred_at"].startswith("2026-07-01T19:00:00")
    assert bytes(found[5].out_value) == CASES[5][0] and bytes(found[6].out_value) == b"not json at all"
    assert "event_id" in found[11].reason
    sent = {json.loads(r.out_value)["event_id"]: json.loads(r.out_value) for r in found.values() if r.outcome == "emitted"}
    assert all(sent[e]["occurred_at"].startswith("2026-07-01T12:00:00") for e in ("e16", "e17", "e23"))
    assert sent["e15"]["schema_version"] == 1 == sent["e19"]["schema_version"] == sent["e25"]["schema_version"]
    assert sent["e30"]["tenant_id"] == "other" and sent["e35"]["schema_version"] == 12345678901234567890
    assert sent["e21"]["attributes"] == {"a": {"b": [1, None]}} and sent["e25"]["attributes"] == {} and sent["e25"]["ingested_at"]


def test_stream_resumes(spark, tmp_path):
    values = [v for v, _ in CASES]
    folder = str(tmp_path / "topic")
    for part in (values[:8], values[8:] + values[:2]):
        rows(spark, part).coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(MESSAGE).parquet(folder)
        streaming.run(source, str(tmp_path / "sent"), str(tmp_path / "dead"), str(tmp_path / "check"))
    sent = spark.read.parquet(str(tmp_path / "sent"))
    assert {r.event_id for r in sent.collect()} == {json.loads(v)["event_id"] for v, o in CASES if o in ("emitted", "forwarded_unknown_version")}
    assert spark.read.parquet(str(tmp_path / "dead")).count() == sum(o == "dead_lettered" for _, o in CASES)


def test_first_arrival(spark):
    """Of many deliveries of one id the first by time, partition and offset passes; a message read twice is decided alike."""
    when = [(5, 0, 0), (3, 1, 7), (3, 1, 4), (3, 2, 1), (9, 0, 1)]
    data = [(b"k", message("same"), "t", p, o, NOW + timedelta(seconds=s)) for s, p, o in when] + [(b"k", message("other"), "t", 3, 0, NOW)] * 2
    found = normalize.normalize(spark.createDataFrame(data, MESSAGE)).select("partition", "offset", "outcome").collect()
    assert sorted(tuple(r) for r in found if r.outcome == "emitted") == [(1, 4, "emitted"), (3, 0, "emitted"), (3, 0, "emitted")]
    assert sum(r.outcome == "duplicate" for r in found) == 4
