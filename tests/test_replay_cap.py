"""The replay keeps the latest events of a person, as the stream does, and costs the same for each event of a busy one."""

import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tests.test_scoring import NOW
from tidemark.functions.catalog import SIGNALS
from tidemark.operators import replay

EVENT = "event_id string, employee_id string, signal string, occurred_at timestamp, ingested_at timestamp"
WEIGHTS = {s[0]: (s[2], s[3]) for s in SIGNALS}


def test_replay_keeps_the_latest_events(spark):
    people = spark.createDataFrame([("E1", True)], "employee_id string, is_high_value boolean")
    signals = ["phish_credentials_submitted"] * 20 + ["phish_sim_delivered"] * 5001
    rows = [(f"{i:05d}", "E1", s, NOW + timedelta(seconds=min(i, 5019)), NOW) for i, s in enumerate(signals)]  # the last two at one time
    found = {r.event_id: (r.score, r.events_considered) for r in replay.replay_scores(spark.createDataFrame(rows, EVENT), people).collect()}
    assert found["00019"] == (100.0, 20) and found["04998"][1] == 4999 and found["05017"][1] == 5000 and found["05017"][0] > 0
    assert found["05019"] == found["05020"] == (0.0, 5000)


@pytest.mark.parametrize(("most", "lookback"), [(7, 30), (40, 30), (5000, 30), (3, 2), (5000, 365)])
def test_equals_adding_up_each_window(spark, most, lookback):
    """Against a loop over all pairs: ties in time, events exactly as old as the lookback, people over the cap and a plain one, times before 1970."""
    rng, rows = random.Random(most), []
    for person, n in (("busy", 120), ("calm", 9), ("old", 60)):
        at = datetime(1969, 11, 1, tzinfo=timezone.utc) if person == "old" else NOW
        for k in range(n):
            at += rng.choice([timedelta(0), timedelta(hours=7), timedelta(days=2), timedelta(days=30), timedelta(microseconds=1)])
            rows.append((f"{person}{k:03d}", person, rng.choice(SIGNALS)[0], at, at + timedelta(seconds=5)))
    people = spark.createDataFrame([("busy", True), ("calm", False), ("old", False)], "employee_id string, is_high_value boolean")
    found = {r.event_id: r for r in replay.replay_scores(spark.createDataFrame(rows, EVENT).repartition(5), people, lookback, most).collect()}
    assert len(found) == len(rows)
    for i, person, _, at, ingested in rows:
        seen = sorted((r for r in rows if r[1] == person and r[3] <= at), key=lambda r: (r[3], r[0]))[-most:]
        seen = [r for r in seen if at - r[3] <= timedelta(days=lookback)]
        terms = [WEIGHTS[r[2]][0] * 0.5 ** ((at - r[3]) / timedelta(days=1) / WEIGHTS[r[2]][1]) for r in seen]
        raw = sum(t * 1.4 if t > 0 and person == "busy" else t for t in terms)
        assert found[i].events_considered == len(seen)
        assert abs(found[i].score - (0 if raw <= 0 else 100 * (1 - 2.718281828459045 ** (-raw / 30)))) < 0.00501, i
        assert found[i].ingested_at.timestamp() == ingested.timestamp()


def test_one_busy_person(spark):
    """100,000 events of one person: neither a list a row nor a minute."""
    rows = spark.range(100_000).select(F.format_string("%06d", "id").alias("event_id"), F.lit("E").alias("employee_id"), F.element_at(F.array(*[F.lit(s[0]) for s in SIGNALS]), (F.col("id") % 23 + 1).cast("int")).alias("signal"))
    rows = rows.withColumn("occurred_at", F.timestamp_micros(1_700_000_000_000_000 + F.col("event_id").cast("long") * 60_000_000)).withColumn("ingested_at", F.col("occurred_at"))
    began = time.perf_counter()
    told = replay.replay_scores(rows, spark.createDataFrame([("E", False)], "employee_id string, is_high_value boolean")).agg(F.count("*").alias("n"), F.max("events_considered").alias("most"), F.min("score").alias("low")).first()
    assert (told["n"], told["most"]) == (100_000, 5000)
    assert time.perf_counter() - began < 60
