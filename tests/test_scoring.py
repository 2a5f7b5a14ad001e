"""Golden scores of single events, and the rules of the score."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators import score

NOW = datetime(2026, 7, 1, 12, tzinfo=timezone.utc)


def as_of():
    return F.lit("2026-07-01 12:00:00").cast("timestamp")


def run(spark, signals, high_value=False):
    """signals: (signal, age in days)."""
    people = spark.createDataFrame([("E1", "acme", high_value)], "employee_id string, tenant_id string, is_high_value boolean")
    rows = [(str(i), "E1", s, NOW - timedelta(days=a)) for i, (s, a) in enumerate(signals)]
    events = spark.createDataFrame(rows, "event_id string, employee_id string, signal string, occurred_at timestamp")
    return events, people, score.population_scores(events, people, as_of()).first()


@pytest.mark.parametrize(
    "signals, high_value, expected, band",
    [
        ([], False, 0.0, "low"),
        ([("phish_sim_clicked", 0)], False, 23.41, "moderate"),
        ([("phish_sim_clicked", 0)], True, 31.16, "moderate"),
        ([("phish_credentials_submitted", 0)], False, 56.54, "elevated"),
        ([("phish_credentials_submitted", 0)], True, 68.86, "high"),
        ([("phish_sim_clicked", 0), ("training_completed", 0)], False, 3.28, "low"),
        ([("mfa_push_denied", 0)], False, 1.32, "low"),
        ([("file_shared_public_link", 0)], False, 30.70, "moderate"),
        ([("phish_credentials_submitted", 0), ("file_shared_public_link", 0)], False, 69.88, "high"),
        ([("phish_credentials_submitted", 0)] * 2000, False, 100.0, "critical"),
        ([("phish_sim_delivered", 0)] * 10, False, 0.0, "low"),
        ([("phish_sim_clicked", 21)], False, 12.48, "low"),
        ([("real_phish_reported", 0)] * 20, False, 0.0, "low"),
    ],
)
def test_golden(spark, signals, high_value, expected, band):
    found = run(spark, signals, high_value)[2]
    assert found.score == pytest.approx(expected, abs=0.01)
    assert found.band == band
    assert found.events_considered == len(signals)


def test_lookback_keeps_its_edge_and_the_future(spark):
    assert run(spark, [("phish_credentials_submitted", 31)])[2].events_considered == 0
    assert run(spark, [("phish_credentials_submitted", 30)])[2].events_considered == 1
    assert run(spark, [("phish_sim_clicked", -0.25)])[2].score == run(spark, [("phish_sim_clicked", 0)])[2].score


def test_attribution(spark):
    events, people, _ = run(spark, [("phish_sim_clicked", 0), ("phish_sim_clicked", 1), ("phish_sim_clicked", 2), ("file_shared_public_link", 0), ("training_completed", 0)])
    parts = {r.signal: r for r in score.factors(events, people, as_of()).collect()}
    assert parts["phish_sim_clicked"].occurrences == 3 and parts["phish_sim_clicked"].most_recent == NOW.replace(tzinfo=None)
    assert parts["training_completed"].contribution == -7.0 and parts["training_completed"].is_mitigating
    assert [r.signal for r in score.top_factors(score.factors(events, people, as_of())).orderBy("rank").collect()] == ["phish_sim_clicked", "file_shared_public_link"]
    assert score.dominant_category(score.categories(score.factors(events, people, as_of()))).first().dominant_category == "phishing_susceptibility"


def test_mitigation_is_not_amplified(spark):
    events, people, _ = run(spark, [("training_completed", 0)], True)
    assert score.factors(events, people, as_of()).first().contribution == -7.0


def test_unpriced_signal_is_an_error(spark):
    with pytest.raises(Exception, match="no price"):
        run(spark, [("not_a_signal", 0)])
    assert run(spark, [("not_a_signal", 40)])[2].score == 0


def test_cap_keeps_the_latest(spark):
    events, _, _ = run(spark, [("phish_sim_clicked", i / 1000) for i in range(50)])
    kept, cut = score.capped(events, most=45)
    assert kept.count() == 45 and cut.first().truncated == 5
    assert {r.event_id for r in kept.collect()} == {str(i) for i in range(45)}
