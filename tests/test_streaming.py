"""The stream's keyed states: windows against a loop, one busy person, one query from messages to bands."""

import random
import time
from datetime import timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.catalog import SIGNALS
from tidemark.operators import normalize, replay
from tidemark.sources.adapter import employees, events, messages
from tidemark.sources.topics import read_folder
from tidemark.streaming import scorer

from .conftest import SMALL

DAY = 86_400_000_000


@pytest.mark.parametrize("most", [3, 50, 5000])
def test_window_against_a_loop(most):
    """Late, early and repeated events, ties, more events than a portion; several batches over one state."""
    rng, held, arrived = random.Random(most), {}, []
    for _ in range(4):
        rows = []
        for k in range(rng.choice([1, 5, 300])):
            i = f"e{rng.randrange(400):03d}"
            rows.append((i, sum(map(ord, i)) % 23, (hash((most, i)) % 60) * DAY // 2 + 400 * DAY, 430 * DAY))
        new = pd.DataFrame(rows, columns=["event_id", "signal_ordinal", "occurred_us", "as_of_us"])
        told = [x for part in scorer.window_sums(held, new, True, 30 * DAY, most) for x in zip(*part, strict=True)]
        assert len(told) == len(rows)
        for (i, s, at, now), (raw, n, cut, sums, counts) in zip(rows, told, strict=True):
            if (i, s) not in [x[:2] for x in arrived]:
                arrived.append((i, s, at))
            inside = sorted((x for x in arrived if now - x[2] <= 30 * DAY), key=lambda x: (x[2], x[0]))
            seen = inside[-most:]
            terms = [SIGNALS[s][2] * (1.4 if SIGNALS[s][2] > 0 else 1) * 0.5 ** (max(0, now - at) / DAY / SIGNALS[s][3]) for _, s, at in seen]
            assert n == len(seen) == counts.sum() and abs(raw - sum(terms)) < 1e-9 and abs(sums.sum() - raw) < 1e-9
            assert cut == len(inside) - len(seen) or len(arrived) > most  # what was cut before isn't counted again
        assert len(held) <= max(most, 0)


def test_one_busy_person(spark, tmp_path):
    """100,000 events of one person in one batch."""
    rows = spark.range(100_000).select(F.format_string("%06d", "id").alias("event_id"), F.lit("E").alias("employee_id"), F.element_at(F.array(*[F.lit(s[0]) for s in SIGNALS]), (F.col("id") % 23 + 1).cast("int")).alias("signal"), F.timestamp_micros(1_700_000_000_000_000 + F.col("id") * 60_000_000).alias("occurred_at"), F.col("id").alias("seq"))
    rows = rows.withColumn("ingested_at", F.col("occurred_at"))
    rows.write.parquet(str(tmp_path / "in"))
    people = spark.createDataFrame([("E", False)], "employee_id string, is_high_value boolean")
    began = time.perf_counter()
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    scorer.run(scorer.band_stream(scorer.score_stream(stream, people, as_of="occurred_at", arrival="occurred_at", expire=False)), str(tmp_path / "out"), str(tmp_path / "check"))
    assert time.perf_counter() - began < 60
    found = spark.read.parquet(str(tmp_path / "out")).select("event_id", "score", "events_considered")
    batch = replay.replay_scores(rows, people).select("event_id", "score", "events_considered")
    assert found.count() == 100_000 and found.exceptAll(batch).count() == 0


def test_messages_to_bands_in_one_query(spark, tmp_path):
    """Dedup, window and band in three states of one query, over two runs, against the batch jobs one after another."""
    topic, people = messages(spark, SMALL), employees(spark, SMALL)
    for k, part in enumerate((F.col("timestamp") < F.lit("2024-01-12").cast("timestamp"), F.col("timestamp") >= F.lit("2024-01-12").cast("timestamp"))):
        topic.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "topic"))
        rows = scorer.banded_messages(read_folder(spark, str(tmp_path / "topic")), people, as_of="ingested_at", expire=False)
        scorer.run(rows, str(tmp_path / "out"), str(tmp_path / "check"))
    found = spark.read.parquet(str(tmp_path / "out"))
    sent = normalize.normalize(topic).filter(F.col("outcome") == normalize.EMITTED)
    known = sent.drop("key").join(people.select(F.col("employee_id").cast("binary").alias("out_key")), "out_key", "left_semi")
    assert found.count() == known.count() > 800
    twice = found.groupBy("event_id").count().filter("count > 1").count()
    assert twice == 0
    # the last score of each person is the population's at that time; the bands follow one another
    rows = found.orderBy("employee_id", "ingested_at", "seq").collect()
    last = {}
    for r in rows:
        assert r.previous_band == last.get(r.employee_id) and r.band_changed == (r.previous_band is not None and r.previous_band != r.band)
        last[r.employee_id] = r.band


def test_late_by_weeks(spark, tmp_path):
    """An event that comes after later ones counts from then on; one older than the lookback still brings a score of the rest."""
    from .test_scoring import NOW

    rows = [("a", "phish_credentials_submitted", 0, 0), ("b", "phish_sim_clicked", -20, 1), ("c", "phish_sim_clicked", -40, 2)]
    data = [(i, "E", s, NOW + timedelta(days=d), NOW + timedelta(seconds=k), k) for i, s, d, k in rows]
    df = spark.createDataFrame(data, "event_id string, employee_id string, signal string, occurred_at timestamp, ingested_at timestamp, seq long")
    df.write.parquet(str(tmp_path / "in"))
    people = spark.createDataFrame([("E", False)], "employee_id string, is_high_value boolean")
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    scorer.run(scorer.score_stream(stream, people, as_of="ingested_at", expire=False), str(tmp_path / "out"), str(tmp_path / "check"))
    found = {r.event_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert [found[i].events_considered for i in "abc"] == [1, 2, 2]
    assert found["a"].score == 56.54 and found["b"].score > 60 and found["c"].score == found["b"].score
