"""Streams of people that share buckets: runs over one state, and everything delivered a second time."""

from datetime import timedelta

from pyspark.sql import functions as F

from tidemark.functions.catalog import SIGNALS
from tidemark.streaming import scorer

from .test_scoring import NOW

SCHEMA = "event_id string, employee_id string, signal string, occurred_at timestamp, ingested_at timestamp, seq long"


def _scored(spark, tmp_path, name, buckets, batches, people):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / name / "in"))
        scores = scorer.band_stream(scorer.score_stream(stream, people, as_of="occurred_at", arrival="occurred_at", expire=False, buckets=buckets), buckets=buckets).withColumn("run", F.lit(k))
        scorer.run(scores, str(tmp_path / name / "out"), str(tmp_path / name / "check"))
    return spark.read.parquet(str(tmp_path / name / "out"))


def test_people_in_one_bucket_and_in_many(spark, tmp_path):
    """Three runs, the last of which delivers all events of the first again: the number of buckets changes nothing, and nobody's score or band moves by what came again."""
    rows = [(f"e{k}", f"P{k % 40}", SIGNALS[k % 23][0], NOW + timedelta(hours=k), NOW + timedelta(hours=k), k) for k in range(400)]
    people = spark.createDataFrame([(f"P{k}", k % 3 == 0) for k in range(40)], "employee_id string, is_high_value boolean")
    again = [(i, p, s, NOW + timedelta(hours=400), at, n) for i, p, s, _, at, n in rows[:200]]
    one, many = (_scored(spark, tmp_path, f"b{b}", b, (rows[:200], rows[200:], again), people) for b in (1, 1024))
    columns = ["run", "employee_id", "event_id", "score", "events_considered", "previous_band", "band_changed"]
    assert one.count() == 600 and one.select(columns).exceptAll(many.select(columns)).isEmpty()
    told = one.filter("run = 2").groupBy("employee_id").agg(F.count_distinct("score", "events_considered").alias("n"), F.max("events_considered").alias("most"), F.count(F.when(F.col("band_changed"), 1)).alias("moved"))
    assert {(r.n, r.most) for r in told.collect()} == {(1, 10)} and max(r.moved for r in told.collect()) <= 1
