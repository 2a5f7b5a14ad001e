"""Exact percentiles, whatever the plan does with exchanges."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import replay


@pytest.mark.parametrize("kind", ["distinct", "ties", "skewed", "few", "none"])
def test_percentiles_equal_the_sorted_list(spark, kind):
    rng = random.Random(1)
    values = {"distinct": [rng.gauss(0, 5) for _ in range(30_000)], "ties": [float(rng.choice([1, 1, 1, 2, 7])) for _ in range(30_000)], "skewed": [10.0 ** rng.uniform(-300, 300) * rng.choice([-1, 1]) for _ in range(30_000)], "few": [3.0, 1.0, 2.0], "none": []}[kind]
    df = spark.createDataFrame([(x,) for x in values] + [(None,), (float("nan"),)], "v double").repartition(7)
    found = {r.point: r.value for r in replay.percentiles(df, "v", (0.0, 50.0, 95.0, 99.0, 100.0)).collect()}
    s = sorted(values)
    assert found == {p: s[min(int(p / 100 * len(s)), len(s) - 1)] if s else 0.0 for p in (0.0, 50.0, 95.0, 99.0, 100.0)}


def test_many_values_without_exchange_reuse(spark):
    df = spark.range(3_000_000).select((F.pmod(F.col("id") * 7_919, F.lit(3_000_000)) / 7.0).alias("v"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        found = {r.point: r.value for r in replay.percentiles(df, "v").collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert found == {50.0: 1_500_000 / 7.0, 95.0: 2_850_000 / 7.0, 99.0: 2_970_000 / 7.0}
    assert replay.quantiles(df, "v", (0.5,)) == {0.5: 0.5 * (1_499_999 / 7.0) + 0.5 * (1_500_000 / 7.0)}
