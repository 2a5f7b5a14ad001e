"""All queries against their SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidemark.plans import registry

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def text(frame: pd.DataFrame) -> list:
    show = lambda x: "null" if x is None or x is pd.NA or x != x else f"{x:.9g}" if isinstance(x, float) else f"{float(x):.9g}" if isinstance(x, int) and not isinstance(x, bool) else str(x)
    return sorted(tuple(show(x) for x in row) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_oracle(spark, duck, name):
    ours, theirs = entry.queries()[name](spark, SMALL).toPandas(), duck.execute(registry.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert text(ours) == text(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() == 15


def test_gate(spark):
    from datetime import datetime, timedelta

    from tidemark.operators.incidents import gate

    at = datetime(2026, 7, 1)
    rows = [("E", "a", at, 1), ("E", "a", at + timedelta(hours=1), 2), ("E", "b", at + timedelta(hours=2), 3), ("E", "c", at + timedelta(hours=3), 4), ("E", "a", at + timedelta(days=8), 5)]
    found = gate(spark.createDataFrame(rows, "employee_id string, kind string, at timestamp, seq long")).orderBy("seq").collect()
    assert [r.decision for r in found] == ["sent", "cooldown", "sent", "weekly_cap", "escalated"]
