"""Population scores with attribution, in one pass over the events.

Sums are taken for both cases, plain and high-value, before people are joined: one row a person and signal meets the
dimension, instead of one row an event, and a busy person's events are summed where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import CATEGORIES, SIGNALS, signal_catalog
from ..functions.scoring import LOOKBACK_DAYS, age_days, band_of, contribution, score_of

#: Most recent events of a person that count.
WINDOW_EVENTS = 5000


def priced(events: DataFrame, as_of: Column, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """Events of the lookback (one aged exactly so many days stays, and so do future ones) with plain and high_value contributions. A signal without a price is an error."""
    if not 1 <= lookback_days <= 365:
        raise ValueError("lookback_days must be from 1 to 365")
    catalog = signal_catalog(events.sparkSession).select("signal", "category", "category_ordinal", F.col("ordinal").alias("signal_ordinal"), "weight", "half_life_days")
    age = age_days(as_of, F.col("occurred_at"))
    rows = events.filter(age <= lookback_days).join(F.broadcast(catalog), "signal", "left")  # 23 rows
    weight = F.when(F.col("weight").isNull(), F.raise_error(F.concat(F.lit("no price for signal "), F.col("signal"))).cast("double")).otherwise(F.col("weight"))
    both = [contribution(weight, F.col("half_life_days"), age, F.lit(hv)).alias(n) for n, hv in (("plain", False), ("high_value", True))]
    return rows.select("*", *both).drop("weight", "half_life_days")


def _own(high_value: Column) -> Column:
    return F.when(high_value, F.col("high_value")).otherwise(F.col("plain"))


def population_scores(events: DataFrame, people: DataFrame, as_of: Column, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """employee_id, tenant_id, raw, score, band, events_considered of every person; those without events score 0. Events of unknown people don't count."""
    sums = priced(events.select("employee_id", "signal", "occurred_at"), as_of, lookback_days).groupBy("employee_id").agg(F.sum("plain").alias("plain"), F.sum("high_value").alias("high_value"), F.count("*").alias("n"))
    rows = people.select("employee_id", "tenant_id", F.col("is_high_value").alias("hv")).join(sums, "employee_id", "left")
    raw = F.coalesce(_own(F.col("hv")), F.lit(0.0))
    score = score_of(raw)
    return rows.select("employee_id", "tenant_id", raw.alias("raw"), score.alias("score"), band_of(score).alias("band"), F.coalesce("n", F.lit(0)).alias("events_considered"))


def factors(events: DataFrame, people: DataFrame, as_of: Column, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """Per person and signal: category, occurrences, raw, contribution (rounded), most_recent, is_mitigating (by the rounded contribution)."""
    keys = ["employee_id", "signal", "signal_ordinal", "category", "category_ordinal"]
    rows = priced(events.select("employee_id", "signal", "occurred_at"), as_of, lookback_days)
    sums = rows.groupBy(*keys).agg(F.sum("plain").alias("plain"), F.sum("high_value").alias("high_value"), F.count("*").alias("occurrences"), F.max("occurred_at").alias("most_recent"))
    rows = sums.join(people.select("employee_id", F.col("is_high_value").alias("hv")), "employee_id")
    raw = _own(F.col("hv"))
    return rows.select(*keys, "occurrences", raw.alias("raw"), F.round(raw, 3).alias("contribution"), "most_recent", (F.round(raw, 3) < 0).alias("is_mitigating"))


def categories(parts: DataFrame) -> DataFrame:
    """Per person and category, from factors(): raw and value (rounded); categories whose sum is 0 before rounding are left out."""
    sums = parts.groupBy("employee_id", "category", "category_ordinal").agg(F.sum("raw").alias("raw"))
    return sums.filter("raw <> 0").withColumn("value", F.round("raw", 3))


def dominant_category(by_category: DataFrame) -> DataFrame:
    """Per person the category of the largest positive rounded value; ties go to the earlier category."""
    best = F.max_by("category", F.struct("value", -F.col("category_ordinal")))
    return by_category.filter("value > 0").groupBy("employee_id").agg(best.alias("dominant_category"))


def top_factors(parts: DataFrame, n: int = 3) -> DataFrame:
    """Per person the n largest factors that don't lower the score; ties by signal."""
    w = Window.partitionBy("employee_id").orderBy(F.desc("contribution"), "signal")
    return parts.filter("contribution >= 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).drop("raw")


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns, computed once a row: out of an exploded array of one, which the optimizer doesn't copy into each use as it does plain columns."""
    both = rows.withColumn("_once", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
    return both.select(*rows.columns, *[F.col("_once")[n].alias(n) for n in columns])


def with_attribution(rows: DataFrame, parts: str = "parts", n: int = 5) -> DataFrame:
    """Adds by_category, dominant_category and top_factors from an array of a person's signals (signal_ordinal, occurrences, raw), 23 at most."""
    of = lambda values, ordinal: F.get(F.array(*[F.lit(x) for x in values]), ordinal)
    ordinals = [CATEGORIES.index(s[1]) for s in SIGNALS]
    named = F.transform(
        parts,
        lambda p: F.struct(
            of([s[0] for s in SIGNALS], p["signal_ordinal"]).alias("signal"), of([s[1] for s in SIGNALS], p["signal_ordinal"]).alias("category"), of(ordinals, p["signal_ordinal"]).alias("ordinal"), p["occurrences"].cast("long").alias("occurrences"),
            p["raw"].alias("raw"), F.round(p["raw"], 3).alias("contribution"),
        ),
    )
    told = once(rows, _named=named)
    sums = F.transform(F.sequence(F.lit(0), F.lit(len(CATEGORIES) - 1)), lambda k: F.struct(k.alias("ordinal"), F.aggregate(F.filter("_named", lambda p: p["ordinal"] == k), F.lit(0.0), lambda x, p: x + p["raw"]).alias("raw")))
    values = F.transform(F.filter(sums, lambda c: c["raw"] != 0), lambda c: F.struct(of(CATEGORIES, c["ordinal"]).alias("category"), F.round(c["raw"], 3).alias("value"), c["ordinal"].alias("ordinal")))
    told = once(told, _values=values)
    best = F.array_max(F.transform(F.filter("_values", lambda c: c["value"] > 0), lambda c: F.struct(c["value"].alias("value"), (-c["ordinal"]).alias("place"), c["category"].alias("category"))))
    larger = lambda x, y: F.when(x["contribution"] != y["contribution"], F.when(x["contribution"] > y["contribution"], -1).otherwise(1)).when(x["signal"] < y["signal"], -1).otherwise(1)
    top = F.slice(F.array_sort(F.filter("_named", lambda p: p["contribution"] >= 0), larger), 1, n)
    columns = {
        "by_category": F.map_from_entries(F.array_sort(F.transform("_values", lambda c: F.struct(c["category"].alias("category"), c["value"].alias("value"))))),
        "dominant_category": best["category"],
        "top_factors": F.transform(top, lambda f: F.struct(f["signal"].alias("signal"), f["category"].alias("category"), f["occurrences"].alias("occurrences"), f["contribution"].alias("contribution"))),
    }
    return told.withColumns(columns).drop("_named", "_values")


def published_scores(events: DataFrame, people: DataFrame, as_of: Column, n: int = 5) -> DataFrame:
    """What goes out: score, band, dominant_category, by_category (map) and top_factors (array) of every person.

    Events are read once: sums by person and signal, then one array a person.
    """
    rows = priced(events.select("employee_id", "signal", "occurred_at"), as_of)
    sums = rows.groupBy("employee_id", "signal_ordinal").agg(F.sum("plain").alias("plain"), F.sum("high_value").alias("high_value"), F.count("*").alias("occurrences"))
    lists = sums.groupBy("employee_id").agg(F.array_sort(F.collect_list(F.struct("signal_ordinal", "occurrences", "plain", "high_value"))).alias("sums"))
    rows = people.select("employee_id", "tenant_id", F.col("is_high_value").alias("hv")).join(lists, "employee_id", "left")
    own = F.transform("sums", lambda p: F.struct(p["signal_ordinal"].alias("signal_ordinal"), p["occurrences"].alias("occurrences"), F.when(F.col("hv"), p["high_value"]).otherwise(p["plain"]).alias("raw")))
    rows = once(rows, parts=F.coalesce(own, F.array().cast("array<struct<signal_ordinal: int, occurrences: bigint, raw: double>>")))
    raw = F.aggregate("parts", F.lit(0.0), lambda x, p: x + p["raw"])
    count = F.aggregate("parts", F.lit(0).cast("long"), lambda x, p: x + p["occurrences"])
    rows = with_attribution(rows.withColumns({"score": score_of(raw), "events_considered": count}), "parts", n)
    return rows.withColumns({"band": band_of(F.col("score")), "schema_version": F.lit(1), "as_of": as_of}).drop("hv", "sums", "parts")


def capped(events: DataFrame, most: int = WINDOW_EVENTS) -> tuple[DataFrame, DataFrame]:
    """The `most` latest events of each person, and per person how many were cut. Only people over the cap go through the sort."""
    counts = events.groupBy("employee_id").agg(F.count("*").alias("n"))
    over = counts.filter(F.col("n") > most)
    w = Window.partitionBy("employee_id").orderBy(F.desc("occurred_at"), F.desc("event_id"))
    busy = events.join(over.select("employee_id"), "employee_id", "left_semi").withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= most).drop("_rank")
    calm = events.join(over.select("employee_id"), "employee_id", "left_anti")
    return calm.unionByName(busy), over.select("employee_id", (F.col("n") - most).alias("truncated"))


def ranked(scores: DataFrame, top: int = 15) -> DataFrame:
    return scores.orderBy(F.desc("score"), "employee_id").limit(top)
