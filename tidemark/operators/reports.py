"""Reports and audits over events, messages, scores and people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import signal_catalog
from ..functions.scoring import lateness_seconds
from .normalize import fields_of
from .replay import quantiles


def latest_scores(scores: DataFrame) -> DataFrame:
    """The newest score of each person by as_of; of equal times the one that came later. Rows without a value are skipped.

    max_by keeps one row a person while it reads, so a person with many scores needs no sort.
    """
    rows = scores.filter("score is not null")
    one = F.max_by(F.struct("score", "band", "as_of", "offset"), F.struct("as_of", "offset"))
    return rows.groupBy("employee_id").agg(one.alias("s")).select("employee_id", "s.*")


def signal_rates(events: DataFrame, population: int, days: int, top: int = 10) -> DataFrame:
    """The most frequent signals, with their rate per person and day."""
    counts = events.groupBy("signal").agg(F.count("*").alias("n"))
    return counts.withColumn("rate", F.round(F.col("n") / F.lit(population) / F.lit(days), 6)).orderBy(F.desc("n"), "signal").limit(top)


def topic_audit(messages: DataFrame) -> DataFrame:
    """Per partition: messages, distinct people and signals, values that don't parse, keys that differ from the employee, and whether all is well."""
    rows = fields_of(messages, ("employee_id", "signal")).withColumnsRenamed({"_employee_id": "_e", "_signal": "_s"})
    bad, moved = F.col("_e").isNull(), F.col("_e").isNotNull() & (F.col("_e") != F.col("key").cast("string"))
    sums = rows.groupBy("partition").agg(
        F.count("*").alias("n"), F.count_distinct("_e").alias("employees"), F.count_distinct("_s").alias("signals"), F.count(F.when(bad, 1)).alias("parse_errors"), F.count(F.when(moved, 1)).alias("key_mismatches")
    )
    return sums.withColumn("passed", (F.col("parse_errors") == 0) & (F.col("key_mismatches") == 0))


def group_shares(people: DataFrame, by: str) -> DataFrame:
    """n, share of all, and high-value people of each group."""
    sums = people.groupBy(by).agg(F.count("*").alias("n"), F.count(F.when(F.col("is_high_value"), 1)).alias("high_value"))
    total = F.sum("n").over(Window.partitionBy())  # one row a group
    return sums.withColumn("share", F.round(F.col("n") / total, 6))


def score_distribution(scores: DataFrame) -> DataFrame:
    """n, median, p90, most and the share of critical people; the quantiles exactly, by selection in passes."""
    q = quantiles(scores, "score", (0.5, 0.9))
    of = lambda f: F.round(F.lit(q[f]).cast("double"), 2)
    return scores.agg(F.count("*").alias("n"), of(0.5).alias("median"), of(0.9).alias("p90"), F.max("score").alias("most"), F.round(F.avg(F.when(F.col("band") == "critical", 1.0).otherwise(0.0)), 6).alias("critical_share"))


def mean_score() -> Column:
    """The mean of scores, which have two places, to two places: whole hundredths are added, so that neither the order of addition nor a tie can change it."""
    cents, n = F.sum(F.round(F.col("score") * 100).cast("long")), F.count("score")
    twice = 2 * cents + n
    return F.when(n > 0, (twice - F.pmod(twice, 2 * n)) / (2 * n) / 100.0)


def mean_by_label(scores: DataFrame, labels: DataFrame) -> DataFrame:
    return scores.join(labels, "employee_id").groupBy("label").agg(F.count("*").alias("n"), mean_score().alias("mean_score"))


def events_per_day(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("occurred_at").alias("day")).agg(F.count("*").alias("n"))


def catalog_checks(events: DataFrame) -> DataFrame:
    """One row a rule over the catalog and the events' vocabulary: rule, violations."""
    catalog = signal_catalog(events.sparkSession)
    used = events.select("signal").distinct()
    weight = lambda s: F.max(F.when(F.col("signal") == s, F.col("weight")))
    own = catalog.agg(
        F.count(F.when(F.col("half_life_days") <= 0, 1)).alias("half_life_positive"), (F.count("*") - F.count_distinct("signal")).alias("signals_unique"),
        F.when(weight("phish_credentials_submitted") > weight("phish_sim_clicked"), 0).otherwise(1).cast("long").alias("submission_outweighs_click"), F.when(weight("phish_sim_delivered") == 0, 0).otherwise(1).cast("long").alias("exposure_weighs_nothing"),
    )
    rules = own.unpivot([], ["half_life_positive", "signals_unique", "submission_outweighs_click", "exposure_weighs_nothing"], "rule", "violations")
    unpriced = used.join(F.broadcast(catalog.select("signal")), "signal", "left_anti").agg(F.lit("every_signal_priced").alias("rule"), F.count("*").alias("violations"))
    unused = catalog.select("signal").exceptAll(used).agg(F.lit("every_price_used").alias("rule"), F.count("*").alias("violations"))
    return rules.unionByName(unpriced).unionByName(unused)


def replay_order(events: DataFrame) -> DataFrame:
    """Days in order of event time, each day's events in order: range partitions by day and time, sorted within."""
    return events.withColumn("day", F.to_date("occurred_at")).repartitionByRange("day", "occurred_at", "seq").sortWithinPartitions("day", "occurred_at", "seq")


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str, stamp: Column) -> DataFrame:
    """A new snapshot: of each key the latest change if there is one, stamped, else the row as it was. Nothing is removed."""
    fields = [c for c in current.columns if c != "updated_at"]
    newest = changes.groupBy(key).agg(F.max_by(F.struct(*fields), F.col(order)).alias("r")).select("r.*").withColumn("updated_at", stamp)
    kept = current.join(newest.select(key), key, "left_anti")
    return kept.unionByName(newest.select(*kept.columns))


def daily_rollup(events: DataFrame) -> DataFrame:
    """Per person and day: events, signals, first and last time. Meant to be written partitioned by day."""
    return events.groupBy("employee_id", F.to_date("occurred_at").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("signal").alias("signals"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"))


def cohort_mart(scores: DataFrame, people: DataFrame) -> DataFrame:
    """Scores by department and tenure: n, mean and highest score, critical people."""
    tenure = F.when(F.col("tenure_days") < 90, "new").when(F.col("tenure_days") < 730, "settled").otherwise("veteran")
    rows = scores.join(people.select("employee_id", "department", tenure.alias("tenure")), "employee_id")
    return rows.groupBy("department", "tenure").agg(F.count("*").alias("n"), mean_score().alias("mean_score"), F.max("score").alias("most"), F.count(F.when(F.col("band") == "critical", 1)).alias("critical"))


def baseline_deviation(events: DataFrame, days: int = 30) -> DataFrame:
    """Daily counts of each person against the mean and spread of the `days` days before, where there were at least two."""
    counts = events.groupBy("employee_id", F.to_date("occurred_at").alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("employee_id").orderBy(F.datediff("day", F.lit("1970-01-01").cast("date"))).rangeBetween(-days, -1)
    rows = counts.withColumns({"before": F.count("n").over(w), "mean": F.avg("n").over(w), "spread": F.stddev_pop("n").over(w)})
    z = F.when(F.col("spread") > 0, F.round((F.col("n") - F.col("mean")) / F.col("spread"), 4))
    return rows.filter("before >= 2").select("employee_id", "day", "n", F.round("mean", 4).alias("mean"), F.round("spread", 4).alias("spread"), z.alias("z"))


def data_quality(events: DataFrame, split: Column) -> DataFrame:
    """Before and since `split`: rows, nulls in required columns, late share."""
    period = F.when(F.col("occurred_at") < split, "before").otherwise("since")
    nulls = [F.count(F.when(F.col(c).isNull(), 1)).alias(f"null_{c}") for c in ("event_id", "employee_id", "signal")]
    late = F.round(F.avg(F.when(lateness_seconds(F.col("ingested_at"), F.col("occurred_at")) > 300, 1.0).otherwise(0.0)), 6)
    return events.groupBy(period.alias("period")).agg(F.count("*").alias("n"), *nulls, late.alias("late_share"))


def mix_drift(events: DataFrame, split: Column) -> DataFrame:
    """Per signal: its share of events before and since `split`, and the difference."""
    since = F.col("occurred_at") >= split
    sums = events.groupBy("signal").agg(F.count(F.when(~since, 1)).alias("b"), F.count(F.when(since, 1)).alias("s"))
    every = Window.partitionBy()  # one row a signal
    share = lambda c: F.col(c) / F.sum(c).over(every)
    return sums.withColumns({"p": share("b"), "q": share("s")}).select("signal", F.round("p", 6).alias("before"), F.round("q", 6).alias("since"), F.round(F.col("q") - F.col("p"), 6).alias("drift"))


def without_subjects(rows: DataFrame, subjects: DataFrame, key: str = "employee_id") -> DataFrame:
    """Rows of all but the people to be forgotten."""
    return rows.join(subjects.select(key).distinct(), key, "left_anti")


def tombstones(subjects: DataFrame, key: str = "employee_id") -> DataFrame:
    """What makes a compacted topic forget people: their keys with no value."""
    return subjects.select(F.col(key).cast("binary").alias("key"), F.lit(None).cast("binary").alias("value")).distinct()


def retained(rows: DataFrame, today: Column, days: int, day_col: str = "day") -> DataFrame:
    """Rows whose day is at most `days` before today; on a table partitioned by day this prunes partitions."""
    return rows.filter(F.col(day_col) >= F.date_sub(today, days))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other; none if they are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
