"""Scores, attribution and what is read off them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import signal_catalog
from ..operators import score
from ..sources.adapter import as_of, employees, events
from .oracle import sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(select: str | None = None, more: str = "", whole: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if whole or select:
            SQL[f.__name__] = whole or sql(select, more)
        return f

    return add


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return score.population_scores(events(spark, d), employees(spark, d), as_of())


def _factors(spark: SparkSession, d: str) -> DataFrame:
    return score.factors(events(spark, d), employees(spark, d), as_of())


@query("select ordinal::int as ordinal, signal, category, weight, half_life_days, source, weight < 0 as is_mitigating from cat")
def s9_signal_catalog(spark, d):
    return signal_catalog(spark).drop("category_ordinal")


@query("select employee_id, score, band, events_considered::bigint as events_considered from scores")
def a1_population_score(spark, d):
    return _scores(spark, d).select("employee_id", "score", "band", "events_considered")


@query("select employee_id, category, value from bycat")
def a2_category_breakdown(spark, d):
    return score.categories(_factors(spark, d)).select("employee_id", "category", "value")


@query("select employee_id, signal, category, occurrences::bigint as occurrences, contribution, most_recent_us, contribution < 0 as is_mitigating from factor")
def a3_signal_attribution(spark, d):
    return _factors(spark, d).select("employee_id", "signal", "category", "occurrences", "contribution", F.unix_micros("most_recent").alias("most_recent_us"), "is_mitigating")


@query("select employee_id, arg_max(category, value * 10 - category_ordinal * 0.001) as dominant_category from bycat where value > 0 group by employee_id")
def a4_dominant_category(spark, d):
    return score.dominant_category(score.categories(_factors(spark, d)))


@query(
    """select s.employee_id, score, band, events_considered::bigint as events_considered, dom as dominant_category, coalesce(cats, '') as by_category, coalesce(tops, '') as top_factors
       from scores s left join (select employee_id, string_agg(category || '=' || printf('%.3f', value), ',' order by category) as cats from bycat group by employee_id) using (employee_id)
       left join (select employee_id, category as dom from bycat where value > 0 qualify row_number() over (partition by employee_id order by value desc, category_ordinal) = 1) using (employee_id)
       left join (select employee_id, string_agg(signal || ':' || occurrences || ':' || printf('%.3f', contribution), ',' order by contribution desc, signal) as tops
                  from (select * from factor where contribution >= 0 qualify row_number() over (partition by employee_id order by contribution desc, signal) <= 5) group by employee_id) using (employee_id)"""
)
def a5_published_scores(spark, d):
    rows = score.published_scores(events(spark, d), employees(spark, d), as_of())
    number = lambda x: F.format_string("%.3f", x)
    cats = F.array_join(F.array_sort(F.transform(F.map_entries("by_category"), lambda e: F.concat(e["key"], F.lit("="), number(e["value"])))), ",")
    tops = F.array_join(F.transform("top_factors", lambda f: F.concat_ws(":", f["signal"], f["occurrences"].cast("string"), number(f["contribution"]))), ",")
    return rows.select("employee_id", "score", "band", "events_considered", "dominant_category", cats.alias("by_category"), tops.alias("top_factors"))


@query("select employee_id, score, band, events_considered::bigint as events_considered from scores order by score desc, employee_id limit 15")
def t1_rank_population(spark, d):
    return score.ranked(_scores(spark, d)).select("employee_id", "score", "band", "events_considered")


@query("select employee_id, rank::int as rank, signal, occurrences::bigint as occurrences, contribution from (select *, row_number() over (partition by employee_id order by contribution desc, signal) as rank from factor where contribution >= 0) where rank <= 3")
def t2_top_factors(spark, d):
    return score.top_factors(_factors(spark, d)).select("employee_id", "rank", "signal", "occurrences", "contribution")


@query("select employee_id, signal, occurrences::bigint as occurrences, contribution from factor where employee_id = '42' order by contribution desc, signal")
def t3_employee_factors(spark, d):
    one = F.col("employee_id") == "42"  # a drill-down: the filter reaches the scans
    return score.factors(events(spark, d).filter(one), employees(spark, d).filter(one), as_of()).select("employee_id", "signal", "occurrences", "contribution").orderBy(F.desc("contribution"), "signal")


@query("select employee_id, count(*)::bigint as kept, max(n) - count(*) as truncated from (select *, count(*) over (partition by employee_id) as n, row_number() over (partition by employee_id order by at_us desc) as r from ev) where r <= 5 group by employee_id")
def x2_window_cap(spark, d):
    kept, cut = score.capped(events(spark, d), most=5)
    counts = kept.groupBy("employee_id").agg(F.count("*").alias("kept"))
    return counts.join(cut, "employee_id", "left").select("employee_id", "kept", F.coalesce("truncated", F.lit(0)).cast("long").alias("truncated"))
