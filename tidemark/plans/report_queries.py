"""Reports, audits, marts and incident patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import incidents, parsers, reports, score
from ..sources import lake, topics
from ..sources.adapter import as_of, employees, events, messages, vendor_records
from .oracle import sql
from .stream_queries import _REPLAY, _VENDOR, _replayed

_GATE = None
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(select: str | None = None, more: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if select:
            SQL[f.__name__] = sql(select, more).replace("with", "with recursive" if more is _GATE else "with", 1)
        return f

    return add


def _scores(spark, d):
    return score.population_scores(events(spark, d), employees(spark, d), as_of())


def _split():
    return F.lit("2024-01-16 00:00:00").cast("timestamp")


@query("select employee_id, score, band, at_us as as_of_us from moved where seq % 10 <> 0 qualify row_number() over (partition by employee_id order by at_us desc, seq desc) = 1", _REPLAY)
def s5_latest_scores(spark, d):
    """The latest of each person's published scores; every tenth message has no value."""
    rows = _replayed(spark, d).withColumn("score", F.when(F.col("seq") % 10 != 0, F.col("score"))).withColumnsRenamed({"occurred_at": "as_of", "seq": "offset"})
    return reports.latest_scores(rows.select("employee_id", "score", "band", "as_of", "offset")).select("employee_id", "score", "band", F.unix_micros("as_of").alias("as_of_us"))


@query("select signal, count(*)::bigint as n, round(count(*) / (select count(*) from emp) / 30, 6) as rate from ev group by signal order by n desc, signal limit 10")
def a11_signal_rates(spark, d):
    return reports.signal_rates(events(spark, d), employees(spark, d).count(), 30)


@query(
    """select part as "partition", count(*)::bigint as n, count(distinct e)::bigint as employees, count(distinct s)::bigint as signals, count(*) filter (e is null)::bigint as parse_errors, count(*) filter (e <> employee_id)::bigint as key_mismatches,
              count(*) filter (e is null) = 0 and count(*) filter (e <> employee_id) = 0 as passed
       from (select employee_id, employee_id::bigint % 5 as part, case when seq % 101 in (0, 1, 13) then null when seq % 101 = 2 then '' else employee_id end as e, case when seq % 101 in (0, 1, 13) then null when seq % 101 in (3, 4, 16) then 'not_a_signal' else signal end as s
             from ev, (values (0), (1)) c(copy) where copy = 0 or seq % 101 = 6) group by part"""
)
def a12_topic_audit(spark, d):
    rows = messages(spark, d).withColumn("partition", F.col("key").cast("string").cast("long") % 5)
    return reports.topic_audit(rows)


@query("select department, count(*)::bigint as n, count(*) filter (hv)::bigint as high_value, round(count(*) / sum(count(*)) over (), 6) as share from emp group by department")
def a13_group_shares(spark, d):
    return reports.group_shares(employees(spark, d), "department")


@query("select count(*)::bigint as n, round(quantile_cont(score, 0.5), 2) as median, round(quantile_cont(score, 0.9), 2) as p90, max(score) as most, round(avg(case when band = 'critical' then 1.0 else 0.0 end), 6) as critical_share from scores")
def a14_score_distribution(spark, d):
    return reports.score_distribution(_scores(spark, d))


@query("select seniority as label, count(*)::bigint as n, ((2 * sum(round(score * 100)::bigint) + count(*)) // (2 * count(*)))::double / 100.0 as mean_score from scores join emp using (employee_id) group by seniority")
def a15_scores_by_label(spark, d):
    return reports.mean_by_label(_scores(spark, d), employees(spark, d).select("employee_id", F.col("seniority").alias("label")))


@query("select occurred_at::date::varchar as day, count(*)::bigint as n from ev group by 1")
def a17_events_per_day(spark, d):
    return reports.events_per_day(events(spark, d)).select(F.col("day").cast("string").alias("day"), "n")


@query(
    """select 'half_life_positive' as rule, count(*) filter (half_life_days <= 0)::bigint as violations from cat union all select 'signals_unique', (count(*) - count(distinct signal))::bigint from cat
       union all select 'submission_outweighs_click', case when max(case signal when 'phish_credentials_submitted' then weight end) > max(case signal when 'phish_sim_clicked' then weight end) then 0 else 1 end from cat
       union all select 'exposure_weighs_nothing', case when max(case signal when 'phish_sim_delivered' then weight end) = 0 then 0 else 1 end from cat
       union all select 'every_signal_priced', count(*) from (select distinct signal from ev where signal not in (select signal from cat)) union all select 'every_price_used', count(*) from cat where signal not in (select signal from ev)"""
)
def a19_catalog_checks(spark, d):
    return reports.catalog_checks(events(spark, d))


@query("select seq, occurred_at::date::varchar as day from ev")
def t5_replay_order(spark, d):
    return reports.replay_order(events(spark, d)).select("seq", F.col("day").cast("string").alias("day"))


@query("select seq as \"offset\", employee_id from ev order by seq limit 20")
def t6_first_messages(spark, d):
    return events(spark, d).select(F.col("seq").alias("offset"), "employee_id").orderBy("offset").limit(20)


@query("select employee_id, case when employee_id::int % 5 = 0 then 'moved' || (1 + employee_id::int % 2) else department end as department, employee_id::int % 5 = 0 as updated from emp")
def k6_upsert_dimension(spark, d):
    """Every fifth person changes department twice or thrice; the last change holds."""
    people = employees(spark, d).select("employee_id", "department").withColumn("updated_at", F.lit(None).cast("timestamp"))
    some = people.filter(F.col("employee_id").cast("int") % 5 == 0)
    changes = some.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).filter((F.col("n") < 2) | (F.col("employee_id").cast("int") % 2 == 1)).withColumn("department", F.concat(F.lit("moved"), F.col("n").cast("string")))
    return reports.upsert(people, changes, "employee_id", "n", as_of()).select("employee_id", "department", F.col("updated_at").isNotNull().alias("updated"))


@query("select employee_id, occurred_at::date::varchar as day, count(*)::bigint as n, count(distinct signal)::bigint as signals, min(at_us) as first_us, max(at_us) as last_us from ev group by 1, 2")
def g2_daily_rollup(spark, d):
    return reports.daily_rollup(events(spark, d)).select("employee_id", F.col("day").cast("string").alias("day"), "n", "signals", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"))


@query(
    """select department, case when tenure_days < 90 then 'new' when tenure_days < 730 then 'settled' else 'veteran' end as tenure, count(*)::bigint as n, ((2 * sum(round(score * 100)::bigint) + count(*)) // (2 * count(*)))::double / 100.0 as mean_score, max(score) as most,
       count(*) filter (band = 'critical')::bigint as critical from scores group by 1, 2"""
)
def g4_cohort_mart(spark, d):
    return reports.cohort_mart(_scores(spark, d), employees(spark, d))


@query(
    """select employee_id, day::varchar as day, n, round(mean, 4) as mean, round(spread, 4) as spread, case when spread > 0 then round((n - mean) / spread, 4) end as z from (
       select *, count(*) over w as before, avg(n) over w as mean, stddev_pop(n) over w as spread from (select employee_id, occurred_at::date as day, count(*)::bigint as n from ev group by 1, 2)
       window w as (partition by employee_id order by day range between interval 30 days preceding and interval 1 day preceding)) where before >= 2"""
)
def g5_baseline_deviation(spark, d):
    return reports.baseline_deviation(events(spark, d)).withColumn("day", F.col("day").cast("string"))


@query(
    """select case when occurred_at < timestamp '2024-01-16' then 'before' else 'since' end as period, count(*)::bigint as n, 0::bigint as null_event_id, count(*) filter (employee_id is null)::bigint as null_employee_id, count(*) filter (signal is null)::bigint as null_signal,
       round(avg(case when (in_us - at_us) / 1e6 > 300 then 1.0 else 0.0 end), 6) as late_share from ev group by 1"""
)
def g7_data_quality(spark, d):
    return reports.data_quality(events(spark, d), _split())


@query(
    """select signal, round(p, 6) as before, round(q, 6) as since, round(q - p, 6) as drift from (select signal, b / sum(b) over () as p, s / sum(s) over () as q from (
       select signal, count(*) filter (occurred_at < timestamp '2024-01-16') as b, count(*) filter (occurred_at >= timestamp '2024-01-16') as s from ev group by signal))"""
)
def g7_mix_drift(spark, d):
    return reports.mix_drift(events(spark, d), _split())


@query("select seq, employee_id from ev where occurred_at::date >= date '2024-01-31' - 20 and employee_id::int % 7 <> 0")
def g8_retention_and_deletion(spark, d):
    """Of the last 20 days, without every seventh person."""
    rows = events(spark, d).withColumn("day", F.to_date("occurred_at"))
    gone = employees(spark, d).filter(F.col("employee_id").cast("int") % 7 == 0)
    return reports.without_subjects(reports.retained(rows, F.lit("2024-01-31").cast("date"), 20), gone).select("seq", "employee_id")


_PATTERN = "count(*) filter (signal = '{s}') over (partition by employee_id order by at_us range between {w} preceding and current row) >= {n}"


def _detected(scale: int) -> str:
    parts = []
    for name, last, needed, minutes in incidents.PATTERNS:
        fine = " and ".join(_PATTERN.format(s=s, n=n, w=minutes * scale * incidents.MINUTE_US) for s, n in needed.items())
        parts.append(f"select '{name}' as pattern, seq, employee_id from (select *, signal = '{last}' and {fine} as hit from ev) where hit")
    return " union all ".join(parts)


@query(_detected(1440))
def g1_incidents(spark, d):
    """The tables' events are spread over a month, so that minutes count as days here."""
    return incidents.detect(events(spark, d), scale=1440).select("pattern", "seq", "employee_id")


_GATE = f"""
cand as (select *, row_number() over (partition by employee_id order by at_us, seq) as n from ev where weight > 0),
gated as (
    select employee_id, 0::bigint as n, null::bigint as seq, null::varchar as kind, null::varchar as decision, [null, null, null, null, null]::bigint[] as last, null::bigint as s1, null::bigint as s2 from (select distinct employee_id from cand)
    union all
    select employee_id, n, seq, category, decision, case when decision in ('sent', 'escalated') then list_transform(range(5), lambda i: case when i = category_ordinal then at_us else last[i + 1] end) else last end,
           case when decision in ('sent', 'escalated') then at_us else s1 end, case when decision in ('sent', 'escalated') then s1 else s2 end
    from (select g.employee_id, c.n, c.seq, c.category, c.category_ordinal, c.at_us, g.last, g.s1, g.s2,
                 case when c.at_us - g.last[c.category_ordinal + 1] < 72 * 3600000000 then 'cooldown'
                      when coalesce((c.at_us - g.s1 < 7 * 86400000000)::int, 0) + coalesce((c.at_us - g.s2 < 7 * 86400000000)::int, 0) >= 2 then 'weekly_cap'
                      when g.last[c.category_ordinal + 1] is not null then 'escalated' else 'sent' end as decision
          from gated g join cand c on c.employee_id = g.employee_id and c.n = g.n + 1))"""


@query("select employee_id, kind, seq, decision from gated where n > 0", _GATE)
def g6_intervention_gate(spark, d):
    """Candidates are all events that add risk, by category."""
    from ..functions.catalog import signal_catalog

    rows = events(spark, d).join(F.broadcast(signal_catalog(spark).filter("weight > 0").select("signal", "category")), "signal")
    out = incidents.gate(rows.select("employee_id", F.col("category").alias("kind"), F.col("occurred_at").alias("at"), "seq"))
    return out.select("employee_id", "kind", "seq", "decision")


@query("select 'left' as side, 'phish_sim_clickde' as signal, 1::bigint as n where exists (select 1 from ev where signal = 'phish_sim_clicked') union all select 'right', signal, 1::bigint from cat where signal = 'phish_sim_clicked' or signal not in (select signal from ev)")
def u2_vocabulary_equality(spark, d):
    """Signals of the events, one of them misspelt, against those of the catalog: the differences either way."""
    from ..functions.catalog import signal_catalog

    used = events(spark, d).select(F.when(F.col("signal") == "phish_sim_clicked", "phish_sim_clickde").otherwise(F.col("signal")).alias("signal")).distinct()
    return reports.same_rows(used, signal_catalog(spark).select("signal")).groupBy("side", "signal").agg(F.count("*").alias("n"))


@query(
    """select (select count(distinct signal) from told where drop_reason is null)::bigint as delivered, (select count(*) from cat where source not in ('okta', 'google_workspace', 'email_gateway', 'endpoint_agent'))::bigint as unconnected,
              (select count(distinct t.signal) from told t join cat c on c.signal = t.signal where drop_reason is null and c.source not in ('okta', 'google_workspace', 'email_gateway', 'endpoint_agent'))::bigint as both""",
    _VENDOR,
)
def u3_delivered_and_unconnected(spark, d):
    """Signals that vendors' records delivered, those of sources without a parser, and those that are both: none."""
    from ..functions.catalog import signal_catalog

    delivered = parsers.ingest(vendor_records(spark, d), employees(spark, d), "acme").filter("drop_reason is null").select("signal").distinct()
    unconnected = signal_catalog(spark).filter(~F.col("source").isin(list(parsers.PARSERS))).select("signal")
    n = lambda df, name: df.agg(F.count("*").alias(name))  # noqa: E731  one row each
    return n(delivered, "delivered").crossJoin(n(unconnected, "unconnected")).crossJoin(n(delivered.intersect(unconnected), "both"))


@query("select employee_id, department, location, case when employee_id::int % 3 = 0 then 'other' else tenant_id end as tenant_id from emp where employee_id::int % 3 <> 0")
def s4_people_of_tenant(spark, d):
    """The dimension's columns of one tenant, where every third person is another's."""
    people = employees(spark, d).withColumn("tenant_id", F.when(F.col("employee_id").cast("int") % 3 == 0, "other").otherwise(F.col("tenant_id")))
    return lake.people_of(people, "acme").select("employee_id", "department", "location", "tenant_id")


@query("select seq, 'null://raw/source=' || source || '/dt=' || strftime(occurred_at, '%Y-%m-%d') || '/' || source_event_id || '.json' as raw_ref from told where drop_reason is null", _VENDOR)
def k5_archive_references(spark, d):
    return parsers.ingest(vendor_records(spark, d), employees(spark, d), "acme").filter("drop_reason is null").select("seq", "raw_ref")


@query("select employee_id as key, score, band from scores")
def k8_published_messages(spark, d):
    """Keyed JSON messages of published scores, read back as a snapshot of the topic takes them."""
    published = topics.keyed(score.published_scores(events(spark, d), employees(spark, d), as_of()))
    value = F.from_json(F.col("value").cast("string"), "employee_id string, score double, band string, as_of timestamp")
    rows = published.select(F.col("key").cast("string").alias("key"), value.alias("v")).filter(F.col("key") == F.col("v.employee_id"))
    return rows.select("key", "v.score", "v.band")
