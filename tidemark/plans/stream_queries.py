"""Parsing, identity, normalizing, replay: what lies between raw records and scores."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..functions.scoring import email_key, lateness_seconds
from ..operators import identity, normalize, parsers, replay
from ..operators import score as scoring
from ..sources.adapter import as_of, employees, events, messages, vendor_records
from ..streaming import scorer
from .oracle import BAND, BANDS_TABLE, UUID5, sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(select: str | None = None, more: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if select:
            SQL[f.__name__] = sql(select, more)
        return f

    return add


# What the adapter's vendor records must become.
_VENDOR = """
dir as (select lower(trim(email)) as email_key, min(employee_id) as employee_id from emp group by 1 having count(distinct employee_id) = 1),
vendor as (
    select ev.*, ev.seq % 31 as odd, case when ev.seq % 31 = 2 then 'nobody@acme.example' else coalesce(emp.email, 'gone@acme.example') end as who
    from ev left join emp using (employee_id) where source in ('okta', 'google_workspace', 'email_gateway', 'endpoint_agent')),
told as (
    select v.*, d.employee_id as found,
           case when odd = 4 and signal = 'mfa_push_denied' then 'malformed'
                when odd = 0 or odd = 3 and (signal = 'mfa_push_denied' or source = 'endpoint_agent') or odd in (3, 4) and source = 'email_gateway' and signal like 'phish%' then 'unknown_event_type'
                when odd = 1 then 'malformed' when d.employee_id is null then 'unresolved_identity' end as drop_reason
    from vendor v left join dir d on d.email_key = lower(trim(v.who)))"""
_PARSED = """select seq, case when odd <> 0 then signal end as signal, case when odd <> 1 then at_us // {unit} * {unit} end as at_us, lower(trim(who)) as subject, source_event_id,
    case when drop_reason <> 'unresolved_identity' then drop_reason end as drop_reason from told where source = '{source}'"""


def _parser(source: str):
    def run(spark, d):
        rows = parsers.PARSERS[source](vendor_records(spark, d).filter(F.col("source") == source))
        return rows.select("seq", "signal", F.unix_micros("occurred_at").alias("at_us"), email_key(F.col("subject_email")).alias("subject"), "source_event_id", "drop_reason")

    return run


for _i, _source in enumerate(parsers.PARSERS, 1):
    QUERIES[f"p{_i}_{_source}"] = _parser(_source)
    SQL[f"p{_i}_{_source}"] = sql(_PARSED.format(source=_source, unit=1_000_000 if _source == "email_gateway" else 1), _VENDOR)


def _ingested(spark, d):
    return parsers.ingest(vendor_records(spark, d), employees(spark, d), "acme")


@query("select seq, source, case when odd <> 0 then signal end as signal, found as employee_id, drop_reason from told", _VENDOR)
def p5_ingest(spark, d):
    return _ingested(spark, d).select("seq", "source", "signal", "employee_id", "drop_reason")


@query(f"select seq, {UUID5.format(name="source || ':' || source_event_id")} as event_id from ev")
def p6_event_ids(spark, d):
    return events(spark, d).select("seq", "event_id")


@query("select signal, count(*)::bigint as n from (select e.signal, c.source as declared, case when e.seq % 7 = 0 then 'slack' else e.source end as source from ev e join cat c using (signal)) where source <> declared group by signal")
def p7_source_conformity(spark, d):
    """Every seventh event is given a source that may be wrong."""
    rows = events(spark, d).withColumn("source", F.when(F.col("seq") % 7 == 0, "slack").otherwise(F.col("source")))
    return parsers.wrong_source(rows).groupBy("signal").agg(F.count("*").alias("n"))


@query("select ordinal::int as ordinal, signal, source, source in ('okta', 'google_workspace', 'email_gateway', 'endpoint_agent') as has_parser from cat where signal not in (select signal from told where drop_reason is null)", _VENDOR)
def p8_vocabulary_coverage(spark, d):
    return parsers.undelivered(_ingested(spark, d).filter("drop_reason is null")).select("ordinal", "signal", "source", "has_parser")


@query(
    """select source, count(*)::bigint as fetched, count(*) filter (drop_reason is null)::bigint as emitted, count(*) filter (drop_reason = 'malformed')::bigint as malformed,
       count(*) filter (drop_reason = 'unknown_event_type')::bigint as unknown_event_type, count(*) filter (drop_reason = 'unresolved_identity')::bigint as unresolved_identity from told group by source""",
    _VENDOR,
)
def a6_ingest_counters(spark, d):
    n = lambda r: F.count(F.when(F.col("drop_reason") == r, 1)).alias(r)
    return _ingested(spark, d).groupBy("source").agg(F.count("*").alias("fetched"), F.count(F.when(F.col("drop_reason").isNull(), 1)).alias("emitted"), n("malformed"), n("unknown_event_type"), n("unresolved_identity"))


@query("select email_key, employee_id from dir", _VENDOR)
def d1_directory(spark, d):
    return identity.directory(employees(spark, d))


@query("select lower(trim(email)) as email_key, count(distinct employee_id)::bigint as holders from emp group by 1 having count(distinct employee_id) > 1")
def a18_ambiguous_emails(spark, d):
    return identity.ambiguous(employees(spark, d))


@query("select lower(trim(who)) as email_key, count(*)::bigint as n from told where drop_reason = 'unresolved_identity' group by 1", _VENDOR)
def d5_unresolved(spark, d):
    parsed = parsers.parse_okta(vendor_records(spark, d).filter("source = 'okta'"))
    for name in ("google_workspace", "email_gateway", "endpoint_agent"):
        parsed = parsed.unionByName(parsers.PARSERS[name](vendor_records(spark, d).filter(F.col("source") == name)))
    return identity.unresolved(parsed.filter("drop_reason is null"), employees(spark, d), "subject_email")


@query("select employee_id, manager_id from emp where manager_id is not null and manager_id not in (select employee_id from emp)")
def d6_missing_managers(spark, d):
    return identity.missing_managers(employees(spark, d))


_MESSAGES = """
msg as (select ev.*, seq % 101 as odd, copy, seq * 2 + copy as off from ev, (values (0), (1)) c(copy) where copy = 0 or seq % 101 = 6),
decided as (select *, case when odd in (0, 1, 2, 13) then 'dead_lettered' when copy = 1 then 'duplicate' when odd in (4, 16) then 'forwarded_unknown_version' when odd in (3, 5, 7, 8, 9, 10, 17) then 'dead_lettered' else 'emitted' end as outcome from msg)"""


@query("select off as \"offset\", outcome, case when odd not in (0, 1, 2, 13) then employee_id end as out_key, case when outcome = 'emitted' then signal end as signal, case when outcome = 'emitted' then case when odd = 12 then at_us // 1000 * 1000 else at_us end end as at_us from decided", _MESSAGES)
def n1_normalize(spark, d):
    rows = normalize.normalize(messages(spark, d))
    value = F.when(F.col("outcome") == normalize.EMITTED, F.from_json(F.col("out_value").cast("string"), "signal string, occurred_at timestamp"))
    return rows.select("offset", "outcome", F.col("out_key").cast("string").alias("out_key"), value["signal"].alias("signal"), F.unix_micros(value["occurred_at"]).alias("at_us"))


@query("select case when outcome = 'forwarded_unknown_version' then 'malformed' when employee_id in (select employee_id from emp) then 'scored' else 'unknown_employee' end as outcome, count(*)::bigint as n from decided where outcome in ('emitted', 'forwarded_unknown_version') and seq % 10 <> 0 group by 1", _MESSAGES)
def w7_scoring_outcomes(spark, d):
    """What the scorer makes of the normalizer's messages, every tenth without a value: what it can't read or doesn't know is counted, not lost."""
    rows = normalize.normalize(messages(spark, d)).filter(F.col("outcome").isin(normalize.EMITTED, normalize.FORWARDED))
    sent = rows.select(F.col("out_key").alias("key"), F.when(F.floor(F.col("offset") / 2) % 10 != 0, F.col("out_value")).alias("value"))
    return scorer.outcomes(scorer.parsed(sent), employees(spark, d)).groupBy("outcome").agg(F.count("*").alias("n"))


@query("select employee_id, count(*)::bigint as n, 1::bigint as partitions from ev group by employee_id")
def k9_one_partition_a_person(spark, d):
    rows = messages(spark, d).filter(F.col("offset") % 2 == 0).repartition("key").withColumn("at", F.spark_partition_id())
    return rows.groupBy(F.col("key").cast("string").alias("employee_id")).agg(F.count("*").alias("n"), F.count_distinct("at").alias("partitions"))


@query("select outcome, count(*)::bigint as n from decided group by outcome", _MESSAGES)
def a7_normalizer_counters(spark, d):
    return normalize.outcome_counts(normalize.normalize(messages(spark, d)))


@query("select case when odd not in (0, 1, 2, 13) then employee_id end as key, case odd when 0 then 'undecodable' when 13 then 'undecodable' when 1 then 'not a JSON object' when 2 then 'missing routing fields: employee_id' else 'invalid' end as reason, count(*)::bigint as n from decided where outcome = 'dead_lettered' group by all", _MESSAGES)
def k7_dead_letters(spark, d):
    rows = normalize.dead_letters(normalize.normalize(messages(spark, d)))
    return rows.groupBy(F.col("key").cast("string").alias("key"), F.get("headers", F.lit(0))["value"].cast("string").alias("reason")).agg(F.count("*").alias("n"))


@query("select seq, case when copy = 1 then true else false end as duplicate, off as \"offset\" from msg where odd > 2 and odd <> 13", _MESSAGES)
def x1_first_occurrence(spark, d):
    rows = normalize.normalize(messages(spark, d)).filter("out_key is not null")
    return rows.select(F.floor(F.col("offset") / 2).alias("seq"), (F.col("outcome") == normalize.DUPLICATE).alias("duplicate"), "offset")


_REPLAY = f"""
pairs as (
    select a.employee_id, a.seq, a.at_us, a.in_us, b.weight * case when b.at_us >= a.at_us then 1.0 else pow(0.5, (a.at_us - b.at_us) / 86400000000.0 / b.half_life_days) end as plain, hv
    from ev a join emp using (employee_id) join ev b on a.employee_id = b.employee_id and b.at_us <= a.at_us and a.at_us - b.at_us <= 30 * 86400000000),
running as (select *, {BAND} as band from (
    select employee_id, seq, any_value(at_us) as at_us, any_value(in_us) as in_us, count(*) as n, sum(case when plain > 0 and hv then plain * 1.4 else plain end) as raw,
           round(case when sum(case when plain > 0 and hv then plain * 1.4 else plain end) <= 0 then 0.0 else (1.0 - exp(-sum(case when plain > 0 and hv then plain * 1.4 else plain end) / 30.0)) * 100.0 end, 2) as score
    from pairs group by employee_id, seq)),
moved as (select *, lag(band) over (partition by employee_id order by at_us, seq) as previous_band from running)"""


def _replayed(spark, d):
    seq = events(spark, d).select("event_id", "seq")
    return replay.replay_scores(events(spark, d), employees(spark, d)).join(seq, "event_id")


@query("select seq, employee_id, score, band, n::bigint as events_considered from running", _REPLAY)
def x5_replay_scores(spark, d):
    return _replayed(spark, d).select("seq", "employee_id", "score", "band", F.col("events_considered").cast("long").alias("events_considered"))


@query("select seq, employee_id, band, previous_band, coalesce(previous_band <> band, false) as band_changed from moved", _REPLAY)
def x3_band_transitions(spark, d):
    return replay.transitions(_replayed(spark, d), ["occurred_at", "seq"]).select("seq", "employee_id", "band", "previous_band", "band_changed")


@query("select 'scored' as outcome, count(*)::bigint as n, count(*) filter (previous_band <> band)::bigint as band_changes from moved union all select 'unknown_employee', count(*)::bigint, 0::bigint from ev where employee_id not in (select employee_id from emp) having count(*) > 0", _REPLAY)
def a8_scorer_counters(spark, d):
    outcomes = replay.scored_outcomes(events(spark, d), employees(spark, d))
    changed = replay.transitions(_replayed(spark, d), ["occurred_at", "seq"]).select("seq", "band_changed")
    rows = outcomes.join(changed, "seq", "left")
    return rows.groupBy("outcome").agg(F.count("*").alias("n"), F.count(F.when(F.col("band_changed"), 1)).alias("band_changes"))


@query(
    """select p.point, 'event' as latency, list_sort(list(lat))[least(floor(p.point / 100 * count(*)), count(*) - 1)::int + 1] as value from (select ((epoch_us(timestamp '2024-01-31') - at_us) / 1e3)::double as lat from ev join emp using (employee_id)), (values (50.0::double), (95.0::double), (99.0::double)) p(point) group by p.point
       union all select p.point, 'pipeline', list_sort(list(lat))[least(floor(p.point / 100 * count(*)), count(*) - 1)::int + 1] from (select ((epoch_us(timestamp '2024-01-31') - in_us) / 1e3)::double as lat from ev join emp using (employee_id)), (values (50.0::double), (95.0::double), (99.0::double)) p(point) group by p.point"""
)
def a9_latency_percentiles(spark, d):
    rows = events(spark, d).join(employees(spark, d).select("employee_id"), "employee_id", "left_semi")
    rows = replay.with_latencies(rows, as_of())
    out = [replay.percentiles(rows, f"{k}_latency_ms").withColumn("latency", F.lit(k)) for k in ("event", "pipeline")]
    return out[0].unionByName(out[1])


@query(f"select b.ordinal::int as ordinal, b.band, count(s.band)::bigint as n from (values {BANDS_TABLE}) b(ordinal, band) left join scores s using (band) group by all")
def a10_band_histogram(spark, d):
    return replay.band_histogram(scoring.population_scores(events(spark, d), employees(spark, d), as_of()))


@query(
    """select seq, signal, case signal when 'phish_sim_clicked' then delivered is not null else clicked is not null end as in_order from (
       select *, max(case when signal = 'phish_sim_delivered' then at_us end) over w as delivered, max(case when signal = 'phish_sim_clicked' then at_us end) over w as clicked from ev
       window w as (partition by employee_id order by at_us range between unbounded preceding and 1 preceding)) where signal in ('phish_sim_clicked', 'phish_credentials_submitted')"""
)
def d7_causal_order(spark, d):
    rows = replay.causal_order(events(spark, d)).join(events(spark, d).select("event_id", "seq"), "event_id")
    return rows.select("seq", "signal", "in_order")


@query("select seq, (in_us - at_us) / 1e6 as lateness_seconds from ev")
def f9_lateness(spark, d):
    return events(spark, d).select("seq", lateness_seconds(F.col("ingested_at"), F.col("occurred_at")).alias("lateness_seconds"))


@query("select case when (in_us - at_us) / 1e6 > 300 then 'late' else 'in_time' end as kind, count(*)::bigint as n, sum(case when hour(occurred_at) between 8 and 19 then 1 else 0 end)::bigint as in_hours from ev group by 1")
def a16_late_and_working_hours(spark, d):
    late = lateness_seconds(F.col("ingested_at"), F.col("occurred_at")) > 300
    return events(spark, d).groupBy(F.when(late, "late").otherwise("in_time").alias("kind")).agg(F.count("*").alias("n"), F.count(F.when(F.hour("occurred_at").between(8, 19), 1)).alias("in_hours"))


