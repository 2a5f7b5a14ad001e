"""Streaming queries run to the end of what is there, over messages and events from the given tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import parsers, replay, reports
from ..sources import lake, latest
from ..sources.adapter import as_of, employees, events, messages, vendor_records
from ..sources.topics import read_folder
from ..streaming import bounded, counters, normalizer, scorer
from .oracle import sql
from .stream_queries import _MESSAGES, _REPLAY, _VENDOR

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(select: str, more: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql(select, more)
        return f

    return add


def _folder(spark) -> str:
    """A new folder where the driver and the executors see it: under spark.checkpoint.dir. Where that is unset, a local session has one of its own, and a cluster is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    return f"{where.rstrip('/')}/{uuid.uuid4().hex}" if where else "file://" + tempfile.mkdtemp(prefix="tidemark-")


@query("select off as \"offset\", outcome, case when outcome = 'emitted' then signal end as signal, case when outcome = 'emitted' then case when odd = 12 then at_us // 1000 * 1000 else at_us end end as at_us from decided", _MESSAGES)
def n2_stream_normalizer(spark, d):
    """All outcomes of the stream, duplicates too, and what was sent."""
    root = _folder(spark)
    messages(spark, d).write.parquet(f"{root}/topic")
    rows = normalizer.tagged_stream(read_folder(spark, f"{root}/topic"), expire=False)
    scorer.run(rows, f"{root}/decisions", f"{root}/checkpoint")
    value = F.when(F.col("outcome") == "emitted", F.from_json(F.col("out_value").cast("string"), "signal string, occurred_at timestamp"))
    return spark.read.schema(rows.schema).parquet(f"{root}/decisions").select("offset", "outcome", value["signal"].alias("signal"), F.unix_micros(value["occurred_at"]).alias("at_us"))


def _thirds(rows, at: str):
    """Rows of three spans of time, one after another."""
    bounds = [F.lit(t).cast("timestamp") for t in ("2024-01-10", "2024-01-20")]
    return rows.filter(F.col(at) < bounds[0]), rows.filter((F.col(at) >= bounds[0]) & (F.col(at) < bounds[1])), rows.filter(F.col(at) >= bounds[1])


def _totals(spark, build, rows, at, name, sums) -> DataFrame:
    """Counters of three runs over one checkpoint, added up by the listener alone."""
    root = _folder(spark)
    with counters.following(spark) as totals:
        for part in _thirds(rows, at):
            part.write.mode("append").parquet(f"{root}/in")
            query = build(spark.readStream.schema(rows.schema).parquet(f"{root}/in")).writeStream.format("noop").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
            totals.after(query)
    return spark.createDataFrame([(k, totals.sums[name][k]) for k in sums], "counter string, n long")


_EACH = "union all select '{0}', count(*) filter ({1})::bigint from {2} "


@query("select 'total' as counter, count(*)::bigint as n from told " + _EACH.format("emitted", "drop_reason is null", "told") + "".join(_EACH.format(r, f"drop_reason = '{r}'", "told") for r in ("malformed", "unknown_event_type", "unresolved_identity")), _VENDOR)
def a6_stream_counters(spark, d):
    """Records of the vendors as a stream of files, counted as they pass."""
    rows = vendor_records(spark, d).join(events(spark, d).select("seq", F.col("occurred_at").alias("came_at")), "seq")
    people = employees(spark, d)
    build = lambda stream: counters.counted(parsers.ingest(stream, people, "acme"), "ingest", F.coalesce("drop_reason", F.lit("emitted")), ("emitted", "malformed", "unknown_event_type", "unresolved_identity"))
    return _totals(spark, build, rows, "came_at", "ingest", ("total", "emitted", "malformed", "unknown_event_type", "unresolved_identity"))


@query("select 'total' as counter, count(*)::bigint as n from decided " + "".join(_EACH.format(r, f"outcome = '{r}'", "decided") for r in ("emitted", "duplicate", "forwarded_unknown_version", "dead_lettered")), _MESSAGES)
def a7_stream_counters(spark, d):
    build = lambda stream: normalizer.with_counters(normalizer.tagged_stream(stream, expire=False))
    return _totals(spark, build, messages(spark, d), "timestamp", "normalizer", ("total", "emitted", "duplicate", "forwarded_unknown_version", "dead_lettered"))


@query("select 'total' as counter, count(*)::bigint as n from moved " + _EACH.format("band_changes", "previous_band <> band", "moved"), _REPLAY)
def a8_stream_counters(spark, d):
    rows, people = events(spark, d).select("event_id", "employee_id", "signal", "occurred_at", "ingested_at", "seq"), employees(spark, d)
    build = lambda stream: counters.counted(scorer.band_stream(scorer.score_stream(stream, people, as_of="occurred_at", arrival="occurred_at", expire=False)), "scorer", F.lit(""), (), band_changes=F.col("band_changed"))
    return _totals(spark, build, rows, "occurred_at", "scorer", ("total", "band_changes"))


@query("select employee_id, score, band, seq from moved qualify row_number() over (partition by employee_id order by at_us desc, seq desc) = 1", _REPLAY)
def k8_latest_scores(spark, d):
    """Scores as they are published, in three runs, into a table of the latest one a person; the last batch is given twice."""
    root, people = _folder(spark), employees(spark, d)
    rows = events(spark, d).select("event_id", "employee_id", "signal", "occurred_at", "ingested_at", "seq")
    sink = latest.latest_sink(f"{root}/latest", "employee_id", ["as_of", "seq"], buckets=16)

    def twice(batch, batch_id):
        sink(batch, batch_id)
        sink(batch, batch_id)

    for part in _thirds(rows, "occurred_at"):
        part.write.mode("append").parquet(f"{root}/in")
        scores = scorer.score_stream(spark.readStream.schema(rows.schema).parquet(f"{root}/in"), people, as_of="occurred_at", arrival="occurred_at", expire=False)
        scores.writeStream.foreachBatch(lake.fan_out([twice])).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return latest.read_latest(spark, f"{root}/latest", scores.schema, "score").select("employee_id", "score", "band", "seq")


@query("select off as \"offset\", 1::bigint as n from decided where outcome in ('emitted', 'forwarded_unknown_version')", _MESSAGES)
def s3_bounded_runs(spark, d):
    """Runs that each stop with the batch that reaches a third of the messages, until all are through: each message is sent once."""
    root, topic = _folder(spark), messages(spark, d)
    topic.repartition(6).write.parquet(f"{root}/topic")
    most, limit = topic.count() // 3, 12
    while limit and bounded.run_bounded(normalizer.tagged_stream(read_folder(spark, f"{root}/topic", files_per_batch=1), expire=False), normalizer.sinks(f"{root}/emitted", f"{root}/dead"), f"{root}/checkpoint", most=most, idle_seconds=3.0):
        limit -= 1
    return _sent(spark, d, root)


def _sent(spark, d, root):
    sent = spark.read.schema("event_id string, outcome string").parquet(f"{root}/emitted")
    ids = messages(spark, d).filter(F.col("offset") % 2 == 0).select((F.col("offset") / 2).cast("long").alias("seq"), "offset").join(events(spark, d).select("seq", "event_id"), "seq")
    return sent.join(ids, "event_id").groupBy("offset").agg(F.count("*").alias("n"))


def _events(spark, d, root):
    """Events as a stream of files."""
    rows = events(spark, d).select("event_id", "employee_id", "signal", "occurred_at", "ingested_at", "seq")
    rows.write.mode("append").parquet(f"{root}/events")
    return spark.readStream.schema(rows.schema).parquet(f"{root}/events")


def _scored(spark, d, banded=True, at="occurred_at", **options):
    """Events through the scorer to a table; with bands by the state after it in the same query."""
    root = _folder(spark)
    rows = scorer.score_stream(_events(spark, d, root), employees(spark, d), as_of=at, arrival=at, expire=False, **options)
    rows = scorer.band_stream(rows) if banded else rows
    scorer.run(rows, f"{root}/scores", f"{root}/checkpoint")
    return spark.read.schema(rows.schema).parquet(f"{root}/scores")


@query("select seq, employee_id, score, band, n::int as events_considered, previous_band, coalesce(previous_band <> band, false) as band_changed from moved", _REPLAY)
def n5_stream_scores(spark, d):
    """Windows and last bands in two states of one query."""
    return _scored(spark, d).select("seq", "employee_id", "score", "band", "events_considered", "previous_band", "band_changed")


_LATE = """
late as (
    select a.seq, b.weight * case when a.in_us <= b.at_us then 1.0 else pow(0.5, (a.in_us - b.at_us) / 86400000000.0 / b.half_life_days) end as p, hv
    from ev a join emp using (employee_id) join ev b on a.employee_id = b.employee_id and (b.in_us < a.in_us or b.in_us = a.in_us and b.seq <= a.seq) and a.in_us - b.at_us <= 30 * 86400000000),
late_sums as (select seq, count(*)::int as n, sum(case when p > 0 and hv then p * 1.4 else p end) as raw from late group by seq)"""


@query("select seq, n as events_considered, round(case when raw <= 0 then 0.0 else (1.0 - exp(-raw / 30.0)) * 100.0 end, 2) as score from late_sums", _LATE)
def n6_late_arrivals(spark, d):
    """Scores in the order and at the time of arrival, which isn't the order of the events: none is dropped for being late, each counts from when it came."""
    return _scored(spark, d, banded=False, at="ingested_at").select("seq", "events_considered", "score")


_SIGNALS = """
bysig as (select seq, signal, category, category_ordinal, count(*) as occurrences, sum(case when p > 0 and hv then p * 1.4 else p end) as raw from (
    select a.seq as seq, b.signal, b.category, b.category_ordinal, hv, b.weight * case when b.at_us >= a.at_us then 1.0 else pow(0.5, (a.at_us - b.at_us) / 86400000000.0 / b.half_life_days) end as p
    from ev a join emp using (employee_id) join ev b on a.employee_id = b.employee_id and b.at_us <= a.at_us and a.at_us - b.at_us <= 30 * 86400000000) group by all),
bytop as (select seq, string_agg(signal || ':' || occurrences || ':' || round(round(raw, 3) * 1000)::bigint, ',' order by round(raw, 3) desc, signal) as tops from (select * from bysig where round(raw, 3) >= 0 qualify row_number() over (partition by seq order by round(raw, 3) desc, signal) <= 5) group by seq),
bycats as (select seq, string_agg(category || ':' || round(v * 1000)::bigint, ',' order by category || ':' || round(v * 1000)::bigint) as cats from (select seq, category, round(sum(raw), 3) as v, sum(raw) as s from bysig group by all) where s <> 0 group by seq),
bydom as (select seq, category as dom from (select seq, category, category_ordinal, round(sum(raw), 3) as v from bysig group by all) where v > 0 qualify row_number() over (partition by seq order by v desc, category_ordinal) = 1)"""


@query(
    "select r.seq, r.score, dom as dominant_category, coalesce(tops, '') as top_factors, coalesce(cats, '') as by_category from running r left join bytop using (seq) left join bydom using (seq) left join bycats using (seq)",
    f"{_REPLAY}, {_SIGNALS}",
)
def n5_stream_attribution(spark, d):
    """The stream's scores with what they come from, in thousandths."""
    thousandths = lambda x: F.round(x * 1000).cast("long").cast("string")
    tops = F.array_join(F.transform("top_factors", lambda f: F.concat_ws(":", f["signal"], f["occurrences"].cast("string"), thousandths(f["contribution"]))), ",")
    cats = F.array_join(F.array_sort(F.transform(F.map_entries("by_category"), lambda e: F.concat_ws(":", e["key"], thousandths(e["value"])))), ",")
    return _scored(spark, d, banded=False, attributed=True).select("seq", "score", "dominant_category", tops.alias("top_factors"), cats.alias("by_category"))


@query("select seq, score, band, n as events_considered from running where false", _REPLAY)
def g3_stream_batch_parity(spark, d):
    """Scores that the stream and the batch replay don't have in common: none."""
    seq, columns = events(spark, d).select("event_id", "seq"), ["seq", "score", "band", F.col("events_considered").cast("long").alias("events_considered")]
    batch = replay.replay_scores(events(spark, d), employees(spark, d)).join(seq, "event_id").select(*columns)
    stream = _scored(spark, d).select(*columns)
    return stream.exceptAll(batch).unionAll(batch.exceptAll(stream))


@query("select off as \"offset\", 1::bigint as n from decided where outcome in ('emitted', 'forwarded_unknown_version')", _MESSAGES)
def u4_partial_and_resumed(spark, d):
    """The normalizer stopped after half of the messages and started again on the same checkpoint: all that one run sends, each message once."""
    root = _folder(spark)
    topic = messages(spark, d)
    middle = F.col("timestamp") >= F.lit("2024-01-16").cast("timestamp")
    for part in (~middle, middle):
        topic.filter(part).write.mode("append").parquet(f"{root}/topic")
        normalizer.run(read_folder(spark, f"{root}/topic"), f"{root}/emitted", f"{root}/dead", f"{root}/checkpoint")
    return _sent(spark, d, root)


@query("select employee_id, events_considered::int as events_considered, score, band, 1::bigint as n from scores where events_considered > 0")
def n9_replay_inertness(spark, d):
    """All events a second time over the first run's state: all that the second run says is each person's score as it was, once and not twice counted."""
    root = _folder(spark)
    for run in (1, 2):
        stream = _events(spark, d, root).withColumn("as_of", as_of())
        scores = scorer.score_stream(stream, employees(spark, d), as_of="as_of", arrival="occurred_at", expire=False).withColumn("run", F.lit(run))
        scorer.run(scores, f"{root}/scores", f"{root}/checkpoint")
    told = spark.read.schema(scores.schema).parquet(f"{root}/scores").filter("run = 2").select("employee_id", "events_considered", "score", "band").distinct()
    return told.withColumn("n", F.count("*").over(Window.partitionBy("employee_id")))


@query("select source, occurred_at::date::varchar as dt, count(*)::bigint as n, true as same from told group by all", _VENDOR)
def s7_raw_archive(spark, d):
    """All vendor records, parsed or not, written as they came and read back by source and date: as many, and with the very payloads (by a sum of hashes)."""
    root = _folder(spark)
    at = events(spark, d).select("seq", "occurred_at", "source_event_id")
    rows = vendor_records(spark, d).join(at, "seq")
    lake.write_raw(rows, root)
    sums = lambda df, n, h: df.groupBy("source", F.col("dt").cast("string").alias("dt")).agg(F.count("*").alias(n), F.sum(F.xxhash64("source_event_id", "payload").cast("decimal(20, 0)")).alias(h))
    written = sums(rows.withColumn("dt", F.date_format("occurred_at", "yyyy-MM-dd")), "written", "was")
    both = sums(lake.read_raw(spark, root), "n", "is").join(written, ["source", "dt"], "full")
    return both.select("source", "dt", "n", F.coalesce((F.col("is") == F.col("was")) & (F.col("n") == F.col("written")), F.lit(False)).alias("same"))


@query("select seq, employee_id from ev where occurred_at::date >= date '2024-01-11' and employee_id::int % 7 <> 0")
def g8_forgotten_in_files(spark, d):
    """The lake after days have gone by their folders and people by the files that hold them."""
    root = _folder(spark)
    lake.write_events(events(spark, d), root)
    lake.drop_days(spark, root, "2024-01-11")
    lake.forget(spark, root, employees(spark, d).filter(F.col("employee_id").cast("int") % 7 == 0).unionByName(_strangers(spark, d)))
    return lake.read_events(spark, root).select(F.element_at(F.split("source_event_id", "-"), -1).cast("long").alias("seq"), "employee_id")


def _strangers(spark, d):
    """People of events that the dimension doesn't know: forgotten too where their number says so."""
    known = employees(spark, d)
    rows = events(spark, d).select("employee_id").distinct().join(known.select("employee_id"), "employee_id", "left_anti").filter(F.col("employee_id").cast("int") % 7 == 0)
    return rows.select(*[F.col(c) if c == "employee_id" else F.lit(None).cast(known.schema[c].dataType).alias(c) for c in known.columns])


@query("select employee_id as key, true as deleted from emp where employee_id::int % 7 = 0")
def g8_tombstones(spark, d):
    """What makes a compacted topic forget people."""
    rows = reports.tombstones(employees(spark, d).filter(F.col("employee_id").cast("int") % 7 == 0))
    return rows.select(F.col("key").cast("string").alias("key"), F.col("value").isNull().alias("deleted"))


@query("select seq, signal, occurred_at::date::varchar as dt from ev")
def s1_lake_round_trip(spark, d):
    """Events written to the lake by date and read back, the days before and since one date by two reads."""
    root = _folder(spark)
    lake.write_events(events(spark, d), root)
    rows = lake.read_events(spark, root, since="2024-01-20").unionByName(lake.read_events(spark, root).filter("dt < '2024-01-20'"))
    return rows.select(F.element_at(F.split("source_event_id", "-"), -1).cast("long").alias("seq"), "signal", F.col("dt").cast("string").alias("dt"))
