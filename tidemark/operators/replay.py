"""What the stream would have said, from tables: a score after each event, and where bands change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import BANDS, SIGNALS, signal_catalog
from ..functions.scoring import DAY_US, HIGH_VALUE, LOOKBACK_DAYS, band_of, latency_ms, score_of
from .score import WINDOW_EVENTS


def catalog_arrays() -> tuple[Column, Column]:
    """Weights and half-lives by signal ordinal, as literals."""
    return F.array(*[F.lit(s[2]) for s in SIGNALS]), F.array(*[F.lit(s[3]) for s in SIGNALS])


def with_ordinal(events: DataFrame) -> DataFrame:
    """Adds signal_ordinal. A signal without a price is an error, never nothing."""
    ordinals = signal_catalog(events.sparkSession).select("signal", F.col("ordinal").alias("_ordinal"))
    rows = events.join(F.broadcast(ordinals), "signal", "left")  # 23 rows
    priced = F.when(F.col("_ordinal").isNull(), F.raise_error(F.concat(F.lit("no price for signal "), F.col("signal"))).cast("int")).otherwise(F.col("_ordinal"))
    return rows.withColumn("signal_ordinal", priced).drop("_ordinal")


#: Half-lives of the catalog. Contributions that fade alike are added up together.
HALF_LIVES = sorted({s[3] for s in SIGNALS})


def _leaving(rows: DataFrame, most: int) -> DataFrame:
    """Adds leaves: when the event that is `most` places later came, for people with more than `most` events; null for all others.

    A busy person is numbered by blocks of time, with what the blocks before hold added; so not even one person's events
    meet in one task.
    """
    blocks = rows.groupBy("employee_id", "block").agg(F.count("*").alias("n"))
    w = Window.partitionBy("employee_id")
    blocks = blocks.withColumns({"all": F.sum("n").over(w), "before": F.sum("n").over(w.orderBy("block")) - F.col("n")}).filter(F.col("all") > most)
    place = F.row_number().over(Window.partitionBy("employee_id", "block").orderBy("at", "event_id")) + F.col("before")
    busy = rows.join(blocks.select("employee_id", "block", "before"), ["employee_id", "block"]).withColumn("place", place).drop("before")
    later = busy.select("employee_id", (F.col("place") - most).alias("place"), F.col("at").alias("leaves"))
    busy = busy.join(later, ["employee_id", "place"], "left").drop("place")
    calm = rows.join(blocks.select("employee_id").distinct(), "employee_id", "left_anti").withColumn("leaves", F.lit(None).cast("long"))
    return calm.unionByName(busy)


def replay_scores(events: DataFrame, people: DataFrame, lookback_days: int = LOOKBACK_DAYS, most: int = WINDOW_EVENTS) -> DataFrame:
    """Per event of a known person: the score at its own time from the `most` latest events of the lookback up to it (ties in time included, by event_id).

    Sums, not lists: a person's time is cut into blocks as long as the lookback. An event adds its weight, scaled by its
    half-life from the block's start, at its time; it leaves when it is too old, which falls into the next block, or when
    `most` later events are there. What a row sees is then the running sum of what came in its block less what left
    there, and the running sum from the other end of what the block before it still holds. So a row costs one step for
    each half-life (nine) however many events its person has, and no row holds more than that.
    """
    us, long = F.unix_micros, lookback_days * DAY_US + 1
    rows = with_ordinal(events.filter("signal is not null and occurred_at is not null").join(people.select("employee_id", "is_high_value"), "employee_id"))
    weights, half_lives = catalog_arrays()
    weight = F.get(weights, F.col("signal_ordinal"))
    rows = rows.select("employee_id", "event_id", us("occurred_at").alias("at"), us("ingested_at").alias("ingested"), F.when((weight > 0) & F.col("is_high_value"), weight * HIGH_VALUE).otherwise(weight).alias("weight"), F.get(half_lives, F.col("signal_ordinal")).alias("half_life"))
    rows = _leaving(rows.withColumn("block", F.floor(F.col("at") / long)), most)
    ends = F.least(F.col("at") + long, F.coalesce("leaves", F.col("at") + long))  # the first time that doesn't see the event
    start = F.col("block") * long
    mark = lambda kind, block, at: F.struct(F.lit(kind).alias("kind"), block.alias("block"), at.alias("at"))
    came, left = mark(0, F.col("block"), F.col("at")), F.when(F.col("ends") < start + long, mark(1, F.col("block"), F.col("ends")))
    still = F.when(F.col("ends") > start + long, mark(2, F.col("block") + 1, F.col("ends") - 1))
    marks = rows.withColumn("ends", ends).withColumn("mark", F.explode(F.array_compact(F.array(came, left, still))))
    scaled = F.col("weight") * F.pow(F.lit(2.0), (F.col("at") - F.col("mark.block") * long) / float(DAY_US) / F.col("half_life"))
    own = lambda c: F.when(F.col("mark.kind") == 0, F.col(c)).alias(c)
    marks = marks.select("employee_id", "mark.block", "mark.kind", F.col("mark.at").alias("at"), own("event_id"), own("ingested"), F.when(F.col("mark.kind") == 1, -scaled).otherwise(scaled).alias("value"), F.when(F.col("mark.kind") == 1, -1).otherwise(1).alias("one"), "half_life")
    w = Window.partitionBy("employee_id", "block")
    up = w.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = w.orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    here, held = F.col("kind") != 2, F.col("kind") == 2
    both = lambda c, of: (F.sum(F.when(here & of, F.col(c)).otherwise(0)).over(up) + F.sum(F.when(held & of, F.col(c)).otherwise(0)).over(down))
    sums = marks.withColumns({**{f"s{k}": both("value", F.col("half_life") == h) for k, h in enumerate(HALF_LIVES)}, "n": both("one", F.lit(True))}).filter("kind = 0")
    age = (F.col("at") - F.col("block") * long) / float(DAY_US)
    raw = sum((F.col(f"s{k}") * F.pow(F.lit(0.5), age / h) for k, h in enumerate(HALF_LIVES)), F.lit(0.0))
    rows = sums.withColumn("score", score_of(raw))
    return rows.select("employee_id", "event_id", F.timestamp_micros("at").alias("occurred_at"), F.timestamp_micros("ingested").alias("ingested_at"), "score", band_of(F.col("score")).alias("band"), F.col("n").cast("int").alias("events_considered"))


def transitions(scores: DataFrame, order: list[str]) -> DataFrame:
    """Adds previous_band and band_changed; the first score of a person changes nothing."""
    before = F.lag("band").over(Window.partitionBy("employee_id").orderBy(*order))
    return scores.withColumn("previous_band", before).withColumn("band_changed", F.coalesce(F.col("previous_band") != F.col("band"), F.lit(False)))


def with_latencies(scores: DataFrame, now: Column) -> DataFrame:
    return scores.withColumns({"event_latency_ms": latency_ms(now, F.col("occurred_at")), "pipeline_latency_ms": latency_ms(now, F.col("ingested_at"))})


#: So few values are looked at one by one.
FEW = 10_000
#: Accuracy of the sketch that brackets a place.
ACCURACY = 10_000


def elements_at(values: DataFrame, column: str, places: list[int], total: int) -> dict[int, float]:
    """The elements of the sorted values (`total` without nulls and NaN) at places from 0, exactly, by selection in passes.

    A sketch brackets each place between two values; counting what is below and between them says for certain where the
    place is, and the next pass looks at those values only. Each pass cuts what is left some thousand times, until it is
    FEW. So a task holds a sketch, the driver a few numbers, and nothing hangs on how rows are dealt or sorted.
    """
    x = F.col("x")
    rows = values.select(F.col(column).cast("double").alias("x")).filter("x is not null and not isnan(x)")
    spans = {p: (None, None, 0, total) for p in sorted(set(places)) if 0 <= p < total}  # open bounds, values up to the lower one, values between
    found: dict[int, float] = {}
    between = lambda lo, hi: (F.lit(True) if lo is None else x > lo) & (F.lit(True) if hi is None else x < hi)
    while spans:
        few = {p: s for p, s in spans.items() if s[3] <= FEW}
        for p, (lo, hi, below, _) in few.items():
            at = below
            for value, n in sorted(map(tuple, rows.filter(between(lo, hi)).groupBy("x").agg(F.count("*").alias("n")).collect())):  # FEW at most
                if at <= p < at + n:
                    found[p] = value
                at += n
            del spans[p]
        if not spans:
            break
        near = lambda p, s: [min(1.0, max(0.0, (p - s[2] + d) / s[3])) for d in (-2 * s[3] / ACCURACY, 1 + 2 * s[3] / ACCURACY)]
        sketched = rows.agg(*[F.percentile_approx(F.when(between(s[0], s[1]), x), near(p, s), ACCURACY).alias(f"q{p}") for p, s in spans.items()]).first()
        told = {p: sketched[f"q{p}"] for p in spans}
        counts = rows.agg(*[F.count(F.when(c, 1)).alias(f"{n}{k}_{p}") for p, q in told.items() for k in (0, 1) for n, c in (("lt", x < q[k]), ("le", x <= q[k]))]).first()
        for p, q in told.items():
            (lo, hi, below, n), (lt0, le0, lt1, le1) = spans[p], [counts[f"{c}{k}_{p}"] for k in (0, 1) for c in ("lt", "le")]
            if lt0 <= p < le0 or lt1 <= p < le1:
                found[p] = q[0] if lt0 <= p < le0 else q[1]
                del spans[p]
            elif p < lt0:
                spans[p] = (lo, q[0], below, lt0 - below)
            elif p < lt1:
                spans[p] = (q[0], q[1], le0, lt1 - le0)
            else:
                spans[p] = (q[1], hi, le1, below + n - le1)
    return found


def percentiles(values: DataFrame, column: str, points: tuple[float, ...] = (50.0, 95.0, 99.0)) -> DataFrame:
    """point and value: element floor(point / 100 * n), or the last, of the sorted values, exactly; 0.0 of none. Nulls and NaN aren't values."""
    n = values.filter(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).count()
    places = {p: min(int(p / 100 * n), n - 1) for p in points}
    found = elements_at(values, column, list(places.values()), n)
    return values.sparkSession.createDataFrame([(float(p), float(found.get(k, 0.0))) for p, k in places.items()], "point double, value double")


def quantiles(values: DataFrame, column: str, fractions: tuple[float, ...]) -> dict[float, float | None]:
    """Of each fraction the value at that part of the way from the first to the last sorted value, between two of them in proportion."""
    n = values.filter(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).count()
    at = {f: f * (n - 1) for f in fractions}
    found = elements_at(values, column, [k for a in at.values() for k in (int(a), min(int(a) + 1, n - 1))], n) if n else {}
    return {f: None if n == 0 else found[int(a)] if a == int(a) else (int(a) + 1 - a) * found[int(a)] + (a - int(a)) * found[int(a) + 1] for f, a in at.items()}


def causal_order(events: DataFrame) -> DataFrame:
    """Of each phishing step after the first: whether the step before it came earlier for the same person. Of equal times neither is earlier."""
    w = Window.partitionBy("employee_id").orderBy(F.unix_micros("occurred_at")).rangeBetween(Window.unboundedPreceding, -1)
    at = lambda s: F.max(F.when(F.col("signal") == s, F.col("occurred_at"))).over(w)
    steps = events.filter(F.col("signal").isin("phish_sim_delivered", "phish_sim_clicked", "phish_credentials_submitted"))
    rows = steps.withColumns({"delivered": at("phish_sim_delivered"), "clicked": at("phish_sim_clicked")})
    fine = F.when(F.col("signal") == "phish_sim_clicked", F.col("delivered").isNotNull()).when(F.col("signal") == "phish_credentials_submitted", F.col("clicked").isNotNull())
    return rows.filter(F.col("signal") != "phish_sim_delivered").select("employee_id", "event_id", "signal", fine.alias("in_order"))


def band_histogram(scores: DataFrame) -> DataFrame:
    """band, ordinal, n for all bands, those without people too."""
    bands = scores.sparkSession.createDataFrame([(i, b) for i, (b, _) in enumerate(BANDS)], "ordinal int, band string")
    return bands.join(F.broadcast(scores.groupBy("band").agg(F.count("*").alias("n"))), "band", "left").select("ordinal", "band", F.coalesce("n", F.lit(0)).alias("n"))  # five rows


def scored_outcomes(events: DataFrame, people: DataFrame) -> DataFrame:
    """Adds outcome: malformed (no signal or time), unknown_employee, else scored."""
    known = people.select("employee_id", F.lit(True).alias("_known"))
    outcome = F.when(F.col("signal").isNull() | F.col("occurred_at").isNull(), "malformed").when(F.col("_known").isNull(), "unknown_employee").otherwise("scored")
    return events.join(known, "employee_id", "left").withColumn("outcome", outcome).drop("_known")
