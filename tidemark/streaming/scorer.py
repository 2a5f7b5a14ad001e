"""The scorer as a streaming query: people's events in keyed state, summed where they are held; then scores and band changes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.catalog import SIGNALS
from ..functions.scoring import DAY_US, HIGH_VALUE, LOOKBACK_DAYS, band_of, score_of
from ..operators.normalize import EMITTED, SCHEMA_VERSION
from ..operators.replay import scored_outcomes, with_latencies, with_ordinal
from ..operators.score import WINDOW_EVENTS, with_attribution
from .normalizer import normalize_stream

_SUMS = """employee_id string, event_id string, seq long, turn long, occurred_us long, ingested_us long, as_of_us long, high_value boolean, raw double, considered long, truncated long,
    ordinals array<int>, occurrences array<bigint>, raws array<double>"""
_SCORES = "employee_id string, event_id string, seq long, occurred_at timestamp, ingested_at timestamp, as_of timestamp, score double, band string, events_considered int, truncated int"
_BANDED = f"{_SCORES}, turn long, previous_band string, band_changed boolean"
#: Provider of state stores that can hold maps by key.
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: New events of a person that are scored at once: so many rows of the largest window make the largest array.
AT_ONCE = 256
#: New events times events of a person from which on the person is scored alone, in portions; and pairs of events that are summed at once.
BUSY, PAIRS = 1 << 18, 1 << 18
#: Buckets of people, each with one list of state: a batch costs a few calls a bucket, not a person, and reads the buckets it touches. Fixed by a query's first run.
BUCKETS = 1024
_HELD = "employee_id string, event_id string, signal_ordinal int, at_us long, written_ms long"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("employee_id"), F.lit(buckets)).cast("int").alias("bucket")


def parsed(messages: DataFrame) -> DataFrame:
    """Events of the normalizer's messages (value: JSON): event_id, employee_id, signal, occurred_at, ingested_at.

    What can't be scored, such as a message of a later version that was forwarded as it came, has a null signal, which
    outcomes() counts as malformed. Messages without a value are skipped.
    """
    e = F.from_json(F.col("value").cast("string"), "event_id string, schema_version int, employee_id string, signal string, occurred_at timestamp, ingested_at timestamp")
    rows = messages.filter("value is not null").withColumn("_e", e)
    fine = F.col("_e.event_id").isNotNull() & F.col("_e.signal").isin([s[0] for s in SIGNALS]) & (F.coalesce("_e.schema_version", F.lit(SCHEMA_VERSION)) >= 0)
    kept = [c for c in messages.columns if c not in ("key", "value", "event_id")]
    return rows.select(*kept, "_e.event_id", "_e.employee_id", F.when(fine, F.col("_e.signal")).alias("signal"), "_e.occurred_at", "_e.ingested_at")


def outcomes(events: DataFrame, people: DataFrame) -> DataFrame:
    """Events with outcome scored, malformed or unknown_employee, in a stream as in a batch: those that aren't scored can be counted and kept."""
    return scored_outcomes(events, people)


def window_sums(held: dict, new: pd.DataFrame, high_value: bool, lookback_us: int, most: int, attributed: bool = True):
    """Scores new events, in order of arrival, on all events before them and themselves; adds them to held, (event_id, signal) to time.

    Yields for AT_ONCE of them: raw sums, events considered, events beyond the `most` latest, and with attributed sums and
    counts by signal. An event counts if it is at most lookback_us older than the time of the score; of more than `most`
    the latest count, of equal times by event id. After each portion held keeps the `most` latest: what is cut can't be
    among them again. So a portion costs its size times the window's at most, and a batch grows with its events.
    """
    weights, half_lives = (np.array([s[k] for s in SIGNALS]) for k in (2, 3))
    if high_value:
        weights = np.where(weights > 0, weights * HIGH_VALUE, weights)
    keys, times = list(held), list(held.values())
    since = [-1] * len(keys)
    ids, signals, at, as_of = (new[c].tolist() for c in ("event_id", "signal_ordinal", "occurred_us", "as_of_us"))
    for low in range(0, len(ids), AT_ONCE):
        rows = range(low, min(low + AT_ONCE, len(ids)))
        for n in rows:
            key = (ids[n], signals[n])
            if key not in held:
                held[key] = at[n]
                keys.append(key)
                times.append(at[n])
                since.append(n)
        order = sorted(range(len(keys)), key=lambda k: (times[k], keys[k]), reverse=True)
        keys, times, since = ([x[k] for k in order] for x in (keys, times, since))
        t, arrived, signal = np.array(times, dtype=np.int64), np.array(since), np.array([k[1] for k in keys])
        now = np.array(as_of[low : rows.stop], dtype=np.int64)[:, None]
        seen = (arrived[None, :] <= np.arange(low, rows.stop)[:, None]) & (t[None, :] >= now - lookback_us)
        inside = seen & (np.cumsum(seen, axis=1) <= most) if len(keys) > most else seen
        terms = np.where(inside, weights[signal] * np.exp2(-np.maximum(now - t[None, :], 0) / float(DAY_US) / half_lives[signal]), 0.0)
        told = [terms.sum(axis=1), inside.sum(axis=1), seen.sum(axis=1) - inside.sum(axis=1)]
        if attributed:
            of = np.eye(len(SIGNALS))[signal]
            told += [terms @ of, (inside.astype(float) @ of).astype(np.int64)]
        yield told
        for k in keys[most:]:
            del held[k]
        keys, times, since = keys[:most], times[:most], since[:most]


def few_sums(events: pd.DataFrame, new: pd.DataFrame, lookback_us: int, attributed: bool):
    """window_sums for many people at once who have few events each, all by array: the same sums, without a limit of events.

    events: person, signal_ordinal, at_us, turn (-1: there before) of distinct events, sorted by person; new: person, turn,
    as_of_us, high_value. Each new event meets its person's events, PAIRS pairs at a time.
    """
    weights, half_lives = (np.array([s[k] for s in SIGNALS], dtype=float) for k in (2, 3))
    counts = np.bincount(events["person"], minlength=int(new["person"].max()) + 1)
    starts = np.cumsum(counts) - counts
    signals, times, turns = (events[c].to_numpy() for c in ("signal_ordinal", "at_us", "turn"))
    person, turn, now, high = (new[c].to_numpy() for c in ("person", "turn", "as_of_us", "high_value"))
    ends = np.cumsum(counts[person])
    cuts = [0, *(np.flatnonzero(np.diff(ends // PAIRS)) + 1).tolist(), len(new)]
    told = []
    for low, high_end in zip(cuts[:-1], cuts[1:], strict=True):
        some = slice(low, high_end)
        n, size = counts[person[some]], high_end - low
        i = np.repeat(np.arange(size), n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[person[some]], n)
        at, signal = now[some][i], signals[j]
        inside = (turns[j] <= turn[some][i]) & (times[j] >= at - lookback_us)
        i, j, at, signal = i[inside], j[inside], at[inside], signal[inside]
        weight = weights[signal]
        weight = np.where((weight > 0) & high[some][i], weight * HIGH_VALUE, weight)
        terms = weight * np.exp2(-np.maximum(at - times[j], 0) / float(DAY_US) / half_lives[signal])
        part = [np.bincount(i, terms, size), np.bincount(i, minlength=size), np.zeros(size, dtype=np.int64)]
        if attributed:
            of, shape = i * len(SIGNALS) + signal, (size, len(SIGNALS))
            part += [np.bincount(of, terms, size * len(SIGNALS)).reshape(shape), np.bincount(of, minlength=size * len(SIGNALS)).reshape(shape)]
        told.append(part)
    return [np.concatenate(x) for x in zip(*told, strict=True)]


def _codes(*columns: pd.Series) -> np.ndarray:
    """Numbers of rows, equal where all columns are."""
    first, *rest = (pd.factorize(c, use_na_sentinel=False)[0].astype(np.int64) for c in columns)
    for c in rest:
        first = first * (c.max() + 1) + c
    return first


class _Window(StatefulProcessor):
    """The events of a bucket of people, a row each in a list: read once a batch, which appends the new ones; each expires by itself.

    A row that has become too old, or isn't among its person's `most` latest, stays until half of the list is such rows.
    """

    def __init__(self, lookback_days: int, most: int, expire: bool, attributed: bool):
        self.lookback, self.most, self.expire, self.attributed = lookback_days * DAY_US, most, expire, attributed

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = {"ttlDurationMs": 2 * self.lookback // 1000} if self.expire else {}
        self.events = handle.getListState("events", _HELD, **ttl)

    def _told(self, some: pd.DataFrame, told: list) -> pd.DataFrame:
        out = some[["employee_id", "event_id", "seq", "turn", "occurred_us", "ingested_us", "as_of_us", "high_value"]].assign(raw=told[0], considered=told[1], truncated=told[2])
        if not self.attributed:
            return out.assign(ordinals=None, occurrences=None, raws=None)
        row, signal = np.nonzero(told[4])
        at = np.cumsum(np.bincount(row, minlength=len(some)))[:-1]
        return out.assign(ordinals=np.split(signal.astype(np.int32), at), occurrences=np.split(told[4][row, signal], at), raws=np.split(told[3][row, signal], at))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        written = timerValues.getCurrentProcessingTimeInMs() if self.expire else 0
        new = pd.concat(list(rows)).sort_values(["employee_id", "arrival_us", "seq"], kind="stable").reset_index(drop=True)
        held = pd.DataFrame(list(self.events.get()), columns=_names(_HELD))
        size = len(held)
        if self.expire:  # rows that were written again would start anew
            held = held[held["written_ms"] >= written - 2 * self.lookback // 1000]
        both = pd.concat([held["employee_id"], new["employee_id"]], ignore_index=True)
        person, names = pd.factorize(both)
        new["person"], held = person[len(held) :], held.assign(person=person[: len(held)], turn=-1)
        new["turn"] = new.groupby("person").cumcount()
        new["high_value"] = new.groupby("person")["is_high_value"].transform("first").astype(bool)
        held = self._latest(held)
        come = new.rename(columns={"occurred_us": "at_us"}).assign(written_ms=written)[held.columns]
        events = pd.concat([held, come], ignore_index=True) if len(held) else come
        events = events[~pd.Series(_codes(events["person"], events["event_id"], events["signal_ordinal"])).duplicated().to_numpy()]
        events = events.sort_values("person", kind="stable").reset_index(drop=True)

        n_events, n_new = (np.bincount(x["person"], minlength=len(names)) for x in (events, new))
        busy = (n_events > self.most) | (n_events * n_new > BUSY)
        few = new[~busy[new["person"]]]
        if len(few):
            yield self._told(few, few_sums(events[~busy[events["person"]]] if busy.any() else events, few, self.lookback, self.attributed))
        for p in np.flatnonzero(busy & (n_new > 0)).tolist():
            mine, before, low = new[new["person"] == p], held[held["person"] == p], 0
            window = dict(zip(zip(before["event_id"], before["signal_ordinal"].tolist(), strict=True), before["at_us"].tolist(), strict=True))
            for told in window_sums(window, mine, bool(mine["high_value"].iloc[0]), self.lookback, self.most, self.attributed):
                yield self._told(mine.iloc[low : low + len(told[0])], told)
                low += len(told[0])

        now = new.groupby("person")["as_of_us"].max().reindex(range(len(names))).to_numpy(dtype=float)
        kept = self._latest(events[~(events["at_us"] < now[events["person"]] - self.lookback)])
        come = kept[kept["turn"] >= 0]
        if size > 2 * (len(kept) - len(come)):
            self.events.put(_rows(kept)) if len(kept) else self.events.clear()
        elif len(come):
            self.events.appendList(_rows(come))

    def _latest(self, events: pd.DataFrame) -> pd.DataFrame:
        """Without what isn't among its person's `most` latest; of equal times by event id and signal."""
        if not len(events) or np.bincount(events["person"]).max() <= self.most:
            return events
        ranked = events.sort_values(["at_us", "event_id", "signal_ordinal"], ascending=False, kind="stable")
        return events.loc[ranked.index[ranked.groupby("person").cumcount() < self.most].sort_values()]

    def close(self) -> None:
        pass


def _rows(held: pd.DataFrame) -> list[tuple]:
    return list(zip(*(held[c].tolist() for c in _names(_HELD)), strict=True))


class _Band(StatefulProcessor):
    """Adds the band before, from a list of a bucket's people; a person's first score changes nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bands = handle.getListState("bands", "employee_id string, band string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values(["employee_id", "turn"], kind="stable").reset_index(drop=True)
        before = [tuple(r) for r in self.bands.get()]
        last = dict(before)  # of rows of one person the later
        previous = rows.groupby("employee_id")["band"].shift().astype(object)
        first = ~rows["employee_id"].duplicated()
        previous[first] = rows["employee_id"][first].map(last)
        previous = previous.where(previous.notna(), None)
        ends = rows.drop_duplicates("employee_id", keep="last")
        now = [(e, b) for e, b in zip(ends["employee_id"], ends["band"], strict=True) if last.get(e) != b]
        last.update(now)
        if len(before) + len(now) > 2 * len(last):
            self.bands.put(list(last.items()))
        elif now:
            self.bands.appendList(now)
        yield rows.assign(previous_band=previous, band_changed=previous.notna() & (previous != rows["band"]))[_names(_BANDED)]

    def close(self) -> None:
        pass


def score_stream(events: DataFrame, people: DataFrame, as_of: str | None = None, arrival: str = "ingested_at", lookback_days: int = LOOKBACK_DAYS, most: int = WINDOW_EVENTS, expire: bool = True, attributed: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """One score for each event of a known person, on all events so far; attributed adds dominant_category, by_category and top_factors.

    events: event_id, employee_id, signal, occurred_at, ingested_at, seq. as_of names a column to score at; without it,
    the time of the micro-batch. No watermark: an event is never dropped for being late, only too old for the window.
    Events without a signal or of unknown people aren't scored; outcomes() tells them. A signal without a price is an error.
    An event that comes again changes nothing, but is scored again. turn is the place in a person's batch.
    expire: each event leaves the state after twice the lookback. A query that expires state by the clock always has
    another batch to run, so that a bounded run (availableNow) goes without. people is a static table;
    lake.snapshot gives one that can be refreshed between batches.
    """
    now = F.col(as_of) if as_of else F.current_timestamp()
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    rows = with_ordinal(events.filter("signal is not null and occurred_at is not null").join(people.select("employee_id", "is_high_value"), "employee_id"))
    us = F.unix_micros
    rows = rows.select(_bucket(buckets), "employee_id", "event_id", "seq", "signal_ordinal", F.coalesce("is_high_value", F.lit(False)).alias("is_high_value"), us("occurred_at").alias("occurred_us"), us("ingested_at").alias("ingested_us"), us(now).alias("as_of_us"), us(F.col(arrival)).alias("arrival_us"))
    sums = rows.groupBy("bucket").transformWithStateInPandas(_Window(lookback_days, most, expire, attributed), _SUMS, "append", "processingTime" if expire else "none")
    at = F.timestamp_micros
    scored = sums.withColumns({"score": score_of(F.col("raw")), "occurred_at": at("occurred_us"), "ingested_at": at("ingested_us"), "as_of": at("as_of_us"), "events_considered": F.col("considered").cast("int"), "truncated": F.col("truncated").cast("int")})
    scored = scored.withColumn("band", band_of(F.col("score")))
    if attributed:
        parts = F.transform(F.arrays_zip("ordinals", "occurrences", "raws"), lambda p: F.struct(p["ordinals"].alias("signal_ordinal"), p["occurrences"].alias("occurrences"), p["raws"].alias("raw")))
        scored = with_attribution(scored.withColumn("parts", parts))
    return scored.select(*_names(_SCORES), "turn", *(["dominant_category", "by_category", "top_factors"] if attributed else []))


def band_stream(scores: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Scores with previous_band, band_changed and latencies, by state after the scorer's in the same query, or over a table of scores."""
    scores.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    banded = scores.select(_bucket(buckets), *_names(_SCORES), "turn").groupBy("bucket").transformWithStateInPandas(_Band(), _BANDED, "append", "none")
    return with_latencies(banded, F.col("as_of"))


def banded_messages(messages: DataFrame, people: DataFrame, as_of: str | None = None, expire: bool = True) -> DataFrame:
    """One query from raw messages to scores with bands: duplicates dropped, windows and last bands kept in three states one after another."""
    sent = normalize_stream(messages, "offset").filter(F.col("outcome") == EMITTED).select(F.col("out_value").alias("value"), F.col("offset").alias("seq"), "timestamp")
    return band_stream(score_stream(parsed(sent), people, as_of=as_of, arrival="timestamp", expire=expire))


def run(rows: DataFrame, folder: str, checkpoint: str) -> None:
    """Takes what is there and stops; rows go to a folder as Parquet."""
    rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
