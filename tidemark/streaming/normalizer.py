"""The normalizer as a streaming query: the decisions of operators.normalize, with duplicates dropped by event id."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.normalize import DEAD, DUPLICATE, EMITTED, FORWARDED, decide, decoded, routed, validated
from ..sources.lake import batch_folder, fan_out
from .counters import counted

#: How long after its first message an event id is remembered, by arrival time.
REMEMBERED = "7 days"
#: Buckets of ids, each with one list of state: a batch costs a few calls a bucket, not an id, and reads the buckets it touches.
BUCKETS = 1024
_TAGGED = ["key", "value", "topic", "partition", "offset", "timestamp"]


def normalize_stream(messages: DataFrame, *kept: str) -> DataFrame:
    """outcome, out_key, out_value, reason of each message but duplicates, which the state operator counts as numDroppedDuplicateRows.

    The watermark is on arrival time, never on event time: late events aren't dropped for being late. Messages that can't
    be placed don't touch the state.
    """
    rows = decoded(messages.withWatermark("timestamp", REMEMBERED))
    placed = rows.filter("routed_reason is null").dropDuplicatesWithinWatermark(["_event_id"])
    out = decide(validated(placed.unionByName(rows.filter("routed_reason is not null"))), F.lit(False))
    return out.select("timestamp", F.col("_event_id").alias("event_id"), "outcome", "out_key", "out_value", "reason", "value", *kept)


class _Seen(StatefulProcessor):
    """When each id of a bucket was first seen: messages of the next `remembered` seconds are duplicates and don't prolong it; then the id is new again.

    A list of ids and times, of which the later counts: read once a batch, which appends what is new.
    """

    def __init__(self, remembered: float, expire: bool):
        self.us, self.expire = int(remembered * 1e6), expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = {"ttlDurationMs": self.us // 1000} if self.expire else {}
        self.seen = handle.getListState("seen", "event_id string, at_us long", **ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values(["timestamp", "partition", "offset"], kind="stable")
        before = [tuple(r) for r in self.seen.get()]
        first, new, duplicate = dict(before), {}, []
        for i, at in zip(rows["event_id"].tolist(), rows["arrival_us"].tolist(), strict=True):
            since = first.get(i)
            duplicate.append(since is not None and at < since + self.us)
            if not duplicate[-1]:
                first[i] = new[i] = at
        if len(before) + len(new) > 2 * len(first):
            self.seen.put(list(first.items()))
        elif new:
            self.seen.appendList(list(new.items()))
        yield rows[_TAGGED].assign(duplicate=duplicate)

    def close(self) -> None:
        pass


def tagged_stream(messages: DataFrame, remembered_days: float = 7, expire: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """normalize_stream with duplicates among the rows, each with its outcome. An id that comes again later than remembered_days after its first message is new.

    Arrival times decide; with expire the state is also cleared by the clock (such a query always has another batch to
    run, so that a bounded run goes without). A bucket's messages of one batch meet in one task: the source's admission
    limit bounds them. buckets stays as in the query's first run; where many ids are remembered, more of them keep what a
    small batch reads small.
    """
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = routed(messages)
    bucket = F.pmod(F.xxhash64("_event_id"), F.lit(buckets)).cast("int").alias("bucket")
    placed = rows.filter("routed_reason is null").select(bucket, F.col("_event_id").alias("event_id"), *_TAGGED, F.unix_micros("timestamp").alias("arrival_us"))
    schema = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp, duplicate boolean"
    told = placed.groupBy("bucket").transformWithStateInPandas(_Seen(remembered_days * 86_400, expire), schema, "append", "processingTime" if expire else "none")
    told = told.unionByName(rows.filter("routed_reason is not null").select(*_TAGGED, F.lit(False).alias("duplicate")))
    return decide(validated(decoded(told)), F.col("duplicate")).select("partition", "offset", "timestamp", F.col("_event_id").alias("event_id"), "outcome", "out_key", "out_value", "reason", "value")


def with_counters(decisions: DataFrame, name: str = "normalizer") -> DataFrame:
    return counted(decisions, name, F.col("outcome"), (EMITTED, DUPLICATE, FORWARDED, DEAD))


def sinks(emitted: str, dead: str):
    """For foreachBatch: emitted and forwarded messages go to one folder, dead letters to another. A batch that is repeated overwrites what it wrote before."""
    key = F.col("out_key").alias("key")
    to_emitted, to_dead = batch_folder(emitted), batch_folder(dead)
    return fan_out(
        [
            lambda b, i: to_emitted(b.filter(~F.col("outcome").isin(DEAD, DUPLICATE)).select(key, F.col("out_value").alias("value"), "timestamp", "event_id", "outcome"), i),
            lambda b, i: to_dead(b.filter(F.col("outcome") == DEAD).select(key, "value", "reason", "timestamp"), i),
        ]
    )


def run(messages: DataFrame, emitted: str, dead: str, checkpoint: str) -> StreamingQuery:
    """Takes what is there and stops."""
    query = with_counters(normalize_stream(messages)).writeStream.foreachBatch(sinks(emitted, dead)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
