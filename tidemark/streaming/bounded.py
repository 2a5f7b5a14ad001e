"""Runs that stop: after so many messages, or when nothing has come for a while. The next run on the same checkpoint goes on from there."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame


class _Enough(Exception):
    """Ends a query before a batch that isn't wanted any more; the batch stays uncommitted and is the next run's first."""


def run_bounded(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, most: int | None = None, idle_seconds: float | None = 5.0) -> int:
    """Messages taken in by this run. Give the source an admission limit (messages or files a batch): `most` is looked at between batches.

    The run stops with the batch that reaches `most`, or when no message has come for idle_seconds (None: then only by
    `most`). What has been counted is what finished batches read, told by the query's own progress; the sink must bear a
    repeated batch.
    """
    if most is None and idle_seconds is None:
        raise ValueError("a bounded run needs most or idle_seconds")
    taken, seen, full, started = [0], [-1], threading.Event(), threading.Event()
    holder: list = []

    def add_up() -> None:
        for p in holder[0].recentProgress:
            if p["batchId"] > seen[0] and p["numInputRows"] > 0:
                seen[0] = p["batchId"]
                taken[0] += p["numInputRows"]

    def write(batch: DataFrame, batch_id: int) -> None:
        started.wait()
        add_up()  # the batches before this one have ended, so their progress is there
        if most is not None and taken[0] >= most:
            full.set()
            raise _Enough
        sink(batch, batch_id)

    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
    holder.append(query)
    started.set()
    last, since = 0, None  # since: when the source was first found empty, after the last message
    try:
        while not query.awaitTermination(0.2):
            status = query.status
            add_up()
            if most is not None and taken[0] >= most and not status["isDataAvailable"] and not status["isTriggerActive"]:
                break  # the limit is reached and no batch is under way
            if taken[0] != last or status["isDataAvailable"]:
                last, since = taken[0], None
            elif since is None:
                # a trigger that only looks for messages is active too, so that it doesn't start the time anew
                since = time.monotonic() if status["message"] == "Waiting for data to arrive" else None
            elif idle_seconds is not None and time.monotonic() - since > idle_seconds:
                break
    except StreamingQueryException:
        if not full.is_set():
            raise
    finally:
        query.stop()
    add_up()
    return taken[0]
