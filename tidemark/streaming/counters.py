"""Counters of a running stream: what each batch observed, added up by a listener. Nothing is computed a second time."""

from __future__ import annotations

import threading
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def counted(rows: DataFrame, name: str, by: Column, values: Sequence[str], **more: Column) -> DataFrame:
    """Rows as they are; along the way each batch counts them all, and those of each value of `by`, and more conditions."""
    return rows.observe(name, F.count(F.lit(1)).alias("total"), *[F.count(F.when(by == v, 1)).alias(v) for v in values], *[F.count(F.when(c, 1)).alias(n) for n, c in more.items()])


class Totals(StreamingQueryListener):
    """Sums of what finished batches observed, by name; a batch that failed counts when it is repeated, once."""

    def __init__(self) -> None:
        self.sums: dict[str, Counter] = defaultdict(Counter)
        self.rows: Counter = Counter()
        self._ended: set[str] = set()
        self._changed = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self._changed:
            self.rows[str(event.progress.runId)] += max(0, event.progress.numInputRows)
            for name, row in event.progress.observedMetrics.items():
                self.sums[name].update({k: v or 0 for k, v in row.asDict().items()})
            self._changed.notify_all()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._changed:
            self._ended.add(str(event.runId))
            self._changed.notify_all()

    def after(self, query: StreamingQuery, seconds: float = 60.0) -> Totals:
        """Waits until the listener has heard the end of a query, which comes after all of its batches."""
        with self._changed:
            if not self._changed.wait_for(lambda: str(query.runId) in self._ended, seconds):
                raise TimeoutError(f"no end of query {query.runId} heard in {seconds} s")
        return self


@contextmanager
def following(spark: SparkSession) -> Iterator[Totals]:
    totals = Totals()
    spark.streams.addListener(totals)
    try:
        yield totals
    finally:
        spark.streams.removeListener(totals)
