"""State by bucket: many people share a list, which a batch reads and writes with one call each, however many they are."""

import random

import pandas as pd
import pytest

from tidemark.streaming import normalizer, scorer

DAY = 86_400_000_000


class _List:
    def __init__(self):
        self.rows, self.calls = [], 0

    def get(self):
        self.calls += 1
        return iter(list(self.rows))

    def put(self, rows):
        self.calls, self.rows = self.calls + 1, list(rows)

    def appendList(self, rows):
        self.calls += 1
        self.rows += rows

    def clear(self):
        self.put([])


class _Handle:
    """Lists only: state by person would need another grouping key for each."""

    def __init__(self):
        self.state = _List()

    def getListState(self, name, schema, ttlDurationMs=None):
        return self.state


class _Clock:
    def __init__(self, day):
        self.day = day

    def getCurrentProcessingTimeInMs(self):
        return self.day * DAY // 1000


def _started(processor):
    handle = _Handle()
    processor.init(handle)
    return handle.state


def _events(rng, n, people, as_of):
    rows = []
    for seq in range(n):
        i = rng.randrange(4 * people)
        at = 360 * DAY + i * 37 % 80 * DAY // 2
        rows.append((f"P{i % people}", f"e{i}", seq, i % 23, i % people % 2 == 0, at, at, as_of, rng.randrange(n)))
    return pd.DataFrame(rows, columns="employee_id event_id seq signal_ordinal is_high_value occurred_us ingested_us as_of_us arrival_us".split())


@pytest.mark.parametrize(("most", "busy", "pairs"), [(5000, 1 << 18, 100), (5000, 0, 100), (3, 1 << 18, 1 << 18)])
def test_windows_of_many_people(monkeypatch, most, busy, pairs):
    """Repeated, late and too old events over several batches: as each person's own window says, in two calls a batch."""
    monkeypatch.setattr(scorer, "BUSY", busy)
    monkeypatch.setattr(scorer, "PAIRS", pairs)
    rng, windows = random.Random(most + busy), {}
    processor = scorer._Window(30, most, False, True)
    state = _started(processor)
    for batch in range(5):
        new = _events(rng, 400, 60, (390 + batch) * DAY)
        state.calls = 0
        told = pd.concat(list(processor.handleInputRows((0,), iter([new[:150], new[150:]]), None)))
        assert state.calls <= 2 and len(told) == len(new)
        for person, rows in new.sort_values(["arrival_us", "seq"]).groupby("employee_id"):
            held, found = windows.setdefault(person, {}), told[told["employee_id"] == person].sort_values("turn")
            assert found["turn"].tolist() == list(range(len(rows))) and found["event_id"].tolist() == rows["event_id"].tolist()
            parts = [x for part in scorer.window_sums(held, rows, bool(rows["is_high_value"].iloc[0]), 30 * DAY, most) for x in zip(*part, strict=True)]
            for r, (raw, n, cut, sums, counts) in zip(found.itertuples(), parts, strict=True):
                assert abs(r.raw - raw) < 1e-9 and (r.considered, r.truncated) == (n, cut)
                assert {s: (c, round(x, 9)) for s, c, x in zip(r.ordinals, r.occurrences, r.raws, strict=True)} == {s: (counts[s], round(sums[s], 9)) for s in counts.nonzero()[0]}
        assert len(state.rows) <= 2 * sum(map(len, windows.values())) + len(new)


def test_events_expire_in_a_list_that_is_written_again():
    """An event that stays in the list while others make it be rewritten goes after twice the lookback all the same."""
    row = lambda p, day, k: pd.DataFrame([(p, f"e{k}", k, 0, False, day * DAY, day * DAY, day * DAY, k)], columns="employee_id event_id seq signal_ordinal is_high_value occurred_us ingested_us as_of_us arrival_us".split())
    processor = scorer._Window(30, 5000, True, False)
    state = _started(processor)
    list(processor.handleInputRows((0,), iter([row("quiet", 100, 0)]), _Clock(100)))
    for k, day in enumerate(range(120, 320, 25), 1):
        list(processor.handleInputRows((0,), iter([row("other", day, k)]), _Clock(day)))
    assert "quiet" not in [r[0] for r in state.rows] and "other" in [r[0] for r in state.rows]


def test_bands_of_many_people():
    """Several scores of each person in a batch, over batches: bands follow one another, in two calls a batch."""
    rng, processor, last = random.Random(1), scorer._Band(), {}
    state = _started(processor)
    for batch in range(6):
        rows = pd.DataFrame([(f"P{rng.randrange(50)}", rng.choice(["low", "high", "critical"])) for _ in range(120)], columns=["employee_id", "band"])
        rows["turn"] = rows.groupby("employee_id").cumcount()
        rows = rows.reindex(columns=[*scorer._names(scorer._SCORES), "turn"])
        rows["seq"], state.calls = range(len(rows)), 0
        told = pd.concat(list(processor.handleInputRows((0,), iter([rows.sample(frac=1, random_state=batch)]), None))).sort_values("seq")
        assert state.calls <= 2 and len(told) == len(rows)
        for r in told.itertuples():
            before = last.get(r.employee_id)
            assert r.previous_band == before and r.band_changed == (before is not None and before != r.band)
            last[r.employee_id] = r.band
        assert dict(state.rows) == last and len(state.rows) <= 2 * len(last)


def test_ids_of_many_messages():
    """Ids that come again within and after a week, over batches: as a loop over messages says, in two calls a batch."""
    rng, processor, first = random.Random(2), normalizer._Seen(7 * 86_400, False), {}
    state = _started(processor)
    for batch in range(6):
        rows = pd.DataFrame([(f"e{rng.randrange(150)}", b"k", b"v", "t", k % 3, batch * 1000 + k, rng.randrange(batch * 3, batch * 3 + 4) * DAY) for k in range(200)], columns="event_id key value topic partition offset arrival_us".split())
        rows["timestamp"], state.calls = pd.to_datetime(rows["arrival_us"], unit="us"), 0
        told = pd.concat(list(processor.handleInputRows((0,), iter([rows[:90], rows[90:]]), None)))
        assert state.calls <= 2 and len(told) == len(rows)
        duplicate = dict(zip(told["offset"], told["duplicate"], strict=True))
        for r in rows.sort_values(["arrival_us", "partition", "offset"]).itertuples():
            again = r.event_id in first and r.arrival_us < first[r.event_id] + 7 * DAY
            assert duplicate[r.offset] == again
            if not again:
                first[r.event_id] = r.arrival_us
        assert dict(state.rows) == first and len(state.rows) <= 2 * len(first)
