"""Incident patterns, found per person in event-time order, and the gate before an intervention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MINUTE_US = 60_000_000
# Pattern, its last signal, the signals before it (least number of each), and minutes that it may take.
PATTERNS = [
    ("phish_credential_chain", "phish_credentials_submitted", {"phish_sim_delivered": 1, "phish_sim_clicked": 1}, 10),
    ("mfa_fatigue", "mfa_push_flood", {"mfa_push_denied": 6}, 10),
    ("data_exfil", "usb_mass_storage_mounted", {"bulk_download_detected": 1, "file_shared_public_link": 1}, 30),
    ("account_takeover", "oauth_grant_risky_scope", {"impossible_travel_login": 1, "email_forwarding_rule_created": 1}, 30),
]


def detect(events: DataFrame, scale: int = 1) -> DataFrame:
    """pattern, employee_id, event_id and occurred_at of each event that completes a pattern. scale multiplies the minutes allowed.

    One range window for each pattern's length, all over the same partitioning and order, so there is one shuffle and sort.
    """
    by_time = Window.partitionBy("employee_id").orderBy(F.unix_micros("occurred_at"))
    hits = []
    for name, last, needed, minutes in PATTERNS:
        w = by_time.rangeBetween(-minutes * scale * MINUTE_US, 0)
        fine = F.col("signal") == last
        for signal, n in needed.items():
            fine = fine & (F.count(F.when(F.col("signal") == signal, 1)).over(w) >= n)
        hits.append(F.when(fine, F.lit(name)))
    rows = events.select("employee_id", "event_id", "seq", "occurred_at", "signal").withColumn("patterns", F.array_compact(F.array(*hits)))
    return rows.select(F.explode("patterns").alias("pattern"), "employee_id", "event_id", "seq", "occurred_at")


def gate(candidates: DataFrame, cooldown_hours: int = 72, per_week: int = 2) -> DataFrame:
    """candidates (employee_id, kind, at, seq) with decision: sent, escalated (the second time of a kind and later), cooldown or weekly_cap.

    What is sent depends on what was sent before, so each person's candidates are walked in time order, batch by batch:
    a task holds one batch and the last few times that something was sent, however many candidates a person has.
    """
    import pandas as pd

    cooldown, week = pd.Timedelta(hours=cooldown_hours), pd.Timedelta(days=7)

    def walk(batches):
        person, last, recent = None, {}, []
        for rows in batches:
            decisions = []
            for who, kind, at in zip(rows["employee_id"], rows["kind"], rows["at"], strict=True):
                if who != person:
                    person, last, recent = who, {}, []
                recent = [t for t in recent if at - t < week]
                if kind in last and at - last[kind] < cooldown:
                    decisions.append("cooldown")
                elif len(recent) >= per_week:
                    decisions.append("weekly_cap")
                else:
                    decisions.append("escalated" if kind in last else "sent")
                    last[kind] = at
                    recent.append(at)
            yield rows.assign(decision=decisions)

    rows = candidates.select("employee_id", "kind", "at", "seq").repartition("employee_id").sortWithinPartitions("employee_id", "at", "seq")
    return rows.mapInPandas(walk, "employee_id string, kind string, at timestamp, seq long, decision string")
