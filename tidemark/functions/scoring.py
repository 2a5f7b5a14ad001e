"""Column functions of the score. Batch and stream both use these, so that they can't drift apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .catalog import BANDS

HIGH_VALUE, SATURATION, LOOKBACK_DAYS = 1.4, 30.0, 30
DAY_US = 86_400_000_000
NAMESPACE = "6f9619ff8b86d011b42d00c04fc964ff"


def age_days(as_of: Column, occurred_at: Column) -> Column:
    """Fractional days; negative for events from the future."""
    return (F.unix_micros(as_of) - F.unix_micros(occurred_at)) / F.lit(float(DAY_US))


def decay(age: Column, half_life_days: Column) -> Column:
    return F.when(age <= 0, F.lit(1.0)).otherwise(F.pow(F.lit(0.5), age / half_life_days))


def contribution(weight: Column, half_life_days: Column, age: Column, high_value: Column) -> Column:
    """What one event adds: its faded weight, more for a high-value target, but only where it adds risk."""
    term = weight * decay(age, half_life_days)
    return F.when((term > 0) & high_value, term * HIGH_VALUE).otherwise(term)


def normalized(raw: Column) -> Column:
    """From 0 to 100, saturating; no negative risk."""
    return F.when(raw <= 0, F.lit(0.0)).otherwise((F.lit(1.0) - F.exp(-raw / SATURATION)) * 100.0)


def score_of(raw: Column) -> Column:
    return F.round(normalized(raw), 2)


def band_of(score: Column) -> Column:
    """The band of the rounded score."""
    return reduce(lambda rest, b: F.when(score >= b[1], F.lit(b[0])).otherwise(rest), reversed(BANDS[:-1]), F.lit(BANDS[-1][0]))


def is_high_value(executive: Column, finance: Column, admin: Column) -> Column:
    return F.coalesce(executive, F.lit(False)) | F.coalesce(finance, F.lit(False)) | F.coalesce(admin, F.lit(False))


def lateness_seconds(ingested_at: Column, occurred_at: Column) -> Column:
    return (F.unix_micros(ingested_at) - F.unix_micros(occurred_at)) / F.lit(1e6)


def latency_ms(now: Column, since: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(since)) / F.lit(1e3)


def email_key(email: Column) -> Column:
    return F.lower(F.trim(email))


def event_id(source: Column, source_event_id: Column) -> Column:
    """The version-5 UUID of "source:source_event_id": redelivery of a record gives the same id."""
    name = F.concat(source, F.lit(":"), source_event_id).cast("binary")
    digest = F.substring(F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), name)), 1, 32)
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex((nibble.bitwiseAND(3)).bitwiseOR(F.lit(8)).cast("long")))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def zoned_timestamp(text: Column) -> Column:
    """The instant of an ISO time that names its zone, else null; a bare number is seconds since the epoch, or milliseconds from 2e10 on."""
    zoned = F.when(text.rlike(r"^\d.*([Zz]|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text))
    number = F.when(text.rlike(r"^-?\d{1,15}(\.\d+)?([eE][+]?\d{1,2})?$"), text.cast("double"))
    seconds = F.when(F.abs(number) > 2e10, number / 1e3).otherwise(number)
    return F.when(number.isNotNull(), F.when(F.abs(seconds) < 253_402_300_800, F.timestamp_micros(F.round(seconds * 1e6).cast("long")))).otherwise(zoned)
