"""Vendor records to behaviour events. A new source is one function here and one entry in PARSERS.

Each parser takes a DataFrame with payload (JSON text) and adds signal, occurred_at, subject_email, source_event_id,
attributes (JSON text) and drop_reason: malformed, unknown_event_type or null. Bad rows never stop a job.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import SIGNALS, signal_catalog
from ..functions.scoring import event_id, zoned_timestamp
from .identity import resolve

# The vendors' names for signals.
OKTA = {
    "user.authentication.auth_via_mfa": "mfa_push_denied",
    "system.push.send_factor_verify_push": "mfa_push_flood",
    "user.password.breach_detected": "password_reuse_detected",
    "policy.evaluate_sign_on": "impossible_travel_login",
    "group.user_membership.add": "admin_privilege_granted",
    "application.user_membership.stale": "stale_access_unreviewed",
}
WORKSPACE = {
    "change_user_access": "file_shared_externally",
    "change_document_visibility": "file_shared_public_link",
    "download": "bulk_download_detected",
    "authorize": "oauth_grant_risky_scope",
    "create_forwarding_rule": "email_forwarding_rule_created",
}
EMAIL = {
    "delivered": "phish_sim_delivered",
    "link_clicked": "phish_sim_clicked",
    "reported_by_user": "phish_sim_reported",
    "credentials_submitted": "phish_credentials_submitted",
    "reported_malicious": "real_phish_reported",
}
ENDPOINT = {"dlp.genai_paste": "sensitive_data_to_genai", "device.removable_mount": "usb_mass_storage_mounted"}


def _signal(name: Column, names: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in names.items()])


def _parsed(df: DataFrame, signal: Column, at: Column, who: Column, source_id: Column, attributes: Column, malformed: Column, irrelevant: Column) -> DataFrame:
    """An irrelevant record is told first, for it needs no further fields; without a time or an id a record is malformed."""
    broken = F.col("r").isNull() | malformed
    lacking = at.isNull() | source_id.isNull()
    reason = F.when(broken, "malformed").when(irrelevant | signal.isNull(), "unknown_event_type").when(lacking, "malformed")
    return df.select("*", signal.alias("signal"), at.alias("occurred_at"), who.alias("subject_email"), source_id.alias("source_event_id"), attributes.alias("attributes"), reason.alias("drop_reason")).drop("r")


def parse_okta(df: DataFrame) -> DataFrame:
    df = df.withColumn("r", F.from_json("payload", "uuid string, published string, eventType string, outcome struct<result: string>, actor struct<alternateId: string>, debugContext struct<debugData: map<string, string>>"))
    signal = _signal(F.col("r.eventType"), OKTA)
    denied = signal == "mfa_push_denied"
    no_outcome = F.coalesce(denied, F.lit(False)) & F.col("r.outcome.result").isNull()
    passed = F.coalesce(denied & (F.col("r.outcome.result") != "FAILURE"), F.lit(False))
    attributes = F.to_json(F.coalesce("r.debugContext.debugData", F.create_map().cast("map<string, string>")))
    return _parsed(df, signal, zoned_timestamp(F.col("r.published")), F.col("r.actor.alternateId"), F.col("r.uuid"), attributes, F.col("r.eventType").isNull() | no_outcome, passed)


def parse_google_workspace(df: DataFrame) -> DataFrame:
    """Of a record's activities the first counts. Parameters without a name are skipped; of equal names the last stays."""
    df = df.withColumn("r", F.from_json("payload", "id struct<time: string, uniqueQualifier: string>, actor struct<email: string>, events array<struct<name: string, parameters: array<struct<name: string, value: string>>>>"))
    first = F.get("r.events", F.lit(0))
    named = F.filter(F.coalesce(first["parameters"], F.array().cast("array<struct<name: string, value: string>>")), lambda p: p["name"].isNotNull())
    last = F.filter(named, lambda p, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda later: later["name"] == p["name"]))
    return _parsed(df, _signal(first["name"], WORKSPACE), zoned_timestamp(F.col("r.id.time")), F.col("r.actor.email"), F.col("r.id.uniqueQualifier"), F.to_json(F.map_from_entries(last)), F.lit(False), F.lit(False))


def parse_email_gateway(df: DataFrame) -> DataFrame:
    """Simulation signals count only where the campaign says that it is one; the time is in epoch seconds."""
    df = df.withColumn("r", F.from_json("payload", "event_id string, timestamp string, recipient string, action string, campaign struct<id: string, subject: string, simulated: boolean>"))
    signal = _signal(F.col("r.action"), EMAIL)
    real = signal.startswith("phish_") & ~F.coalesce("r.campaign.simulated", F.lit(False))
    at = F.timestamp_seconds(F.expr("try_cast(r.timestamp as bigint)"))
    attributes = F.to_json(F.struct(F.col("r.campaign.id").alias("campaign_id"), F.col("r.campaign.subject").alias("lure")), {"ignoreNullFields": "false"})
    return _parsed(df, signal, at, F.col("r.recipient"), F.col("r.event_id"), attributes, F.lit(False), F.coalesce(real, F.lit(False)))


def parse_endpoint_agent(df: DataFrame) -> DataFrame:
    """Only managed devices count."""
    df = df.withColumn("r", F.from_json("payload", "record_id string, observed_at string, user_principal string, telemetry_type string, device struct<id: string, managed: boolean>, details map<string, string>"))
    unmanaged = ~F.coalesce("r.device.managed", F.lit(False))
    attributes = F.to_json(F.coalesce("r.details", F.create_map().cast("map<string, string>")))
    return _parsed(df, _signal(F.col("r.telemetry_type"), ENDPOINT), zoned_timestamp(F.col("r.observed_at")), F.col("r.user_principal"), F.col("r.record_id"), attributes, F.lit(False), unmanaged)


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "okta": parse_okta,
    "google_workspace": parse_google_workspace,
    "email_gateway": parse_email_gateway,
    "endpoint_agent": parse_endpoint_agent,
}
VOCABULARY = {"okta": OKTA, "google_workspace": WORKSPACE, "email_gateway": EMAIL, "endpoint_agent": ENDPOINT}


def archive_reference(source: Column, at: Column, source_id: Column, prefix: str) -> Column:
    """Where the raw record lies, or with the prefix null:// where it would lie."""
    return F.concat(F.lit(prefix), F.lit("raw/source="), source, F.lit("/dt="), F.date_format(at, "yyyy-MM-dd"), F.lit("/"), F.regexp_replace(source_id, "/", "_"), F.lit(".json"))


def ingest(records: DataFrame, people: DataFrame, tenant: str, prefix: str = "null://") -> DataFrame:
    """Records (source, payload, other columns) of all vendors to events with a drop_reason: malformed, then unknown_event_type, then unresolved_identity, else null. Records of no known source come out as unknown_source."""
    known = F.coalesce(F.col("source").isin(list(PARSERS)), F.lit(False))
    text = lambda c: F.lit(None).cast("string").alias(c)
    others = records.filter(~known).select("*", text("signal"), F.lit(None).cast("timestamp").alias("occurred_at"), text("subject_email"), text("source_event_id"), text("attributes"), F.lit("unknown_source").alias("drop_reason"))
    parsed = reduce(DataFrame.unionByName, [parse(records.filter(F.col("source") == name)) for name, parse in PARSERS.items()], others)
    found = resolve(parsed, people, "subject_email")
    reason = F.coalesce("drop_reason", F.when(F.col("employee_id").isNull(), F.lit("unresolved_identity")))
    return found.withColumn("drop_reason", reason).select(
        *[c for c in records.columns if c not in ("payload", "source")], event_id(F.col("source"), F.col("source_event_id")).alias("event_id"), F.lit(1).alias("schema_version"), F.lit(tenant).alias("tenant_id"),
        "employee_id", "signal", "source", "occurred_at", F.current_timestamp().alias("ingested_at"), "source_event_id",
        archive_reference(F.col("source"), F.col("occurred_at"), F.col("source_event_id"), prefix).alias("raw_ref"), "attributes", "drop_reason",
    )


def wrong_source(events: DataFrame) -> DataFrame:
    """Events whose signal another source is the one to send."""
    catalog = signal_catalog(events.sparkSession).select("signal", F.col("source").alias("declared_source"))
    return events.join(F.broadcast(catalog), "signal").filter(F.col("source") != F.col("declared_source"))


def undelivered(events: DataFrame) -> DataFrame:
    """Signals of the catalog that no event has, with whether a parser could deliver them."""
    delivered = events.select("signal").distinct()
    can = [s for names in VOCABULARY.values() for s in names.values()]
    catalog = signal_catalog(events.sparkSession).select("ordinal", "signal", "source", F.col("signal").isin(can).alias("has_parser"))
    return catalog.join(delivered, "signal", "left_anti")


assert {s for names in VOCABULARY.values() for s in names.values()} <= {x[0] for x in SIGNALS}
