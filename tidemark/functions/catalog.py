"""The signal catalog: what each signal weighs, how fast it fades, and which source may send it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Signal, category, weight, half-life in days, source; in the order that breaks ties.
SIGNALS = [
    ("phish_sim_delivered", "phishing_susceptibility", 0.0, 30.0, "email_gateway"),
    ("phish_sim_clicked", "phishing_susceptibility", 8.0, 21.0, "email_gateway"),
    ("phish_sim_reported", "phishing_susceptibility", -6.0, 30.0, "email_gateway"),
    ("phish_credentials_submitted", "phishing_susceptibility", 25.0, 45.0, "email_gateway"),
    ("real_phish_reported", "phishing_susceptibility", -10.0, 60.0, "email_gateway"),
    ("mfa_push_denied", "credential_hygiene", 0.4, 7.0, "okta"),
    ("mfa_push_flood", "credential_hygiene", 14.0, 21.0, "okta"),
    ("password_reuse_detected", "credential_hygiene", 10.0, 90.0, "okta"),
    ("credential_in_breach_dump", "credential_hygiene", 18.0, 180.0, "breach_intel"),
    ("impossible_travel_login", "credential_hygiene", 9.0, 14.0, "okta"),
    ("file_shared_externally", "data_handling", 0.3, 14.0, "google_workspace"),
    ("file_shared_public_link", "data_handling", 11.0, 30.0, "google_workspace"),
    ("sensitive_data_to_genai", "data_handling", 13.0, 21.0, "endpoint_agent"),
    ("bulk_download_detected", "data_handling", 15.0, 30.0, "google_workspace"),
    ("usb_mass_storage_mounted", "data_handling", 1.2, 14.0, "endpoint_agent"),
    ("oauth_grant_risky_scope", "access_hygiene", 12.0, 60.0, "google_workspace"),
    ("email_forwarding_rule_created", "access_hygiene", 16.0, 60.0, "google_workspace"),
    ("admin_privilege_granted", "access_hygiene", 5.0, 120.0, "okta"),
    ("stale_access_unreviewed", "access_hygiene", 6.0, 90.0, "okta"),
    ("training_completed", "security_engagement", -7.0, 60.0, "training_platform"),
    ("training_overdue", "security_engagement", 5.0, 30.0, "training_platform"),
    ("intervention_acknowledged", "security_engagement", -4.0, 30.0, "slack"),
    ("intervention_ignored", "security_engagement", 3.0, 30.0, "slack"),
]
CATEGORIES = ["phishing_susceptibility", "credential_hygiene", "data_handling", "access_hygiene", "security_engagement"]
BANDS = [("critical", 80.0), ("high", 60.0), ("elevated", 40.0), ("moderate", 20.0), ("low", 0.0)]
SOURCES = ["okta", "google_workspace", "email_gateway", "endpoint_agent", "breach_intel", "training_platform", "slack"]

SCHEMA = T.StructType(
    [
        T.StructField("ordinal", T.IntegerType(), False),
        T.StructField("signal", T.StringType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("category_ordinal", T.IntegerType(), False),
        T.StructField("weight", T.DoubleType(), False),
        T.StructField("half_life_days", T.DoubleType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("is_mitigating", T.BooleanType(), False),
    ]
)


def signal_catalog(spark: SparkSession) -> DataFrame:
    """One row for each signal. Joins with it are broadcast: its size is fixed."""
    rows = [(i, s, c, CATEGORIES.index(c), w, h, source, w < 0) for i, (s, c, w, h, source) in enumerate(SIGNALS)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)
