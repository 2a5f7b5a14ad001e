"""Schemas of what is read; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("tenant_id", T.StringType()),
        T.StructField("employee_id", T.StringType()),
        T.StructField("signal", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("occurred_at", T.TimestampType()),
        T.StructField("ingested_at", T.TimestampType()),
        T.StructField("source_event_id", T.StringType()),
        T.StructField("raw_ref", T.StringType()),
        T.StructField("attributes", T.StringType()),
    ]
)
MESSAGE = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)
EMPLOYEE = T.StructType(
    [
        T.StructField("employee_id", T.StringType()),
        T.StructField("tenant_id", T.StringType()),
        T.StructField("department", T.StringType()),
        T.StructField("seniority", T.StringType()),
        T.StructField("tenure_days", T.IntegerType()),
        T.StructField("location", T.StringType()),
        T.StructField("has_admin_access", T.BooleanType()),
        T.StructField("handles_financial_data", T.BooleanType()),
        T.StructField("is_executive", T.BooleanType()),
        T.StructField("email", T.StringType()),
        T.StructField("display_name", T.StringType()),
        T.StructField("manager_id", T.StringType()),
    ]
)
EMPLOYEE_DOCUMENT = T.StructType([T.StructField("employees", T.ArrayType(EMPLOYEE)), T.StructField("_generator_personas", T.MapType(T.StringType(), T.StringType()))])
