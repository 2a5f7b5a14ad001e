"""The given tables as this engine's model: people from customer and nation, behaviour events from events.

Also what the other inputs would look like: topic messages (some of them broken) and vendors' raw records, made from the
same events by Spark, so that parsers and the normalizer have whole tables to work on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import SIGNALS, signal_catalog
from ..functions.scoring import event_id, is_high_value

TENANT = "acme"
AS_OF = "2024-01-31 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each customer. Every 97th shares an address, every 10th reports to number key / 10; some managers don't exist."""
    customer, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation"))
    key = F.col("c_custkey")
    rows = customer.join(F.broadcast(nation.select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"), "left")  # 25 rows
    address = F.when(key % 97 == 0, F.lit("shared@acme.example")).otherwise(F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit(""))), F.lit("@acme.example")))
    return rows.select(
        key.cast("string").alias("employee_id"),
        F.lit(TENANT).alias("tenant_id"),
        F.col("c_mktsegment").alias("department"),
        F.when(key % 10 == 0, "director").when(key % 3 == 0, "senior").otherwise("mid").alias("seniority"),
        (key % 2000).cast("int").alias("tenure_days"),
        F.col("n_name").alias("location"),
        (F.col("c_nationkey") < 3).alias("has_admin_access"),
        (F.col("c_mktsegment") == "FURNITURE").alias("handles_financial_data"),
        (key % 50 == 0).alias("is_executive"),
        address.alias("email"),
        F.col("c_name").alias("display_name"),
        F.when(key % 1000 == 999, F.concat(F.lit("x"), key.cast("string"))).when(key >= 10, F.floor(key / 10).cast("string")).alias("manager_id"),
    ).withColumn("is_high_value", is_high_value(F.col("is_executive"), F.col("handles_financial_data"), F.col("has_admin_access")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events; seq is the given event_id, the order of arrival."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "props")
    seq, catalog = F.col("seq"), signal_catalog(spark).select("ordinal", "signal", "source")
    k = F.get_json_object("props", "$.k").cast("int")
    late = F.when(seq % 25 == 0, 300 + seq * 37 % 14100).otherwise(1 + seq % 44)
    rows = raw.withColumnRenamed("event_id", "seq").withColumn("occurred_at", F.col("ts").cast("timestamp"))
    rows = rows.withColumn("employee_id", (F.col("user_id") * 10 + k % 10).cast("string")).join(F.broadcast(catalog), F.col("seq") % len(SIGNALS) == F.col("ordinal"))
    source_id = F.concat(F.col("source"), F.lit("-"), seq.cast("string"))
    return rows.select(
        "seq",
        event_id(F.col("source"), source_id).alias("event_id"),
        F.lit(1).alias("schema_version"),
        F.lit(TENANT).alias("tenant_id"),
        "employee_id",
        "signal",
        "source",
        "occurred_at",
        F.timestamp_micros(F.unix_micros("occurred_at") + late * 1_000_000).alias("ingested_at"),
        source_id.alias("source_event_id"),
        F.lit(None).cast("string").alias("raw_ref"),
        F.to_json(F.struct(F.col("event_type").alias("kind"), k.alias("k"))).alias("attributes"),
    )


def _iso(ts):
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic-shaped rows: key, value (binary), topic, partition, offset, timestamp. By seq mod 101, messages 0 to 18 are broken or odd, and number 6 comes twice.

    0 cut off, 1 an array, 2 without a person, 3 an unknown signal, 4 the same of a later version, 5 a time without a zone,
    7 attributes that are text, 8 null attributes, 9 a null version, 10 a null ingested_at, 11 true as version, 12 the time
    in milliseconds, 13 text after the object, 14 a repeated key, 15 a byte order mark, 16 an unknown signal of a version
    of twenty digits, 17 a time with a space before it, 18 NaN among the attributes.
    """
    rows = events(spark, sf_dir)
    kind = F.col("seq") % 101
    fields = F.struct(
        "event_id",
        F.when(kind == 4, F.lit(6)).otherwise(F.col("schema_version")).alias("schema_version"),
        "tenant_id",
        F.when(kind == 2, F.lit("")).otherwise(F.col("employee_id")).alias("employee_id"),
        F.when(kind.isin(3, 4, 16), F.lit("not_a_signal")).otherwise(F.col("signal")).alias("signal"),
        "source",
        F.when(kind == 5, F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(_iso("occurred_at")).alias("occurred_at"),
        _iso("ingested_at").alias("ingested_at"),
        "source_event_id",
        "raw_ref",
        F.from_json("attributes", "kind string, k int").alias("attributes"),
    )
    # an array of one, exploded: else the optimizer copies the writing of the text into each of its uses
    rows = rows.withColumn("text", F.explode(F.array(F.to_json(fields, {"ignoreNullFields": "false"}))))
    text = F.col("text")
    changes = {7: (r'"attributes":\{[^}]*\}', F.lit('"attributes":"text"')), 8: (r'"attributes":\{[^}]*\}', F.lit('"attributes":null')), 9: ('"schema_version":1', F.lit('"schema_version":null')), 10: ('"ingested_at":"[^"]*"', F.lit('"ingested_at":null'))}
    changes |= {11: ('"schema_version":1', F.lit('"schema_version":true')), 12: ('"occurred_at":"[^"]*"', F.concat(F.lit('"occurred_at":'), F.unix_millis("occurred_at").cast("string")))}
    changes |= {16: ('"schema_version":1', F.lit('"schema_version":12345678901234567890')), 17: ('"occurred_at":"', F.lit('"occurred_at":" ')), 18: (r'"attributes":\{', F.lit('"attributes":{"x":NaN,'))}
    changes |= {14: (r"^\{", F.lit('{"schema_version":6,')), 13: (r"\}$", F.lit("} x")), 15: (r"^\{", F.lit("\ufeff{"))}
    value = F.when(kind == 0, F.substring(text, 1, 40)).when(kind == 1, F.concat(F.lit("["), text, F.lit("]")))
    for k, (pattern, new) in changes.items():
        value = value.when(kind == k, F.regexp_replace(text, F.lit(pattern), new))
    rows = rows.withColumn("copy", F.explode(F.when(kind == 6, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select(
        F.col("employee_id").cast("binary").alias("key"),
        value.otherwise(text).cast("binary").alias("value"),
        F.lit("events.raw").alias("topic"),
        F.pmod(F.crc32(F.col("employee_id").cast("binary")), F.lit(12)).cast("int").alias("partition"),
        (F.col("seq") * 2 + F.col("copy")).alias("offset"),
        F.col("ingested_at").alias("timestamp"),
    )


def vendor_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, seq and payload (JSON text) as the four vendors would send it. By seq mod 31: 0 isn't relevant, 1 lacks its time, 2 names nobody.

    3: what the guards look at says no (a push that was approved, a campaign that isn't simulated, a device whose management
    isn't known; from Workspace a second activity, which doesn't count). 4: it isn't there at all (no outcome, no campaign).
    """
    people = employees(spark, sf_dir).select("employee_id", "email")
    rows = events(spark, sf_dir).filter(F.col("source").isin("okta", "google_workspace", "email_gateway", "endpoint_agent")).join(people, "employee_id", "left")
    odd, seq, signal = F.col("seq") % 31, F.col("seq"), F.col("signal")
    who = F.when(odd == 2, F.lit("nobody@acme.example")).otherwise(F.coalesce(F.concat(F.lit(" "), F.upper("email")), F.lit("gone@acme.example")))
    timed = lambda c: F.when(odd != 1, c)
    k = F.get_json_object("attributes", "$.k")
    name = lambda names, other: F.when(odd == 0, F.lit(other)).otherwise(F.create_map(*[F.lit(x) for pair in names for x in pair])[signal])

    from ..operators.parsers import EMAIL, ENDPOINT, OKTA, WORKSPACE

    turned = lambda names: [(v, n) for n, v in names.items()]
    okta = F.struct(
        F.col("source_event_id").alias("uuid"), timed(_iso("occurred_at")).alias("published"), name(turned(OKTA), "user.session.start").alias("eventType"),
        F.when(odd != 4, F.struct(F.when(odd == 3, "SUCCESS").otherwise("FAILURE").alias("result"))).alias("outcome"), F.struct(who.alias("alternateId")).alias("actor"), F.struct(F.struct(k.alias("k")).alias("debugData")).alias("debugContext"),
    )
    workspace = F.struct(
        F.struct(timed(_iso("occurred_at")).alias("time"), F.col("source_event_id").alias("uniqueQualifier")).alias("id"), F.struct(who.alias("email")).alias("actor"),
        F.when(odd == 0, F.array().cast("array<struct<name:string,parameters:array<struct<name:string,value:string>>>>")).otherwise(
            F.slice(F.array(*[F.struct(n.alias("name"), F.array(F.struct(F.lit("k").alias("name"), k.alias("value"))).alias("parameters")) for n in (name(turned(WORKSPACE), ""), F.lit("authorize"))]), 1, F.when(odd == 3, 2).otherwise(1))
        ).alias("events"),
    )
    email = F.struct(
        F.col("source_event_id").alias("event_id"), timed(F.unix_seconds("occurred_at")).alias("timestamp"), who.alias("recipient"), name(turned(EMAIL), "opened").alias("action"),
        F.when(odd != 4, F.struct(F.concat(F.lit("c"), k).alias("id"), F.lit("invoice").alias("subject"), (odd != 3).alias("simulated"))).alias("campaign"),
    )
    endpoint = F.struct(
        F.col("source_event_id").alias("record_id"), timed(_iso("occurred_at")).alias("observed_at"), who.alias("user_principal"), name(turned(ENDPOINT), "x").alias("telemetry_type"),
        F.struct(F.lit("d").alias("id"), F.when(odd != 3, odd != 0).alias("managed")).alias("device"), F.struct(k.alias("k")).alias("details"),
    )
    payload = F.when(F.col("source") == "okta", F.to_json(okta)).when(F.col("source") == "google_workspace", F.to_json(workspace)).when(F.col("source") == "email_gateway", F.to_json(email)).otherwise(F.to_json(endpoint))
    return rows.select("source", seq.alias("seq"), payload.alias("payload"))

