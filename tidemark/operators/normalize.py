"""The normalizer: one outcome for each message of the raw topic.

In this order: undecodable or not a JSON object (dead letter), no event_id or employee_id (dead letter), seen before
(duplicate), invalid but of a later schema version (forwarded as it came), invalid (dead letter), else emitted anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import SIGNALS, SOURCES
from ..functions.scoring import zoned_timestamp
from .score import once

SCHEMA_VERSION = 1
EMITTED, DUPLICATE, FORWARDED, DEAD = "emitted", "duplicate", "forwarded_unknown_version", "dead_lettered"
_STRINGS = ("event_id", "tenant_id", "employee_id", "signal", "source")
_FIELDS = (*_STRINGS, "occurred_at", "ingested_at", "source_event_id", "raw_ref", "schema_version", "attributes")
_ROUTING = ("event_id", "employee_id")


def _variant(field: str) -> Column:
    return F.expr(f"try_variant_get(v, '$.{field}', 'variant')")


def _text(field: str) -> Column:
    return F.expr(f"try_variant_get(v, '$.{field}', 'string')")


def _is(field: str, kind: str) -> Column:
    return F.coalesce(F.col(f"_kind_{field}").startswith(kind), F.lit(False))


def _falsy(field: str) -> Column:
    """Absent, null, or a value that counts as nothing."""
    text = F.col(f"_{field}")
    return F.coalesce(text.isNull() & ~_is(field, "OBJECT") & ~_is(field, "ARRAY"), F.lit(True)) | (text == "") | (~_is(field, "STRING") & text.isin("0", "0.0", "false", "[]", "{}"))


def _parsed(messages: DataFrame) -> DataFrame:
    """Adds v (variant, null unless a JSON object) and _decoded, for messages with a value.

    A byte order mark is skipped, of repeated keys the last counts, NaN and Infinity are numbers. The parser stops at the
    end of a value; so that text after it doesn't pass, the message is read as the first of a list whose second and last
    element is a hash of the message, which no message holds.
    """
    messages.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    text = F.when(F.is_valid_utf8(F.col("value").cast("string")), F.regexp_replace(F.col("value").cast("string"), "^\ufeff", ""))
    rows = once(messages.filter("value is not null"), _text_of=text)
    mark = F.xxhash64("_text_of")
    rows = once(rows, _both=F.from_json(F.concat(F.lit("["), "_text_of", F.lit(","), mark.cast("string"), F.lit("]")), "variant", {"allowNonNumericNumbers": "true"}))
    rows = once(rows, _json=F.when(F.expr("try_variant_get(_both, '$[1]', 'bigint')") == mark, F.expr("try_variant_get(_both, '$[0]', 'variant')"))).drop("_both", "_text_of")
    is_object = F.coalesce(F.schema_of_variant("_json").startswith("OBJECT"), F.lit(False))
    return once(rows, v=F.when(is_object, F.col("_json")), _decoded=F.col("_json").isNotNull()).drop("_json")


def _placed(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Adds text and kind of fields, and routed_reason."""
    rows = once(rows, **{f"_{f}": _text(f) for f in fields}, **{f"_kind_{f}": F.schema_of_variant(_variant(f)) for f in fields})
    missing = F.array_compact(F.array(*[F.when(_falsy(f), F.lit(f)) for f in _ROUTING]))
    reason = F.when(~F.col("_decoded"), "undecodable").when(F.col("v").isNull(), "not a JSON object").when(F.size(missing) > 0, F.concat(F.lit("missing routing fields: "), F.array_join(missing, ", ")))
    return once(rows, routed_reason=reason)


def fields_of(messages: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Messages with a value and the text of some of their fields, each named with an underscore before it."""
    return once(_parsed(messages), **{f"_{f}": _text(f) for f in fields}).drop("v", "_decoded")


def decoded(messages: DataFrame) -> DataFrame:
    """Adds v (variant, null if undecodable), fields as text with their kinds, and routed_reason: why a message can't even be placed."""
    return _placed(_parsed(messages), _FIELDS)


def routed(messages: DataFrame) -> DataFrame:
    """decoded() with the fields alone that place a message, for a first pass that only needs its id and routed_reason."""
    return _placed(_parsed(messages), _ROUTING)


def _absent(field: str) -> Column:
    """Not there at all; a JSON null is there."""
    return F.col(f"_kind_{field}").isNull()


def _whole(field: str) -> Column:
    """A number written without a point: what doesn't fit 64 bits is a decimal of 19 digits or more without a scale."""
    return _is(field, "BIGINT") | F.coalesce(F.col(f"_kind_{field}").rlike(r"^DECIMAL\((19|2\d|3\d),\s*0\)"), F.lit(False))


def schema_version() -> Column:
    """The whole number that schema_version stands for (true and false, 2.0 and "2" too); without the field the first version; null if it is anything else, a null too."""
    text, kind = F.col("_schema_version"), "decimal(38, 0)"
    number = F.expr("try_cast(_schema_version as double)")
    whole = F.when(number % 1 == 0, F.expr(f"try_cast(_schema_version as {kind})"))
    told = F.when(_is("schema_version", "BOOLEAN"), F.when(text == "true", 1).otherwise(0).cast(kind)).when(_is("schema_version", "STRING") & text.rlike(r"^\s*[+-]?\d+(\.0+)?\s*$"), F.expr(f"try_cast(_schema_version as {kind})"))
    told = told.when(_is("schema_version", "BIGINT") | _is("schema_version", "DOUBLE") | _is("schema_version", "DECIMAL"), whole)
    return F.when(_absent("schema_version"), F.lit(SCHEMA_VERSION).cast(kind)).otherwise(told)


def validated(rows: DataFrame) -> DataFrame:
    """Adds version, occurred, ingested, valid and later_version for rows that decoded() could place.

    A field with a default may be absent, but where it is there it must be of its type: attributes an object, times with
    a zone or numbers, and none of them null.
    """
    strings = [_is(f, "STRING") for f in _STRINGS]
    nullable = [_absent(f) | _is(f, "VOID") | _is(f, "STRING") for f in ("source_event_id", "raw_ref")]
    known = [F.col("_signal").isin([s[0] for s in SIGNALS]), F.col("_source").isin(SOURCES)]
    timed = lambda f, at: (_is(f, "STRING") | _is(f, "BIGINT") | _is(f, "DOUBLE") | _is(f, "DECIMAL")) & F.col(at).isNotNull()
    others = [timed("occurred_at", "occurred"), _absent("ingested_at") | timed("ingested_at", "ingested"), _absent("attributes") | _is("attributes", "OBJECT")]
    rows = once(rows, version=schema_version(), occurred=zoned_timestamp(F.col("_occurred_at")), ingested=zoned_timestamp(F.col("_ingested_at")))
    valid = F.col("version").isNotNull()
    for x in (*strings, *nullable, *known, *others):
        valid = valid & x
    later = _whole("schema_version") & (F.col("version") > SCHEMA_VERSION)
    return rows.withColumns({"valid": F.coalesce(valid, F.lit(False)), "later_version": F.coalesce(later, F.lit(False))})


def emitted_value() -> Column:
    """The event as this engine understands it: known fields only, times in UTC."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    fields = F.struct(
        F.col("_event_id").alias("event_id"), F.col("version").alias("schema_version"), F.col("_tenant_id").alias("tenant_id"), F.col("_employee_id").alias("employee_id"),
        F.col("_signal").alias("signal"), F.col("_source").alias("source"), iso(F.col("occurred")).alias("occurred_at"),
        iso(F.coalesce("ingested", F.current_timestamp())).alias("ingested_at"), F.col("_source_event_id").alias("source_event_id"), F.col("_raw_ref").alias("raw_ref"), F.coalesce(_variant("attributes"), F.parse_json(F.lit("{}"))).alias("attributes"),
    )
    return F.to_json(fields, {"ignoreNullFields": "false"}).cast("binary")


def decide(rows: DataFrame, duplicate: Column) -> DataFrame:
    """Adds outcome, out_key, out_value, reason. duplicate: whether an earlier message had this event id."""
    placed = F.col("routed_reason").isNull()
    outcome = F.when(~placed, DEAD).when(duplicate, DUPLICATE).when(F.col("valid"), EMITTED).when(F.col("later_version"), FORWARDED).otherwise(DEAD)
    rows = once(rows, outcome=outcome)
    value = F.when(F.col("outcome") == EMITTED, emitted_value()).when(F.col("outcome") != DUPLICATE, F.col("value"))
    reason = F.when(~placed, F.col("routed_reason")).when(F.col("outcome") == DUPLICATE, F.col("_event_id")).when(F.col("outcome") == FORWARDED, F.concat(F.lit("schema_version "), F.col("_schema_version"), F.lit(f" > {SCHEMA_VERSION}"))).when(F.col("outcome") == DEAD, F.lit("invalid"))
    return rows.withColumns({"out_key": F.when(placed, F.col("_employee_id").cast("binary")), "out_value": value, "reason": reason})


def normalize(messages: DataFrame) -> DataFrame:
    """Batch form over key, value, topic, partition, offset, timestamp: the first of an event id in arrival order (timestamp, partition, offset) passes.

    First arrivals are taken by partial aggregation of ids and positions, so that an id delivered any number of times
    sorts nowhere; only ids that came more than once meet the messages again, which thus mostly needn't be shuffled.
    Where they are, messages that can't be placed are dealt by position, and a much redelivered id is left to the
    adaptive skew join, which may split a left join's left side.
    Rows that repeat a message's very position are that message read again and decided alike.
    """
    parsed = _parsed(messages)
    position = F.struct("timestamp", "partition", "offset")
    ids = _placed(parsed, _ROUTING).filter("routed_reason is null")
    again = ids.groupBy("_event_id").agg(F.min(position).alias("_first"), F.max(position).alias("_last")).filter("_first < _last").select("_event_id", "_first")
    key = F.when(F.col("routed_reason").isNull(), F.col("_event_id")).otherwise(F.concat(F.lit("\u0000"), "partition", F.lit(":"), "offset"))
    rows = _placed(parsed, _FIELDS).withColumn("_key", key).join(again.withColumnRenamed("_event_id", "_key"), "_key", "left")
    later = F.coalesce(F.col("_first") < position, F.lit(False))
    return decide(validated(rows), later).select(*messages.columns, F.col("_event_id").alias("event_id"), "outcome", "out_key", "out_value", "reason")


def outcome_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("outcome").agg(F.count("*").alias("n"))


def dead_letters(decisions: DataFrame) -> DataFrame:
    """What a dead-letter topic takes: the bytes as they came, and the reason as a header."""
    header = F.array(F.struct(F.lit("reason").alias("key"), F.col("reason").cast("binary").alias("value")))
    return decisions.filter(F.col("outcome") == DEAD).select(F.col("out_key").alias("key"), F.col("value"), header.alias("headers"))
