"""Raw events from the driver's table of which each breaks, or just keeps, one rule, with the outcome that SQL expects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.reasons import BAD_IDENTITY, BAD_VERSION, IN_FUTURE, MUST_BE, NOT_PROPERTIES, TOO_LARGE, TOO_OLD
from .generate import PROJECT
from .registry import Property, Registry, Settings, Snapshot, Spec

SPEC = Spec({
    "value": Property("number", True), "k": Property("integer"), "kind": Property("string", False, ("a", "b")), "email": Property("string"), "gift": Property("boolean"),
})
EVENTS = ("click", "error", "purchase", "signup", "view")
VALID = '{"value":1.50,"k":7}'
LONG = "n" * 70

#: (fields that replace those of a valid event, text of the properties, minutes from the event to its arrival, reason or None).
#: ``{event}`` is the event's name.
CASES: tuple[tuple[dict[str, str], str, int, str | None], ...] = (
    ({}, VALID, 1, None),
    ({"version": "0"}, VALID, 1, BAD_VERSION),
    ({"version": '"1"'}, VALID, 1, BAD_VERSION),
    ({"version": "7"}, VALID, 1, "no schema is registered for event '{event}' at version 7"),
    ({"version": "1"}, VALID, 1, None),
    ({"userId": '"' + "u" * 257 + '"'}, VALID, 1, BAD_IDENTITY),
    ({"userId": '"a\\u0007"'}, VALID, 1, BAD_IDENTITY),
    ({"userId": "null", "anonymousId": '"anonymous"'}, VALID, 1, None),
    ({}, VALID, -6, IN_FUTURE),
    ({}, VALID, -5, None),
    ({}, VALID, 91 * 1_440, TOO_OLD),
    ({}, VALID, 90 * 1_440, None),
    ({}, VALID, 121, None),
    ({}, "[1]", 1, NOT_PROPERTIES),
    ({}, "null", 1, "required property 'value' is missing"),
    ({}, '{"value":1,"k":1.5}', 1, f"property 'k' must be {MUST_BE['integer']}"),
    ({}, '{"value":true}', 1, f"property 'value' must be {MUST_BE['number']}"),
    ({}, '{"value":1,"gift":"yes"}', 1, f"property 'gift' must be {MUST_BE['boolean']}"),
    ({}, '{"value":1,"kind":5}', 1, f"property 'kind' must be {MUST_BE['string']}"),
    ({}, '{"value":1,"kind":"c"}', 1, "property 'kind' has a value that is not one of its allowed values"),
    ({}, '{"value":1,"email":"' + "e" * 1_025 + '"}', 1, "property 'email' is longer than 1024 characters"),
    ({}, '{"value":1,"value":2}', 1, "property 'value' appears more than once"),
    ({}, '{"value":1,"' + LONG + '":1}', 1, f"property '{LONG[:64]}...' is not declared in {{event}}@1"),
    ({}, '{"b":1,"kind":"c","k":"x"}', 1, f"property 'b' is not declared in {{event}}@1; property 'kind' has a value that is not one of its allowed values; property 'k' must be {MUST_BE['integer']}; required property 'value' is missing"),
    ({}, '{"value":1,"big":"' + "b" * 70_000 + '"}', 1, "property 'big' is not declared in {event}@1" + TOO_LARGE),
    ({}, '{"value":1e3,"email":"a@b"}', 1, None),
    ({}, '{"value":1.50,"email":"[redacted]","gift":true,"k":null}', 1, None),
)


def catalog() -> Snapshot:
    registry = Registry()
    registry.put_project(PROJECT, Settings(("email",)))
    for event in EVENTS:
        registry.put_schema(PROJECT, event, 1, SPEC)
    return registry.snapshot()


def odd_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``project_id, raw, received_at, pos``: event i is an event of case i modulo the number of cases."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts, case = F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp"))), (F.col("event_id") % len(CASES)).cast("int")

    def of_case(values: list) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), case)

    own = {"messageId": F.concat(F.lit('"e-'), F.col("event_id"), F.lit('"')), "event": F.concat(F.lit('"'), F.col("event_type"), F.lit('"')), "userId": F.concat(F.lit('"'), F.col("user_id"), F.lit('"')),
           "timestamp": F.concat(F.lit('"'), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit('Z"')), "version": F.lit("null"), "anonymousId": F.lit("null")}
    fields = [F.concat(F.lit(f'"{name}":'), F.coalesce(of_case([fields.get(name) for fields, *_ in CASES]), usual)) for name, usual in own.items()]
    raw = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit(',"properties":'), of_case([c[1] for c in CASES]), F.lit("}"))
    received = F.timestamp_millis(F.unix_millis(ts) + of_case([c[2] for c in CASES]).cast("long") * 60_000)
    return events.select(F.lit(PROJECT).alias("project_id"), raw.alias("raw"), received.alias("received_at"), F.col("event_id").alias("pos"))


def outcomes_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_name, status, reason, is_late, value, email, kept, n``: what became of the odd events, and how properties were stored."""
    from ..operators.normalize import ingest

    rows = ingest(odd_events(spark, sf_dir), catalog())
    stored = lambda name: F.try_element_at("properties", F.lit(name)).alias(name)
    kept = (F.octet_length("payload") > 2).alias("kept")
    return rows.select("event_name", "status", "reason", "is_late", stored("value"), stored("email"), kept).groupBy("event_name", "status", "reason", "is_late", "value", "email", "kept").agg(F.count("*").alias("n"))


def _sql(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''").replace("{event}", "' || event_type || '") + "'"


def _expected() -> str:
    rows = []
    for k, (_, properties, minutes, reason) in enumerate(CASES):
        value = "'1000'" if "1e3" in properties else "'1.5'" if "1.50" in properties else "NULL"
        email = "'[redacted]'" if "email" in properties else "NULL"
        if reason:
            kept = "FALSE" if reason.endswith(TOO_LARGE) else "TRUE"
            rows.append(f"WHEN {k} THEN {{'status': 'quarantined', 'reason': {_sql(reason)}, 'is_late': NULL, 'value': NULL, 'email': NULL, 'kept': {kept}}}")
        else:
            rows.append(f"WHEN {k} THEN {{'status': 'accepted', 'reason': NULL, 'is_late': {minutes > 120}, 'value': {value}, 'email': {email}, 'kept': NULL}}")
    return " ".join(rows)


ODD_SQL = f"""WITH e AS (SELECT event_type AS event_name, CASE event_id % {len(CASES)} {_expected()} END AS o FROM events)
SELECT event_name, o.status AS status, o.reason AS reason, o.is_late::BOOLEAN AS is_late, o.value::VARCHAR AS value, o.email::VARCHAR AS email, o.kept::BOOLEAN AS kept, count(*) AS n FROM e GROUP BY ALL"""
