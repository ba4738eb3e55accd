"""Generated inputs: raw JSON events from the driver's table, and the shape of a load test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.reasons import MUST_BE, NO_EVENT, NO_IDENTITY, NO_MESSAGE_ID, NO_TIMESTAMP, NOT_OBJECT
from .registry import Property, Registry, Settings, Snapshot, Spec

PROJECT = "p-1"


def demo_registry(sampled: bool = True) -> Registry:
    registry = Registry()
    registry.put_project(PROJECT, Settings(("email",), {"view": 0.5} if sampled else {}))
    spec = Spec({"k": Property("integer"), "value": Property("number", True), "email": Property("string"), "kind": Property("string", False, ("a", "b"))})
    for event in ("click", "purchase", "signup", "view"):  # error stays unregistered
        registry.put_schema(PROJECT, event, 1, spec)
    return registry


def demo_snapshot(sampled: bool = True) -> Snapshot:
    return demo_registry(sampled).snapshot()


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``project_id, raw, received_at, pos``; some events break a rule each."""
    return raw_from(spark.read.parquet(f"{sf_dir}/events.parquet"))


def raw_from(events: DataFrame) -> DataFrame:
    ts, i = F.col("ts").cast("timestamp"), F.col("event_id")
    at = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS")
    number = F.when(F.isnan("value"), F.lit(0.0)).otherwise(F.round("value", 3)).cast("decimal(18,3)").cast("string")
    fields = [
        F.lit('"messageId":"'), F.when(i % 29 == 0, "").otherwise(F.concat(F.lit("e-"), (i - F.when(i % 31 == 0, 1).otherwise(0)).cast("string"))),
        F.lit('","event":"'), F.when(i % 37 == 0, "9bad").otherwise(F.col("event_type")),
        F.lit('","userId":"'), F.when(i % 41 == 0, "").otherwise(F.col("user_id").cast("string")),
        F.lit('","timestamp":"'), at, F.when(i % 43 == 0, "").otherwise("Z"),
        F.lit('","properties":{"value":'), F.when(i % 47 == 0, F.lit('"x"')).otherwise(number),
        F.when(i % 53 == 0, F.lit(',"extra":1')).otherwise(""), F.lit(',"k":'), F.coalesce(F.get_json_object("props", "$.k"), F.lit("null")), F.lit("}"),
    ]
    raw = F.when(i % 59 == 0, "[]").otherwise(F.concat(F.lit("{"), *fields, F.lit("}")))
    delay = F.when(i % 20 == 0, F.expr("interval 3 hours")).otherwise(F.expr("interval 1 second"))
    return events.select(F.lit(PROJECT).alias("project_id"), raw.alias("raw"), (ts + delay).alias("received_at"), i.alias("pos"))


def draw(key: Column, salt: int, n: int) -> Column:
    """A number below ``n`` mixed from ``key`` by 32-bit arithmetic that any engine can repeat."""
    a = (F.pmod(key, F.lit(1 << 31)) + salt * 7919) * 2654435761 % (1 << 32)
    b = a.bitwiseXOR(F.shiftright(a, 15)) * 1597334677 % (1 << 32)
    return b.bitwiseXOR(F.shiftright(b, 13)) % n


def _draw_sql(key: str, salt: int, n: int) -> str:
    a = f"(({key} % 2147483648 + {salt * 7919}) * 2654435761 % 4294967296)"
    b = f"(xor({a}, {a} >> 15) * 1597334677 % 4294967296)"
    return f"(xor({b}, {b} >> 13) % {n})"


ACTIVATE, AFTER, BUY, TIMES, START, LATER = range(1, 7)


def seed_rows(users: DataFrame, days: int = 30) -> DataFrame:
    """``id, event_name, ts`` of a generated load, from the ``id`` of its users: every user signs up, 45 of 100 activate, 30 of 100 of those buy
    one to three times, and views and feature uses come four to one."""
    own = F.col("id")
    base = users.select("id", draw(own, START, days * 86_400_000).alias("t"))
    rows = lambda df, name: df.select("id", F.lit(name).alias("event_name"), F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("t")).alias("ts"))
    active = base.where(draw(own, ACTIVATE, 100) < 45).withColumn("t", F.col("t") + draw(own, AFTER, 3 * 86_400_000))
    times = F.sequence(F.lit(0).cast("long"), draw(own, TIMES, 3))
    buyers = active.where(draw(own, BUY, 100) < 30).withColumn("n", F.explode(times)).withColumn("t", F.col("t") + draw(own * 4 + F.col("n"), LATER, 10 * 86_400_000))
    uses = base.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(4))))
    views = rows(uses.where("n < 4"), "page_view").unionByName(rows(uses.where("n = 4"), "feature_used"))
    return rows(base, "signup").unionByName(rows(active, "activate")).unionByName(rows(buyers, "purchase")).unionByName(views)


def seed_shape(users: DataFrame, days: int = 30) -> DataFrame:
    """``event_name, n, users, first, last`` of the generated load."""
    return seed_rows(users, days).groupBy("event_name").agg(F.count("*").alias("n"), F.count_distinct("id").alias("users"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def seed_sql(users: str, days: int = 30) -> str:
    return f"""WITH base AS (SELECT id, {_draw_sql("id", START, days * 86_400_000)} AS t FROM {users}),
    active AS (SELECT id, t + {_draw_sql("id", AFTER, 3 * 86_400_000)} AS t FROM base WHERE {_draw_sql("id", ACTIVATE, 100)} < 45),
    buyers AS (SELECT id, t + {_draw_sql("(id * 4 + n)", LATER, 10 * 86_400_000)} AS t FROM active, range(0, 3) AS r(n) WHERE {_draw_sql("id", BUY, 100)} < 30 AND n <= {_draw_sql("id", TIMES, 3)}),
    everything AS (SELECT id, t, 'signup' AS event_name FROM base UNION ALL SELECT id, t, 'activate' FROM active UNION ALL SELECT id, t, 'purchase' FROM buyers
        UNION ALL SELECT id, t, 'page_view' FROM base, range(0, 4) UNION ALL SELECT id, t, 'feature_used' FROM base)
    SELECT event_name, count(*) AS n, count(DISTINCT id) AS users, make_timestamp((1704067200000 + min(t)) * 1000) AS first, make_timestamp((1704067200000 + max(t)) * 1000) AS last FROM everything GROUP BY ALL"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Outcomes of :func:`raw_events` without sampling, for DuckDB, as the head of a WITH clause.
RAW_SQL = f"""
judged AS (
    SELECT event_id AS pos, user_id, epoch_us(ts) // 1000 AS t, event_type AS event_name, 'e-' || (event_id - CASE WHEN event_id % 31 = 0 THEN 1 ELSE 0 END) AS message_id, CASE
        WHEN event_id % 59 = 0 THEN {_quoted(NOT_OBJECT)}
        WHEN event_id % 29 = 0 THEN {_quoted(NO_MESSAGE_ID)}
        WHEN event_id % 37 = 0 THEN {_quoted(NO_EVENT)}
        WHEN event_id % 41 = 0 THEN {_quoted(NO_IDENTITY)}
        WHEN event_id % 43 = 0 THEN {_quoted(NO_TIMESTAMP)}
        WHEN event_type = 'error' THEN 'no schema is registered for event ''error'''
        WHEN event_id % 47 = 0 OR event_id % 53 = 0 THEN concat_ws('; ',
            CASE WHEN event_id % 47 = 0 THEN 'property ''value'' must be {MUST_BE["number"]}' END,
            CASE WHEN event_id % 53 = 0 THEN 'property ''extra'' is not declared in ' || event_type || '@1' END)
        END AS rejected
    FROM events
), outcome AS (
    SELECT *, CASE WHEN rejected IS NOT NULL THEN 'quarantined'
        WHEN row_number() OVER (PARTITION BY message_id, rejected IS NULL ORDER BY pos) > 1 THEN 'duplicate' ELSE 'accepted' END AS status FROM judged
)"""
