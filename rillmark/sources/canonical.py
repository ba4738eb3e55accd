"""The driver's ``events`` table as fact rows: deterministic arrival, lateness, copies and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

PROJECT = "p-1"

#: The same rows for DuckDB, as the head of a WITH clause.
CANONICAL_SQL = """
base AS (
    SELECT event_id, 'p-1' AS project_id, event_type AS event_name, user_id AS user_key, 'e-' || event_id AS message_id,
           make_timestamp((epoch_us(ts) // 1000) * 1000) AS ts, epoch_us(ts) // 1000 AS t,
           value, CASE WHEN event_id % 7 <> 0 THEN json_extract_string(props, '$.k') END AS k,
           CASE WHEN event_type = 'view' THEN 5000 ELSE 10000 END AS sample_threshold,
           (user_id * 7919) % 10000 AS sample_bucket,
           CASE WHEN event_id % 20 = 0 THEN 10800000 ELSE 1000 END AS delay
    FROM events
), copies AS (
    SELECT *, 0 AS again FROM base UNION ALL SELECT *, 10800000 AS again FROM base WHERE event_id % 10 = 3
), facts AS (
    SELECT project_id, event_name, user_key, message_id, ts, t, value, k, sample_threshold, sample_bucket,
           t + delay + again AS received_ms, delay + again > 7200000 AS is_late
    FROM copies WHERE sample_bucket < sample_threshold
), deduped AS (
    SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY project_id, event_name, user_key, ts, message_id ORDER BY received_ms) = 1
)"""

#: The same for two projects that share their users; queries are about the first.
SHARED_SQL = CANONICAL_SQL.replace("'p-1' AS project_id", "CASE WHEN event_id % 3 = 0 THEN 'p-2' ELSE 'p-1' END AS project_id").replace(
    "WHERE sample_bucket < sample_threshold", "WHERE sample_bucket < sample_threshold AND project_id = 'p-1'")


def shared_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`facts` of two projects that share their users: every third event is of another project."""
    event = F.substring_index("message_id", "-", -1).cast("long")
    return facts(spark, sf_dir).withColumn("project_id", F.when(event % 3 == 0, "p-2").otherwise(PROJECT))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact rows with copies: a tenth arrives again three hours later, a twentieth is late, ``view`` is sampled at a half."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.unix_millis(F.col("ts").cast("timestamp"))
    k = F.when(F.col("event_id") % 7 != 0, F.get_json_object("props", "$.k"))
    value = F.map_from_arrays(F.array(F.lit("value")), F.array(F.col("value").cast("string")))
    base = events.select(
        F.lit(PROJECT).alias("project_id"),
        F.col("event_type").alias("event_name"),
        F.col("user_id").alias("user_key"),
        F.timestamp_millis(t).alias("ts"),
        F.concat(F.lit("e-"), F.col("event_id")).alias("message_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.lit("").alias("anonymous_id"),
        F.lit(1).alias("schema_version"),
        F.when(k.isNotNull(), F.map_concat(value, F.create_map(F.lit("k"), k))).otherwise(value).alias("properties"),
        F.when(F.col("event_id") % 20 == 0, 10_800_000).otherwise(1_000).alias("delay"),
        F.when(F.col("event_type") == "view", 5_000).otherwise(10_000).alias("sample_threshold"),
        (F.col("user_id") * 7919 % 10_000).cast("int").alias("sample_bucket"),
        F.explode(F.when(F.col("event_id") % 10 == 3, F.array(F.lit(0), F.lit(10_800_000))).otherwise(F.array(F.lit(0)))).alias("again"),
    ).where(F.col("sample_bucket") < F.col("sample_threshold"))
    delay = F.col("delay") + F.col("again")
    return base.select(
        "project_id", "event_name", "user_key", "ts", "message_id", "user_id", "anonymous_id", "schema_version", "properties",
        F.timestamp_millis(F.unix_millis("ts") + delay).alias("received_at"),
        (delay > 7_200_000).alias("is_late"),
        "sample_threshold", "sample_bucket",
    )
