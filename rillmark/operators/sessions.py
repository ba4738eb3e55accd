"""Sessions: inactivity gaps within a UTC day."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.stats import upper_median, value_counts
from ..plans.requests import Sessions
from .facts import dedup_earliest, in_order, millis, of_project

GAP_MS = 30 * 60 * 1000
#: Sessions lie within these.  Sorting begins with the column that tells most rows apart.
OWN = ["user_key", "day", "project_id"]
SESSION_SCHEMA = "project_id string, day date, user_key long, user_id string, session_start timestamp, session_end timestamp, event_count long"


def _ready(facts: DataFrame, single: bool = False) -> DataFrame:
    """On-time facts, one of each; lateness is judged on the copy that is kept.

    Copies agree in user and day, so they are searched where the sessions are made: rows are exchanged and sorted once.
    The exchange leaves out the project: where that is a constant, the windows would not recognise it."""
    shown = F.when(F.col("user_id") != "", F.col("user_id")).otherwise(F.col("anonymous_id"))
    slim = facts.select("project_id", F.to_date("ts").alias("day"), "event_name", "user_key", "ts", "message_id", shown.alias("user_id"), "received_at", "is_late")
    rows = slim if single else dedup_earliest(slim.repartition("user_key", "day"), order=[*OWN, "ts"])
    return rows.where(~F.col("is_late")).select("project_id", "day", "user_key", "user_id", "ts")


def sessions(facts: DataFrame, gap_ms: int = GAP_MS, single: Sequence[dt.date] | bool = False) -> DataFrame:
    """One row per session: a gap above ``gap_ms`` or midnight starts a new one.  ``single``: see ``dedup_earliest``."""
    if not isinstance(single, bool):  # no session goes beyond its day
        alone = F.col("day").isin(*single)
        return sessions(facts.where(alone), gap_ms, True).unionByName(sessions(facts.where(~alone), gap_ms)) if single else sessions(facts, gap_ms)
    order = Window.partitionBy(*OWN).orderBy("ts")
    gap = millis() - F.unix_millis(F.lag("ts").over(order))
    rows = _ready(facts, single).withColumn("starts", F.coalesce((gap > gap_ms).cast("int"), F.lit(1)))
    rows = rows.withColumn("session", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = rows.groupBy(*OWN, "session").agg(
        F.min("user_id").alias("user_id"), F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count("*").alias("event_count")
    )
    return found.select("project_id", "day", "user_key", "user_id", "session_start", "session_end", "event_count")


def sessions_by_window(facts: DataFrame) -> DataFrame:
    """The same through Spark's session windows, which merge a gap of exactly their length."""
    window = F.session_window("ts", f"{GAP_MS} milliseconds")
    return _ready(facts).groupBy("project_id", "day", "user_key", window).agg(
        F.min("user_id").alias("user_id"), F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count("*").alias("event_count")
    ).drop("session_window")


def sessions_daily(table: DataFrame, q: Sessions) -> DataFrame:
    """``day, sessions, users, median_duration_seconds, events_per_session``; never scaled.

    The sessions are read once: lengths are counted, and events and users are added up along with them; a user counts
    with the first session of a day."""
    q.checked()
    rows = of_project(table, q.project).where(F.col("day").between(F.lit(q.days.start), F.lit(q.days.end)))
    first = Window.partitionBy("project_id", "day", "user_key").orderBy("session_start")
    length = (F.unix_millis("session_end") - F.unix_millis("session_start")).alias("ms")
    rows = rows.select("day", length, "event_count", (F.row_number().over(first) == 1).cast("long").alias("user"))
    counts = value_counts(rows, ["day"], "ms", events=F.sum("event_count"), users=F.sum("user"))
    found = upper_median(counts, ["day"], totals=("events", "users"))
    answer = found.select(
        "day", F.col("n").alias("sessions"), "users", (F.col("median") / 1000).alias("median_duration_seconds"), (F.col("events") / F.col("n")).alias("events_per_session")
    )
    return in_order(answer, "day")
