"""Daily counts of deduplicated events, filtered by properties."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.identity import weight
from ..plans.requests import Sampled, Segment
from .facts import dedup_earliest, in_order, matches, of_project, on_days
from .sampling import scaling


def _counts(facts: DataFrame, q: Segment, sampled: Sampled | None, rollup: DataFrame | None, single: Sequence[dt.date] | bool) -> DataFrame:
    q.checked()
    threshold, scale = scaling(facts, q.project, q.days, None if q.event is None else [q.event], sampled, rollup)
    rows = on_days(of_project(facts, q.project), q.days)
    if q.event is not None:
        rows = rows.where(F.col("event_name") == q.event)
    for f in q.filters:  # copies agree on properties, so this may go before the dedup
        rows = rows.where(matches(f))
    rows = rows.select("project_id", "event_name", "user_key", "ts", "message_id", "received_at", "is_late", "sample_threshold", (F.col("sample_bucket") < threshold).alias("kept"), *(["day"] if "day" in rows.columns else []))
    rows = dedup_earliest(rows, single)
    counts = rows.groupBy(F.to_date("ts").alias("day"), "is_late").agg(
        F.bround(F.sum(weight(F.col("sample_threshold")))).cast("long").alias("events"), F.count_distinct(F.when(F.col("kept"), F.col("user_key"))).alias("users"))
    return counts.withColumn("users", F.bround(F.col("users") * scale).cast("long"))


def segment(facts: DataFrame, q: Segment, sampled: Sampled | None = None, rollup: DataFrame | None = None, single: Sequence[dt.date] | bool = False) -> DataFrame:
    """``day, events, users`` of on-time events; a day with late events only does not appear.

    Users are scaled by the threshold that was stored with the facts (or their ``rollup``), unless ``sampled`` names one;
    ``single`` says that the facts hold no copies, or on which days they hold none, so they are not searched for any."""
    return in_order(_counts(facts, q, sampled, rollup, single).where(~F.col("is_late")).select("day", "events", "users"), "day")


def late_events(facts: DataFrame, q: Segment, single: Sequence[dt.date] | bool = False) -> DataFrame:
    """``late_events``: one row, events of the range that arrived after the watermark."""
    return _counts(facts, q, Sampled(), None, single).where("is_late").agg(F.coalesce(F.sum("events"), F.lit(0)).cast("long").alias("late_events"))
