"""Predicates and deduplication over the fact table.

Columns of a fact row: project_id, event_name, user_key, ts, message_id, user_id,
anonymous_id, schema_version, properties, received_at, is_late, sample_threshold,
sample_bucket.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import to_number
from ..plans.requests import Days, PropertyFilter

FACT_SCHEMA = (
    "project_id string, event_name string, user_key long, ts timestamp, message_id string, user_id string, anonymous_id string, "
    "schema_version int, properties map<string,string>, received_at timestamp, is_late boolean, sample_threshold int, sample_bucket int"
)
IDENTITY = ["project_id", "event_name", "user_key", "ts", "message_id"]


def of_project(df: DataFrame, project_id: str) -> DataFrame:
    """Every query begins here: rows of one project only."""
    return df.where(F.col("project_id") == project_id)


def in_order(df: DataFrame, *columns: str) -> DataFrame:
    """Rows of an answer in order.  Answers are bounded by their request (days, days followed), so one sorted partition
    holds them; it stands behind an exchange, as ``coalesce`` would pull the last aggregation into one task as well."""
    return df.repartition(1).sortWithinPartitions(*columns)


def midnight(day: dt.date) -> Column:
    return F.lit(dt.datetime(day.year, day.month, day.day, tzinfo=dt.timezone.utc))


def within(days: Days, extra_seconds: int = 0) -> Column:
    """Half-open range of ``ts``; also on ``day`` where the table is partitioned by it (Catalyst prunes by either)."""
    end = midnight(days.end + dt.timedelta(days=1))
    if extra_seconds:
        end = F.lit(dt.datetime(days.end.year, days.end.month, days.end.day, tzinfo=dt.timezone.utc) + dt.timedelta(days=1, seconds=extra_seconds))
    return (F.col("ts") >= midnight(days.start)) & (F.col("ts") < end)


def on_days(df: DataFrame, days: Days, extra_seconds: int = 0) -> DataFrame:
    """Rows of the range; a partition column ``day`` is filtered as well, so whole directories are skipped."""
    out = df.where(within(days, extra_seconds))
    if "day" in df.columns:
        last = days.end + dt.timedelta(seconds=extra_seconds + 86_399 if extra_seconds else 0)
        out = out.where(F.col("day").between(F.lit(days.start), F.lit(last)))
    return out


def millis(ts: str = "ts") -> Column:
    return F.unix_millis(F.col(ts))


def matches(f: PropertyFilter) -> Column:
    """A property filter; a missing property reads as the empty string."""
    value = F.coalesce(F.col("properties")[f.name], F.lit(""))
    if f.operator == "eq":
        return value == f.values[0]
    if f.operator == "neq":
        return value != f.values[0]
    if f.operator == "in":
        return value.isin(*f.values)
    number, bound = to_number(value), F.lit(float(f.values[0]))
    return F.coalesce(number > bound if f.operator == "gt" else number < bound, F.lit(False))


def dedup_earliest(df: DataFrame, single: Sequence[dt.date] | bool = False, order: Sequence[str] = ()) -> DataFrame:
    """One row per identity: the copy that arrived first.

    Filters on columns in which copies agree (all but arrival and lateness) belong in front of
    this, as they shrink the shuffle; filters on lateness belong behind it.  ``single`` says that
    there are no copies, or names days (of the partition column ``day``) without any: their rows
    are taken as they stand.  ``order`` names columns in which copies agree: rows come out sorted by
    them within their partition, and if they were exchanged by some of them, they stay where they are.
    """
    if single is True:
        return df
    if single:
        alone = F.col("day").isin(*single)
        return df.where(alone).unionByName(dedup_earliest(df.where(~alone), order=order))
    first = Window.partitionBy(*order, *(c for c in IDENTITY if c not in order)).orderBy("received_at")
    return df.withColumn("_copy", F.row_number().over(first)).where("_copy = 1").drop("_copy")
