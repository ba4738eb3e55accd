"""The threshold at which results of sampled events are scaled.

A query that is not told otherwise scales by what was stored: the least threshold of its events in
the months it touches, as a scalar subquery of its own plan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.identity import BUCKETS
from ..plans.requests import Days, Sampled
from .facts import midnight, of_project


def _threshold(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.expr("nullif(min(sample_threshold), 0)"), F.lit(BUCKETS)).cast("int").alias("threshold"))


def _named(rows: DataFrame, events: list[str] | None) -> DataFrame:
    return rows if events is None else rows.where(F.col("event_name").isin(*events))


def threshold_frame(rollup: DataFrame, project: str, days: Days, events: list[str] | None = None) -> DataFrame:
    """``threshold``: least stored threshold of the project in the months touched; 10,000 if there is none."""
    rows = of_project(rollup, project).where(F.col("month").between(F.lit(days.start.replace(day=1)), F.lit(days.end)))
    return _threshold(_named(rows, events))


def threshold_of_facts(facts: DataFrame, project: str, days: Days, events: list[str] | None = None) -> DataFrame:
    """The same from the facts that the rollup is made of; reads four of their columns, of whole months."""
    first = days.start.replace(day=1)
    after = (days.end.replace(day=1) + dt.timedelta(days=31)).replace(day=1)
    rows = of_project(facts, project).where((F.col("ts") >= midnight(first)) & (F.col("ts") < midnight(after)) & ~F.col("is_late"))
    if "day" in facts.columns:
        rows = rows.where((F.col("day") >= F.lit(first)) & (F.col("day") < F.lit(after)))
    return _threshold(_named(rows, events))


def sampling_for(rollup: DataFrame, project: str, days: Days, events: list[str] | None = None) -> Sampled:
    """The threshold as a value, for callers that show it beside an answer."""
    return Sampled.at(threshold_frame(rollup, project, days, events).first()["threshold"])


def scaling(table: DataFrame, project: str, days: Days, events: list[str] | None, sampled: Sampled | None = None, rollup: DataFrame | None = None) -> tuple[Column, Column]:
    """Threshold and scale of a query over ``table``: those of ``sampled`` if given, else what the rollup (or the table,
    which may be a rollup itself) has stored."""
    if sampled is not None:
        return F.lit(sampled.threshold), F.lit(sampled.scale)
    source = table if rollup is None else rollup
    found = (threshold_frame if "month" in source.columns else threshold_of_facts)(source, project, days, events).scalar()
    return found, F.lit(float(BUCKETS)) / found
