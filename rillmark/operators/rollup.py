"""Monthly day masks per user: the mergeable rollup behind retention and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KEYS = ["project_id", "event_name", "month", "user_key"]
ROLLUP_SCHEMA = "project_id string, event_name string, month date, user_key long, days long, sample_threshold int, sample_bucket int"


def month_masks(facts: DataFrame) -> DataFrame:
    """Partial rollup rows of on-time facts; bit d-1 of ``days`` is day d.  Copies change nothing."""
    day = F.to_date("ts")
    return (
        facts.where(~F.col("is_late"))
        .groupBy("project_id", "event_name", F.trunc(day, "month").alias("month"), "user_key")
        .agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.dayofmonth(day) - 1)).alias("days"),
            F.min("sample_threshold").alias("sample_threshold"),
            F.min("sample_bucket").alias("sample_bucket"),
        )
    )


def merged(rollup: DataFrame) -> DataFrame:
    """One row per key from any number of partial ones; merging again changes nothing."""
    return rollup.groupBy(*KEYS).agg(F.bit_or("days").alias("days"), F.min("sample_threshold").alias("sample_threshold"), F.min("sample_bucket").alias("sample_bucket"))


def days_of(month: Column, mask: Column) -> Column:
    """Array of the dates whose bits are set."""
    set_bits = F.filter(F.sequence(F.lit(0), F.lit(30)), lambda i: F.call_function("getbit", mask, i) == 1)
    return F.transform(set_bits, lambda i: F.date_add(month, i))
