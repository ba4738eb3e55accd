"""Ordered funnels within a window from the chain's start.

For every user the rows of the steps are sorted by (time, step).  The start of level 1 is each
first step; level i takes over the start of level i-1 if the row is in the window of that
start.  Of first steps in a row only the last counts, as each replaces the one before it; the others
go before the levels are built.  Carried forward with ``last(ignore nulls)``, this is one sort and one window per level
over a single shuffle by user, without arrays.  A level counts if it ever got a start; its time
is that of the last row that reached it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.stats import upper_median, value_counts
from ..plans.requests import Days, Funnel, Sampled
from .facts import midnight, millis, of_project, on_days
from .sampling import scaling

import datetime as dt


def step_rows(facts: DataFrame, q: Funnel, threshold: Column) -> DataFrame:
    """``user_key, t, step`` of the rows that can matter."""
    index = F.array_position(F.array(*[F.lit(s) for s in q.steps]), F.col("event_name")).cast("int")
    rows = on_days(of_project(facts, q.project), q.days, q.window_seconds).where(F.col("event_name").isin(*q.steps))
    rows = rows.where((F.col("event_name") != q.steps[0]) | (F.col("ts") < midnight(q.days.end + dt.timedelta(days=1))))
    rows = rows.where(~F.col("is_late") & (F.col("sample_bucket") < threshold))
    return rows.select("user_key", millis().alias("t"), index.alias("step"))


def last_of_first_steps(rows: DataFrame) -> DataFrame:
    """Without first steps that another first step of the user follows at once."""
    following = F.lead("step").over(Window.partitionBy("user_key").orderBy("t", "step"))
    return rows.withColumn("following", following).where(~((F.col("step") == 1) & F.col("following").eqNullSafe(1))).drop("following")


def levels(rows: DataFrame, steps: int, window_ms: int) -> DataFrame:
    """``user_key, d1 .. dk``: milliseconds from the start to each level, null if not reached."""
    order = Window.partitionBy("user_key").orderBy("t", "step")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("s1", F.when(F.col("step") == 1, F.col("t")))
    for i in range(2, steps + 1):
        before = F.last(f"s{i - 1}", ignorenulls=True).over(upto)
        rows = rows.withColumn(f"s{i}", F.when((F.col("step") == i) & (F.col("t") <= before + window_ms), before))

    def last_time(i: int) -> Column:
        return F.max_by(F.col("t") - F.col(f"s{i}"), F.when(F.col(f"s{i}").isNotNull(), F.col("t"))).alias(f"d{i}")

    return rows.groupBy("user_key").agg(*[last_time(i) for i in range(1, steps + 1)])


def levels_by_fold(rows: DataFrame, steps: int, window_ms: int) -> DataFrame:
    """The same from one sorted array per user; holds a user's rows in memory, so it serves as a cross-check."""
    empty = F.array(*[F.struct(F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("reached")) for _ in range(steps)])

    def advance(state: Column, row: Column) -> Column:
        out = []
        for i in range(1, steps + 1):
            own = F.get(state, F.lit(i - 1))
            if i == 1:
                hit = F.when(row["step"] == 1, F.struct(row["t"].alias("start"), row["t"].alias("reached")))
            else:
                start = F.get(state, F.lit(i - 2))["start"]
                hit = F.when((row["step"] == i) & (row["t"] <= start + window_ms), F.struct(start.alias("start"), row["t"].alias("reached")))
            out.append(F.coalesce(hit, own))
        return F.array(*out)

    arrays = rows.groupBy("user_key").agg(F.sort_array(F.collect_list(F.struct("t", "step"))).alias("rows"))
    state = arrays.select("user_key", F.aggregate("rows", empty, advance).alias("state"))
    return state.select("user_key", *[(F.get("state", F.lit(i))["reached"] - F.get("state", F.lit(i))["start"]).alias(f"d{i + 1}") for i in range(steps)])


def funnel(facts: DataFrame, q: Funnel, sampled: Sampled | None = None, fold: bool = False, rollup: DataFrame | None = None) -> DataFrame:
    """``step, event, users, conversion_from_previous, conversion_from_start, median_seconds_from_start``.

    Users are scaled by the threshold that was stored with the facts (or their ``rollup``), unless ``sampled`` names one."""
    q.checked()
    upto = q.days.end + dt.timedelta(days=1, seconds=q.window_seconds)
    threshold, scale = scaling(facts, q.project, Days(q.days.start, upto), list(q.steps), sampled, rollup)
    k = len(q.steps)
    rows = last_of_first_steps(step_rows(facts, q, threshold))
    users = (levels_by_fold if fold else levels)(rows, k, q.window_seconds * 1000)
    each = users.select(F.posexplode(F.array(*[f"d{i}" for i in range(1, k + 1)])).alias("step", "d"))
    counts = value_counts(each.withColumn("step", F.col("step") + 1), ["step"], "d")
    found = upper_median(counts, ["step"])
    names = facts.sparkSession.createDataFrame([(i + 1, s) for i, s in enumerate(q.steps)], "step int, event string")
    scaled = names.join(F.broadcast(found), "step", "left").select("step", "event", F.bround(F.coalesce("n", F.lit(0)) * scale).cast("long").alias("users"), "median")
    order = Window.orderBy("step")  # at most eight rows
    previous, first = F.lag("users").over(order), F.first("users").over(order)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    answer = scaled.select(
        "step", "event", "users",
        F.when(F.col("step") == 1, 1.0).otherwise(ratio(F.col("users"), previous)).alias("conversion_from_previous"),
        ratio(F.col("users"), first).alias("conversion_from_start"),
        F.when(F.col("step") > 1, F.col("median") / 1000).alias("median_seconds_from_start"),
    )
    return answer.orderBy("step")
