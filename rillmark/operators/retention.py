"""N-day retention from one aggregation per user, on day masks; no join of cohorts and returns.

The days of a query, at most 256, are numbered from its first one and held in words of ``WORD`` bits:
one mask of start days and one of return days a user, both by ``bit_or``, so that copies and unmerged
rollup rows change nothing.  A user's cohort is the lowest start bit; the return mask shifted down by
it has bit k set for a return k days later, and the cohorts add these bits up one by one.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.requests import Days, Retention, Sampled
from .facts import in_order, of_project, on_days
from .sampling import scaling

#: Bits a word: fewer than 63, so that a word is never negative.
WORD = 56


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _left(value: Column, by: Column | int) -> Column:
    return F.call_function("shiftleft", value, F.lit(by) if isinstance(by, int) else by)


def _right(value: Column, by: Column | int) -> Column:
    return F.call_function("shiftrightunsigned", value, F.lit(by) if isinstance(by, int) else by)


def moved(mask: Column, at: Column, bits: int, word: int) -> Column:
    """Word ``word`` of a mask of ``bits`` days whose bit 0 is day ``at`` of the frame (which may lie before it)."""
    shift = at - word * WORD
    upper = mask.bitwiseAND(_right(_long((1 << bits) - 1), F.greatest(shift + bits - WORD, F.lit(0))))  # else bits leave at the top
    return F.when((shift >= 0) & (shift < WORD), _left(upper, shift)).when((shift < 0) & (shift > -bits), _right(mask, -shift).bitwiseAND(_long((1 << WORD) - 1))).otherwise(_long(0))


def lowest(words: list[Column]) -> Column:
    """Number of the lowest bit that is set, null if none is."""
    found = F.lit(None).cast("int")
    for k, word in reversed(list(enumerate(words))):
        found = F.when(word != 0, F.bit_count(F.bitwise_not(word).bitwiseAND(word - 1)) + k * WORD).otherwise(found)
    return found


def later(words: list[Column], first: Column, follow: int) -> Column:
    """The mask moved down by ``first``: bits 0 to ``follow`` (at most 63)."""
    found = _long(0)
    rest = F.pmod(first, F.lit(WORD))
    for k in range(len(words)):
        own = _right(words[k], rest)
        for more, j in ((1, k + 1), (2, k + 2)):
            if j < len(words):
                by = F.lit(more * WORD) - rest
                own = own.bitwiseOR(F.when(by < 64, _left(words[j], by)).otherwise(_long(0)))
        found = F.when(F.floor(first / WORD) == k, own).otherwise(found)
    return found.bitwiseAND(_long((1 << (follow + 1)) - 1 if follow < 63 else -1))


def _answer(masks: DataFrame, q: Retention, scale: Column) -> DataFrame:
    """Long form from ``s0, s1, ..`` and ``r0, r1, ..`` of each user."""
    n = _words(q)
    cohort = masks.select(lowest([F.col(f"s{k}") for k in range(n)]).alias("first"), *[f"r{k}" for k in range(n)]).where("first is not null")
    back = cohort.select("first", later([F.col(f"r{k}") for k in range(n)], F.col("first"), q.follow).alias("later"))
    bit = lambda k: _right(F.col("later"), k).bitwiseAND(_long(1))
    sums = back.groupBy("first").agg(F.count("*").alias("users"), *[F.sum(bit(k)).alias(f"k{k}") for k in range(q.follow + 1)])
    scaled = lambda c: F.bround(c * scale).cast("long")
    each = sums.select("first", "users", F.posexplode(F.array(*[f"k{k}" for k in range(q.follow + 1)])).alias("k", "retained"))  # a row for each cohort and day
    return in_order(each.select(F.date_add(F.lit(q.days.start), F.col("first")).alias("day"), "k", scaled(F.col("users")).alias("users"), scaled(F.col("retained")).alias("retained")), "day", "k")


def _last(q: Retention) -> dt.date:
    return q.days.end + dt.timedelta(days=q.follow)


def _words(q: Retention) -> int:
    return -(-((_last(q) - q.days.start).days + 1) // WORD)


def _cut(k: int, days: int) -> int:
    """The bits of word ``k`` that lie in the first ``days`` days."""
    return (1 << max(0, min(WORD, days - k * WORD))) - 1


def _masks(rows: DataFrame, q: Retention, word) -> DataFrame:
    """One row a user; ``word(k)`` gives word k of a row's days."""
    name, cohorts, all_days = F.col("event_name"), (q.days.end - q.days.start).days + 1, (_last(q) - q.days.start).days + 1
    own = rows.select("user_key", (name == q.start_event).alias("starts"), (name == q.return_event).alias("returns"), *[word(k).alias(f"w{k}") for k in range(_words(q))])
    held = lambda flag, k, days: F.coalesce(F.bit_or(F.when(F.col(flag), F.col(f"w{k}").bitwiseAND(_long(_cut(k, days))))), _long(0))
    return own.groupBy("user_key").agg(*[held("starts", k, cohorts).alias(f"s{k}") for k in range(_words(q))], *[held("returns", k, all_days).alias(f"r{k}") for k in range(_words(q))])


def _scaling(table: DataFrame, q: Retention, sampled: Sampled | None, rollup: DataFrame | None = None) -> tuple[Column, Column]:
    return scaling(table, q.project, Days(q.days.start, _last(q)), [q.start_event, q.return_event], sampled, rollup)


def retention_from_events(facts: DataFrame, q: Retention, sampled: Sampled | None = None, rollup: DataFrame | None = None) -> DataFrame:
    """``day, k, users, retained`` straight from the facts; needs no deduplication.

    Users are scaled by the threshold that was stored with the facts (or their ``rollup``), unless ``sampled`` names one."""
    q.checked()
    threshold, scale = _scaling(facts, q, sampled, rollup)
    rows = on_days(of_project(facts, q.project), Days(q.days.start, _last(q))).where(F.col("event_name").isin(q.start_event, q.return_event))
    rows = rows.where(~F.col("is_late") & (F.col("sample_bucket") < threshold)).withColumn("at", F.datediff(F.to_date("ts"), F.lit(q.days.start)))
    return _answer(_masks(rows, q, lambda k: moved(_long(1), F.col("at"), 1, k)), q, scale)


def retention_from_rollup(rollup: DataFrame, q: Retention, sampled: Sampled | None = None) -> DataFrame:
    """The same from month masks: a user has at most one row per event and month (more while unmerged)."""
    q.checked()
    threshold, scale = _scaling(rollup, q, sampled)
    rows = of_project(rollup, q.project).where(F.col("event_name").isin(q.start_event, q.return_event) & (F.col("sample_bucket") < threshold))
    rows = rows.where(F.col("month").between(F.lit(q.days.start.replace(day=1)), F.lit(_last(q)))).withColumn("at", F.datediff("month", F.lit(q.days.start)))
    return _answer(_masks(rows, q, lambda k: moved(F.col("days"), F.col("at"), 31, k)), q, scale)


def retention(facts: DataFrame, rollup: DataFrame, q: Retention, sampled: Sampled | None = None) -> DataFrame:
    """From the source that the request names."""
    return retention_from_rollup(rollup, q, sampled) if q.source == "rollup" else retention_from_events(facts, q, sampled, rollup)


def retention_by_join(facts: DataFrame, q: Retention, sampled: Sampled | None = None) -> DataFrame:
    """The older formulation, cohorts joined to distinct return days; a cross-check."""
    q.checked()
    threshold, scale = _scaling(facts, q, sampled)
    name, day = F.col("event_name"), F.to_date("ts")
    rows = on_days(of_project(facts, q.project), Days(q.days.start, _last(q))).where(~F.col("is_late") & (F.col("sample_bucket") < threshold))
    cohorts = rows.where((name == q.start_event) & (day <= F.lit(q.days.end))).groupBy("user_key").agg(F.min(day).alias("cohort"))
    returns = rows.where(name == q.return_event).select("user_key", day.alias("d")).distinct()
    hits = cohorts.join(returns, "user_key").select("cohort", F.datediff("d", "cohort").alias("k")).where(F.col("k").between(0, q.follow)).groupBy("cohort", "k").agg(F.count("*").alias("hits"))
    grid = cohorts.groupBy("cohort").agg(F.count("*").alias("users")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(q.follow))))
    scaled = lambda c: F.bround(c * scale).cast("long")
    answer = grid.join(hits, ["cohort", "k"], "left").select(F.col("cohort").alias("day"), "k", scaled(F.col("users")).alias("users"), scaled(F.coalesce("hits", F.lit(0))).alias("retained"))
    return in_order(answer, "day", "k")


def retained_arrays(long_form: DataFrame) -> DataFrame:
    """``day, users, retained`` with one array per cohort, ordered by k."""
    pairs = F.sort_array(F.collect_list(F.struct("k", "retained")))
    return in_order(long_form.groupBy("day", "users").agg(pairs["retained"].alias("retained")), "day")
