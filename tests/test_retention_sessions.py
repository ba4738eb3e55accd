import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rillmark.functions.stats import upper_median, value_counts
from rillmark.operators.facts import FACT_SCHEMA
from rillmark.operators.retention import retained_arrays, retention_by_join, retention_from_events, retention_from_rollup
from rillmark.operators.rollup import merged, month_masks
from rillmark.operators.sampling import sampling_for
from rillmark.operators.sessions import sessions, sessions_by_window, sessions_daily
from rillmark.plans.requests import Days, Retention, Sessions
from rillmark.sources.store import expired

D0 = dt.date(2026, 1, 30)


def fact(user, name, at, late=False, threshold=10_000):
    return ("p", name, user, at, f"{user}-{name}-{at}", f"u{user}", "", 1, {}, at + dt.timedelta(hours=3 if late else 0), late, threshold, user % 10_000)


def day(n, hour=9):
    return dt.datetime.combine(D0, dt.time(hour)) + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def visits(spark):
    a, b, c, d = 1, 2, 3, 4
    rows = [fact(u, "signup", day(0)) for u in (a, b, c)] + [fact(d, "signup", day(1)), fact(d, "signup", day(2))]
    rows += [fact(a, "view", day(1)), fact(b, "view", day(1)), fact(b, "view", day(1, 12)), fact(b, "view", day(3)), fact(d, "view", day(2)), fact(c, "view", day(1), late=True)]
    return spark.createDataFrame(rows, FACT_SCHEMA)


def test_retention_is_the_same_from_everywhere(visits):
    q = Retention("signup", "view", Days(D0, D0 + dt.timedelta(days=1)), 3, project="p")
    half = visits.where("user_key < 3").unionByName(visits)  # copies
    masks = month_masks(visits)
    for got in (retention_from_events(visits, q), retention_from_events(half, q), retention_from_rollup(merged(masks), q), retention_from_rollup(masks.unionByName(month_masks(half)), q), retention_by_join(visits, q)):
        rows = {r["day"]: (r["users"], r["retained"]) for r in retained_arrays(got).collect()}
        assert rows == {D0: (3, [0, 2, 0, 1]), D0 + dt.timedelta(days=1): (1, [0, 1, 0, 0])}


def test_mask_of_the_31st_is_positive_and_merging_twice_changes_nothing(spark):
    rows = spark.createDataFrame([fact(1, "x", dt.datetime(2026, 1, 31)), fact(1, "x", dt.datetime(2026, 1, 1))], FACT_SCHEMA)
    once = merged(month_masks(rows))
    assert once.first()["days"] == (1 << 30) + 1
    assert merged(once.unionByName(once)).collect() == once.collect()


def test_sampling_threshold_comes_from_the_rollup(spark):
    rows = spark.createDataFrame([fact(1, "x", day(0), threshold=2_500), fact(2, "y", day(0))], FACT_SCHEMA)
    masks = month_masks(rows)
    days = Days(D0, D0)
    assert sampling_for(masks, "p", days).threshold == 2_500
    assert sampling_for(masks, "p", days, ["y"]).threshold == 10_000
    assert not sampling_for(masks, "p", days, ["none"]).is_estimate
    assert sampling_for(masks, "p", days, ["x"]).scale == 4.0


def at(hour, minute):
    return dt.datetime(2026, 1, 30, hour, minute)


@pytest.mark.parametrize("build", [sessions, sessions_by_window])
def test_sessions_merge_and_late_events_do_not_bridge(spark, build):
    rows = [fact(1, "x", at(9, 0)), fact(1, "x", at(9, 10)), fact(1, "x", at(9, 50)), fact(2, "x", at(9, 5)), fact(2, "x", at(9, 33), late=True), fact(2, "x", at(10, 0))]
    got = sorted((r["user_id"], r["event_count"], (r["session_end"] - r["session_start"]).seconds) for r in build(spark.createDataFrame(rows, FACT_SCHEMA)).collect())
    assert got == [("u1", 1, 0), ("u1", 2, 600), ("u2", 1, 0), ("u2", 1, 0)]
    bridged = build(spark.createDataFrame([*rows, fact(1, "x", at(9, 30))], FACT_SCHEMA))
    assert sorted((r["user_id"], r["event_count"]) for r in bridged.collect()) == [("u1", 4), ("u2", 1), ("u2", 1)]
    daily = sessions_daily(bridged, Sessions(Days(D0, D0), project="p")).first()
    assert (daily["sessions"], daily["users"], daily["median_duration_seconds"], daily["events_per_session"]) == (3, 2, 0.0, 2.0)


def test_gap_of_exactly_half_an_hour_stays_and_midnight_cuts(spark):
    night = dt.datetime(2026, 1, 30, 23, 50)
    rows = [fact(1, "x", at(9, 0)), fact(1, "x", at(9, 30)), fact(2, "x", at(9, 0)), fact(2, "x", at(9, 30) + dt.timedelta(milliseconds=1)), fact(3, "x", night), fact(3, "x", night + dt.timedelta(minutes=20))]
    got = sessions(spark.createDataFrame(rows, FACT_SCHEMA)).groupBy("user_id").count().collect()
    assert {r["user_id"]: r["count"] for r in got} == {"u1": 1, "u2": 2, "u3": 2}


def test_copies_are_searched_where_the_sessions_are_made(spark):
    rng = random.Random(8)
    first = [fact(rng.randint(0, 9), rng.choice("xy"), at(0, 0) + dt.timedelta(days=rng.randint(0, 2), minutes=20 * rng.randint(0, 60)), late=rng.random() < 0.3) for _ in range(400)]
    first = list({row[:5]: row for row in first}.values())
    copies = [(*row[:9], row[9] + dt.timedelta(hours=rng.randint(4, 9)), not row[10], *row[11:]) for row in first if rng.random() < 0.6]
    copied = [row for row in first + copies if row[3].date() != at(0, 0).date()] + [row for row in first if row[3].date() == at(0, 0).date()]
    rng.shuffle(copied)
    wanted, own = [], {}
    for row in first:
        if not row[10]:
            own.setdefault((row[3].date(), row[2]), []).append(row[3])
    for (day, user), times in own.items():
        times, starts = sorted(times), []
        for i, t in enumerate(times):
            starts += [i] if not i or t - times[i - 1] > dt.timedelta(minutes=30) else []
        wanted += [("p", day, user, f"u{user}", times[i], times[j - 1], j - i) for i, j in zip(starts, [*starts[1:], len(times)], strict=True)]
    table = spark.createDataFrame(copied, FACT_SCHEMA)
    for found in (sessions(table), sessions(table.withColumn("day", F.to_date("ts")), single=[at(0, 0).date()]), sessions_by_window(table)):
        assert sorted(map(tuple, found.select("project_id", "day", "user_key", "user_id", "session_start", "session_end", "event_count").collect())) == sorted(wanted)
    jvm = spark._jvm.org.apache.spark.sql.execution.ExplainMode
    for rows in (table, table.withColumn("project_id", F.lit("p"))):
        assert sessions(rows)._jdf.queryExecution().explainString(jvm.fromString("simple")).count("Exchange") == 1


@pytest.mark.parametrize("n", [1, 2, 3, 10, 77])
def test_upper_median_is_the_element_at_half(spark, n):
    values = [(i * 7919) % 1_000_003 * 1000 for i in range(n)]
    rows = spark.createDataFrame([("k", v) for v in values], "g string, v long")
    assert upper_median(value_counts(rows, ["g"], "v"), ["g"]).first()["median"] == sorted(values)[n // 2]
    assert upper_median(value_counts(rows, [], "v"), []).first()["median"] == sorted(values)[n // 2]


def test_expiry(spark, visits):
    now = dt.datetime(2026, 5, 1)
    assert expired("facts", visits, now).count() == visits.where("ts >= '2026-01-31'").count()
    assert expired("rollup", month_masks(visits), now).count() == month_masks(visits).count()
