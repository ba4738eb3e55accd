import datetime as dt
import random

import pytest

from rillmark.operators.facts import FACT_SCHEMA
from rillmark.operators.funnel import funnel
from rillmark.operators.segment import segment
from rillmark.plans.requests import Days, Funnel, PropertyFilter, Segment

DAY = dt.date(2026, 3, 2)
T0 = dt.datetime(2026, 3, 2)
STEPS = ("page_view", "signup", "activate", "purchase")


def fact(user, name, at, n, properties=None, late=False):
    return ("p", name, user, at, f"m{n}", str(user), "", 1, properties or {}, at + (dt.timedelta(hours=3) if late else dt.timedelta(0)), late, 10_000, user % 10_000)


def facts(spark, rows):
    return spark.createDataFrame(rows, FACT_SCHEMA)


def naive(events, steps, start, end, window):
    """Level times of one user: (start, reached) per level, the plain way."""
    state = [None] * len(steps)
    for t, name in sorted(events, key=lambda e: (e[0], steps.index(e[1]) if e[1] in steps else 99)):
        if name not in steps or t < start:
            continue
        i = steps.index(name)
        if i == 0:
            if t < end:
                state[0] = (t, t)
        elif state[i - 1] and t <= state[i - 1][0] + window:
            state[i] = (state[i - 1][0], t)
    return state


@pytest.fixture(scope="module")
def random_events():
    rng = random.Random(20)
    users = {}
    for u in range(400):
        times = rng.sample(range(27 * 3_600_000), rng.randint(1, 29))
        users[u] = [(t, rng.choice([*STEPS, "noise"])) for t in times]
    return users


@pytest.mark.parametrize("fold", [False, True])
def test_levels_and_medians_equal_the_plain_model(spark, random_events, fold):
    rows = [fact(u, n, T0 + dt.timedelta(milliseconds=t), f"{u}-{t}") for u, es in random_events.items() for t, n in es]
    got = funnel(facts(spark, rows), Funnel(STEPS, Days(DAY, DAY), 4 * 3_600, project="p"), fold=fold).orderBy("step").collect()
    states = [naive(es, list(STEPS), 0, 86_400_000, 4 * 3_600_000) for es in random_events.values()]
    for i, row in enumerate(got):
        spans = sorted(s[i][1] - s[i][0] for s in states if s[i])
        assert row["users"] == len(spans)
        if i:
            assert row["median_seconds_from_start"] == spans[len(spans) // 2] / 1000
            assert row["conversion_from_previous"] == row["users"] / got[i - 1]["users"]
    assert got[0]["users"] > 100 and got[0]["median_seconds_from_start"] is None and got[0]["conversion_from_previous"] == 1.0


def test_copies_change_nothing(spark):
    rows = []
    for u in range(50):
        at = T0 + dt.timedelta(minutes=u)
        rows += [
            fact(u, "page_view", at, f"a{u}"), fact(u, "signup", at + dt.timedelta(minutes=5), f"b{u}"),
            fact(u, "purchase", at + dt.timedelta(minutes=9), f"c{u}", {"currency": ("USD", "EUR", "TRY")[u % 3], "amount": str(10.0 * (u + 1))}),
        ]
    copies = [r[:9] + (r[9] + dt.timedelta(hours=3), True) + r[11:] for r in rows]
    q = Funnel(("page_view", "signup", "purchase"), Days(DAY, DAY), 3_600, project="p")
    for table in (facts(spark, rows), facts(spark, rows + copies)):
        last = funnel(table, q).where("step = 3").first()
        assert (last["users"], last["median_seconds_from_start"]) == (50, 540.0)
        eur = segment(table, Segment(Days(DAY, DAY), "purchase", (PropertyFilter("currency", "eq", ("EUR",)),), project="p")).collect()
        assert [(r["events"], r["users"]) for r in eur] == [(17, 17)]
        large = segment(table, Segment(Days(DAY, DAY), "purchase", (PropertyFilter("amount", "gt", ("250",)),), project="p")).collect()
        assert [r["events"] for r in large] == [25]


def test_no_users_at_all(spark):
    got = funnel(facts(spark, []), Funnel(("a", "b"), Days(DAY, DAY), 60, project="p")).orderBy("step").collect()
    assert [(r["users"], r["conversion_from_previous"], r["conversion_from_start"]) for r in got] == [(0, 1.0, 0.0), (0, 0.0, 0.0)]


def test_window_is_inclusive_and_first_step_restarts(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [fact(1, "a", at(0), 1), fact(1, "b", at(60), 2), fact(2, "a", at(0), 3), fact(2, "b", at(61), 4), fact(3, "a", at(0), 5), fact(3, "a", at(30), 6), fact(3, "b", at(80), 7)]
    got = funnel(facts(spark, rows), Funnel(("a", "b"), Days(DAY, DAY), 60, project="p")).where("step = 2").first()
    assert (got["users"], got["median_seconds_from_start"]) == (2, 60.0)
