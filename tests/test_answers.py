import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from rillmark.operators.facts import FACT_SCHEMA
from rillmark.operators.funnel import funnel, last_of_first_steps, levels
from rillmark.operators.retention import retention_by_join, retention_from_events, retention_from_rollup
from rillmark.operators.rollup import month_masks
from rillmark.operators.segment import late_events, segment
from rillmark.plans.requests import Days, Funnel, Retention, Sampled, Segment, Sessions
from rillmark.sources.answers import Answers, facts_by_user
from rillmark.sources.store import EventStore

D0 = dt.date(2026, 1, 30)


def fact(user, name, at, n=0, late=False, threshold=10_000, arrives=0):
    return ("p", name, user, at, f"{user}-{name}-{at}-{n}", f"u{user}", "", 1, {}, at + dt.timedelta(hours=3 if late else 0, seconds=arrives), late, threshold, user % 10_000)


def at(days, hour=9, minute=0):
    return dt.datetime.combine(D0, dt.time(hour, minute)) + dt.timedelta(days=days)


def plan(df, mode="formatted"):
    jvm = df.sparkSession._jvm
    return df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- scaling without being told ---


@pytest.fixture(scope="module")
def halved(spark):
    """Users of the lower half of the buckets only, as a rate of one half stores them."""
    data = []
    for u in range(0, 10_000, 715):
        if u % 10_000 < 5_000:
            data += [fact(u, "signup", at(0), threshold=5_000), fact(u, "buy", at(0, 10), threshold=5_000), fact(u, "buy", at(2, 10), threshold=5_000)]
    return spark.createDataFrame(data, FACT_SCHEMA)


def test_answers_are_scaled_by_the_stored_threshold(halved):
    n = halved.select("user_key").distinct().count()
    q = Funnel(("signup", "buy"), Days(D0, D0), 86_400, project="p")
    assert [r["users"] for r in funnel(halved, q).collect()] == [2 * n, 2 * n] and [r["users"] for r in funnel(halved, q, Sampled()).collect()] == [n, n]
    q = Retention("signup", "buy", Days(D0, D0), 2, project="p")
    for got in (retention_from_events(halved, q), retention_from_rollup(month_masks(halved), q), retention_by_join(halved, q), retention_from_events(halved, q, rollup=month_masks(halved))):
        assert [(r["users"], r["retained"]) for r in got.collect()] == [(2 * n, 2 * n), (2 * n, 0), (2 * n, 2 * n)]
    got = segment(halved, Segment(Days(D0, D0), "buy", project="p")).collect()
    assert [(r["events"], r["users"]) for r in got] == [(2 * n, 2 * n)]


def test_the_threshold_is_that_of_the_months_and_events_of_the_query(spark):
    data = [fact(1, "signup", at(0)), fact(1, "buy", at(0, 10)), fact(6_000, "signup", at(0)), fact(2, "view", at(0), threshold=1_000), fact(2, "buy", at(-40), threshold=2_000), fact(3, "signup", at(0), threshold=10, late=True)]
    table = spark.createDataFrame(data, FACT_SCHEMA)
    users = lambda *steps: [r["users"] for r in funnel(table, Funnel(steps, Days(D0, D0), 60, project="p")).collect()]
    assert users("signup", "buy") == [2, 0] and users("signup", "view") == [10, 0]  # user 1 stands for ten of them; the others lie above the threshold
    everything = segment(table, Segment(Days(D0, D0), project="p")).collect()
    assert [(r["events"], r["users"]) for r in everything] == [(3 + 10, 20)]
    assert plan(segment(table, Segment(Days(D0, D0), project="p"))).count("Subquery") >= 1


# --- masks ---


@pytest.mark.parametrize(("start", "days", "follow"), [(0, 1, 1), (3, 30, 7), (-2, 150, 63), (5, 190, 62), (-20, 60, 55), (1, 55, 56)])
def test_masks_equal_the_join_on_random_visits(spark, start, days, follow):
    rng = random.Random(days)
    data = [fact(u, rng.choice(["in", "back", "else"]), at(rng.randint(-30, 290), rng.randint(0, 23)), n) for u in range(120) for n in range(rng.randint(1, 25))]
    table = spark.createDataFrame(data, FACT_SCHEMA)
    first = D0 + dt.timedelta(days=start)
    for back in ("back", "in"):
        q = Retention("in", back, Days(first, first + dt.timedelta(days=days - 1)), follow, project="p")
        wanted = rows(retention_by_join(table, q))
        assert rows(retention_from_events(table, q)) == wanted and rows(retention_from_rollup(month_masks(table), q)) == wanted


def test_retention_builds_no_arrays_of_days(spark, halved):
    q = Retention("signup", "buy", Days(D0, D0), 30, project="p")
    for df in (retention_from_events(halved, q, Sampled()), retention_from_rollup(month_masks(halved), q, Sampled())):
        text = plan(df)
        assert "collect_set" not in text and "sequence(" not in text and "lambda" not in text and "bit_or" in text


# --- runs of first steps ---


def test_runs_of_first_steps_are_cut_and_levels_stay(spark):
    rng = random.Random(3)
    data = [(u, rng.randint(0, 400), rng.choice([1, 1, 1, 1, 2, 3])) for u in range(200) for _ in range(rng.randint(1, 30))]
    table = spark.createDataFrame(data, "user_key long, t long, step int")
    cut = last_of_first_steps(table)
    assert cut.count() < 0.7 * len(data)
    order = lambda df: sorted(rows(df), key=repr)
    assert order(levels(cut, 3, 60)) == order(levels(table, 3, 60))


# --- over a store ---


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    from rillmark.operators.normalize import SCHEMA

    rng = random.Random(12)
    data = [fact(u, rng.choice(["signup", "buy", "view"]), at(rng.randint(0, 5), rng.randint(0, 23), rng.randint(0, 59)), n, late=rng.random() < 0.1) for u in range(60) for n in range(12)]
    table = spark.createDataFrame(data, FACT_SCHEMA)
    more = {"status": F.lit("accepted"), "reason": F.lit(None).cast("string"), "payload": F.lit(None).cast("string"), "quarantine_id": F.lit(None).cast("string"), "pos": F.lit(0).cast("long")}
    batch = table.withColumns(more).select(*[f.split()[0] for f in SCHEMA.split(", ")])
    store = EventStore(spark, str(tmp_path_factory.mktemp("answers") / "s"))
    store.load(batch, 0)
    store.load(batch.withColumn("received_at", F.expr("received_at + interval 4 hours")).withColumn("is_late", F.lit(True)), 1)  # copies
    return store, table, batch


def test_compacted_days_hold_one_row_per_identity_and_are_not_searched(stored):
    store, table, batch = stored
    days = Days(D0, D0 + dt.timedelta(days=5))
    q = Segment(days, project="p")
    wanted, late = rows(segment(table, q)), late_events(table, q).first()[0]
    answers = Answers(store)
    assert "Window" in plan(answers.segment(q)) and rows(answers.segment(q)) == wanted
    assert store.facts().count() == 2 * table.count()
    store.compact("facts")
    assert store.facts().count() == table.count() and len(store.facts_of(days)[1]) == 6
    found = answers.segment(q)
    assert "Window" not in plan(found) and "message_id" not in plan(found).split("Exchange")[-1] and rows(found) == wanted
    assert answers.late_events(q).first()[0] == late
    # A copy that comes afterwards makes its day one to be searched again, and no other.
    store.load(batch.where(F.to_date("ts") == F.lit(D0)).withColumn("received_at", F.expr("received_at + interval 5 hours")), 2)
    assert len(store.facts_of(days)[1]) == 5 and rows(answers.segment(q)) == wanted and "Window" in plan(answers.segment(q))
    assert "Window" not in plan(answers.segment(Segment(Days(D0 + dt.timedelta(days=1), days.end), project="p")))
    assert store.compact("facts") == 1 and "Window" not in plan(answers.segment(q)) and rows(answers.segment(q)) == wanted


def test_answers_follow_the_named_source_and_read_only_their_days(stored):
    store, table, _ = stored
    answers, days = Answers(store), Days(D0, D0 + dt.timedelta(days=2))
    q = Retention("signup", "buy", days, 2, project="p")
    wanted = rows(retention_by_join(table, q))
    for source in ("rollup", "events"):
        got = answers.retention(Retention("signup", "buy", days, 2, source, project="p"))
        assert rows(got) == wanted
        paths = {f.split("/s/")[1].split("/")[0] for f in got.inputFiles()}
        assert paths == ({"rollup"} if source == "rollup" else {"facts", "rollup"}) or paths == {"facts"}
    one_day, _ = store.facts_of(Days(D0, D0))
    assert one_day.inputFiles() and all(f"day={D0}" in f for f in one_day.inputFiles())
    assert rows(answers.funnel(Funnel(("signup", "buy"), days, 3_600, project="p"))) == rows(funnel(table, Funnel(("signup", "buy"), days, 3_600, project="p")))
    store.sessionize()
    assert answers.sessions(Sessions(days, project="p")).count() == 3 and answers.sampling("p", days) == Sampled()


def test_facts_by_user_need_no_exchange_by_user(stored):
    store, table, _ = stored
    name = f"by_user_{uuid.uuid4().hex}"
    by_user, days = facts_by_user(store, name, buckets=4), Days(D0, D0 + dt.timedelta(days=5))
    assert by_user.count() == table.count()
    f, r = Funnel(("signup", "buy"), days, 7_200, project="p"), Retention("signup", "buy", days, 3, project="p")
    for make in (lambda t: funnel(t, f, Sampled()), lambda t: retention_from_events(t, r, Sampled())):
        assert rows(make(by_user)) == rows(make(table))
        assert "hashpartitioning(user_key" in plan(make(table)) and "hashpartitioning(user_key" not in plan(make(by_user))
    store.spark.sql(f"DROP TABLE {name}")


# --- order of answers ---


def test_answers_come_in_order(spark, halved):
    q = Retention("signup", "buy", Days(D0 - dt.timedelta(days=9), D0), 5, project="p")
    got = [(r["day"], r["k"]) for r in retention_from_events(halved.unionByName(halved.withColumn("ts", F.expr("ts - interval 4 days")).withColumn("user_key", F.col("user_key") + 1)), q).collect()]
    assert got == sorted(got) and len(got) == 12
    days = [r["day"] for r in segment(halved, Segment(Days(D0, D0 + dt.timedelta(days=9)), project="p")).collect()]
    assert days == sorted(days) and len(days) == 2
    steps = [r["step"] for r in funnel(halved, Funnel(("a", "b", "signup", "buy"), Days(D0, D0), 60, project="p")).collect()]
    assert steps == [1, 2, 3, 4]


# --- layout ---


def test_files_are_sorted_by_their_keys(stored):
    store, _, _ = stored
    store.compact("facts", 1)
    for day, batches in store.state()["tables"]["facts"].items():
        for file in store.spark.read.parquet(f"{store.root}/facts/batch={batches[0]}/day={day}").inputFiles():
            keys = [tuple(r) for r in store.spark.read.parquet(file).select("project_id", "event_name", "user_key", "ts").collect()]
            assert keys == sorted(keys)


def test_a_large_day_is_compacted_by_several_tasks_in_one_exchange(spark, tmp_path, monkeypatch):
    from rillmark.operators.normalize import SCHEMA
    from rillmark.sources import store as module

    rng = random.Random(5)
    data = [fact(u, rng.choice(["signup", "buy"]), at(0 if n else 1, rng.randint(0, 23), rng.randint(0, 59)), n, late=rng.random() < 0.2) for u in range(200) for n in range(10)]
    more = {"status": F.lit("accepted"), "reason": F.lit(None).cast("string"), "payload": F.lit(None).cast("string"), "quarantine_id": F.lit(None).cast("string"), "pos": F.lit(0).cast("long")}
    table = spark.createDataFrame(data, FACT_SCHEMA)
    batch = table.withColumns(more).select(*[f.split()[0] for f in SCHEMA.split(", ")])
    store, plans = EventStore(spark, str(tmp_path / "s")), []
    for n in range(3):  # copies, the earliest of which come in the middle
        store.load(batch.withColumn("received_at", F.col("received_at") + F.expr(f"interval {(n - 1) ** 2} hours")).withColumn("is_late", F.col("is_late") | F.lit(n != 1)), n)
    write = store._write
    monkeypatch.setattr(module, "SLOT_BYTES", 8_000)
    monkeypatch.setattr(store, "_write", lambda name, df, batch: (plans.append(plan(df, "simple")), write(name, df, batch))[1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # it joins tasks as small as these
    try:
        assert store.compact("facts") == 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert plans[0].count("Exchange") == 1 and plans[0].count("Sort ") <= 2
    columns = [c for c in table.columns if c != "properties"]
    assert sorted(rows(store.facts().select(*columns))) == sorted(rows(table.select(*columns)))
    (name,) = store.state()["tables"]["facts"][D0.isoformat()]
    files = [spark.read.parquet(str(f)).count() for f in (tmp_path / "s" / "facts" / f"batch={name}" / f"day={D0}").glob("*.parquet")]
    assert len(files) > 1 and sum(files) == 1_800


def test_the_layout_of_sessions_changes_once_and_all_days_are_made_again(stored):
    store, table, _ = stored
    store.sessionize()
    before = sorted(map(tuple, store.sessions().collect()), key=repr)
    store._commit(lambda state: state | {"steps": [1, 2]})  # a store of the older layout
    assert store.bootstrap() == [3] and store.sessions().count() == 0
    assert store.sessionize() == 6 and sorted(map(tuple, store.sessions().collect()), key=repr) == before
    assert store.bootstrap() == [] and store.sessionize() == 0
