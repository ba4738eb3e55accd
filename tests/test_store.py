import datetime as dt
import json

from pyspark.sql import functions as F

from rillmark.operators.facts import dedup_earliest
from rillmark.operators.normalize import ingest
from rillmark.sources.generate import demo_snapshot, raw_events
from rillmark.sources.store import EventStore
from rillmark.streaming.loader import file_source, lag, start


def answers(store):
    store.sessionize()
    facts = dedup_earliest(store.facts().drop("properties")).groupBy("event_name").count().collect()
    rollup = store.rollup().agg(F.sum("days"), F.count("*")).first()
    sessions = store.sessions().agg(F.count("*"), F.sum("event_count")).first()
    return sorted(map(tuple, facts)), tuple(rollup), tuple(sessions), store.quarantine().count()


def test_batches_load_once_and_compaction_changes_nothing(spark, sf_dir, tmp_path):
    raw = raw_events(spark, sf_dir)
    rows = ingest(raw, demo_snapshot()).persist()
    one = EventStore(spark, str(tmp_path / "one"))
    one.load(rows, 0)
    two = EventStore(spark, str(tmp_path / "two"))
    first, second = rows.where("pos % 2 = 0"), rows.where("pos % 2 = 1")
    two.load(first, 0)
    two.load(second, 1)
    two.load(second, 1)  # the same batch again
    two.load(first, 2)  # delivered twice
    assert answers(one)[:3] == answers(two)[:3]
    before = answers(two)
    for name in ("rollup", "facts", "quarantine"):
        assert two.compact(name) > 0 and two.compact(name) == 0
        assert answers(two) == before
    assert two.vacuum(dt.timedelta(days=1)) == 0
    assert two.vacuum(dt.timedelta(0)) > 0 and answers(two) == before
    two.expire(dt.datetime(2024, 4, 15))
    assert two.facts().agg(F.min("day")).first()[0] >= dt.date(2024, 1, 16)
    assert two.sessions().agg(F.min("day")).first()[0] >= dt.date(2024, 1, 16)
    assert two.quarantine().agg(F.min("received_at")).first()[0] is None and two.rollup().count() == before[1][1]
    two.expire(dt.datetime(2026, 3, 1))
    assert two.rollup().count() == 0
    rows.unpersist()


def test_crash_between_tables_is_repaired_by_the_next_try(spark, sf_dir, tmp_path):
    rows = ingest(raw_events(spark, sf_dir), demo_snapshot()).where("pos < 300").persist()
    store = EventStore(spark, str(tmp_path / "s"))
    rows.where("status = 'accepted'").limit(5).select("user_key", F.to_date("ts").alias("day")).write.partitionBy("day").parquet(str(tmp_path / "s" / "facts" / "batch=stream-0-x"))
    assert store.facts().count() == 0  # not committed
    store.load(rows, 0)
    assert store.facts().count() == rows.where("status = 'accepted'").count()
    rows.unpersist()


def test_stream_from_files_counts_every_event_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for part in range(3):
        lines = [
            {"project_id": "p-1", "raw": json.dumps({"messageId": f"m{part}-{i}", "event": "click", "userId": f"u{i}", "timestamp": "2024-01-05T10:00:00Z", "properties": {"value": 1}}),
             "received_at": "2024-01-05T10:00:05.000Z", "pos": part * 100 + i}
            for i in range(20)
        ]
        (source / f"{part}.json").write_text("\n".join(map(json.dumps, lines)))
    store = EventStore(spark, str(tmp_path / "store"))
    for _ in range(2):  # a restart finds nothing new
        query = start(file_source(spark, str(source)), store, demo_snapshot(), str(tmp_path / "checkpoint"))
        query.awaitTermination()
        assert lag(query)["behind"] is None
    assert list(store.state()["applied"].values()) == [2] and store.facts().count() == 60
    assert store.sessions().count() == 0 and store.sessionize() == 1 and store.sessions().count() == 20


def test_upkeep_between_batches_takes_no_batch_of_the_stream(spark, sf_dir, tmp_path):
    rows = ingest(raw_events(spark, sf_dir), demo_snapshot()).persist()
    store = EventStore(spark, str(tmp_path / "s"))
    halves = [rows.where(f"pos % 2 = {i}") for i in range(2)]
    want = [h.where("status = 'accepted'").count() for h in halves]
    assert store.load(halves[0], 0) and store.facts().count() == want[0]
    store.compact("rollup", 1)
    store.compact("facts", 1)
    store.expire(dt.datetime(2024, 1, 2))
    assert store.load(halves[1], 1) and store.facts().count() == sum(want)
    assert not store.load(halves[1], 1) and not store.load(halves[0], 0) and store.facts().count() == sum(want)
    rows.unpersist()


def test_a_load_reads_only_the_days_it_touches(spark, tmp_path):
    def accepted(day, n):
        lines = [("p-1", json.dumps({"messageId": f"{day}-{i}", "event": "click", "userId": f"u{i}", "timestamp": f"2024-01-{day:02d}T10:00:00Z", "properties": {"value": 1}}), dt.datetime(2024, 1, day, 10, 1), i) for i in range(n)]
        return ingest(spark.createDataFrame(lines, "project_id string, raw string, received_at timestamp, pos long"), demo_snapshot())

    store = EventStore(spark, str(tmp_path / "s"))
    for batch, day in enumerate((5, 6, 5)):
        store.load(accepted(day, 4 + batch), batch)
    tables = store.state()["tables"]
    assert [len(tables["facts"][d]) for d in ("2024-01-05", "2024-01-06")] == [2, 1]
    one_day = store.table("facts", lambda day: day == "2024-01-06")
    assert one_day.count() == 5 and all("day=2024-01-06" in f for f in one_day.inputFiles())
    assert store.sessionize() == 2 and store.sessions().count() == 6 + 5
    assert store.compact("facts", 1, lambda day: day > "2024-01-05") == 1 and store.facts().count() == 15
    assert [len(store.state()["tables"]["facts"][d]) for d in ("2024-01-05", "2024-01-06")] == [2, 1]


def test_two_writers_both_get_in(spark, sf_dir, tmp_path, monkeypatch):
    rows = ingest(raw_events(spark, sf_dir), demo_snapshot()).where("pos < 200").persist()
    store, other = (EventStore(spark, str(tmp_path / "s")) for _ in range(2))
    put, raced = store.log.put, []

    def late(number, text):
        if not raced:
            raced.append(other.load(rows.where("pos % 2 = 1"), 0, "other"))
        return put(number, text)

    monkeypatch.setattr(store.log, "put", late)
    assert store.load(rows.where("pos % 2 = 0"), 0) and raced == [True]
    alone = EventStore(spark, str(tmp_path / "t"))
    alone.load(rows, 0)
    assert answers(store)[:3] == answers(alone)[:3]
    rows.unpersist()


def delivery(spark, ids, at):
    rows = [("p-1", json.dumps({"messageId": m, "event": "click", "userId": "u", "timestamp": "2024-01-05T10:00:00Z", "properties": {"value": 1}}), at, i) for i, m in enumerate(ids)]
    return ingest(spark.createDataFrame(rows, "project_id string, raw string, received_at timestamp, pos long"), demo_snapshot())


def test_ids_accepted_lately_are_duplicates(spark, tmp_path):
    store, at = EventStore(spark, str(tmp_path / "s")), dt.datetime(2024, 1, 5, 10, 55)
    store.load(delivery(spark, ["a", "b"], at), 0)
    found = lambda ids, later, **more: {r["message_id"]: (r["status"], r["reason"]) for r in store.mark_seen(delivery(spark, ids, at + dt.timedelta(minutes=later)), **more).collect()}
    assert found(["a", "c", "b d"], 10) == {"a": ("duplicate", "already accepted"), "c": ("accepted", None), "": ("quarantined", found(["b d"], 10)[""][1])}
    assert found(["a"], 11) == {"a": ("accepted", None)} and found(["a"], 10, minutes=None) == {"a": ("accepted", None)}
    store.load(store.mark_seen(delivery(spark, ["a", "c"], at + dt.timedelta(minutes=9))), 1)
    assert store.facts().count() == 3 and found(["a"], 9)["a"][0] == "duplicate"
    store.load(delivery(spark, ["z"], at + dt.timedelta(hours=2)), 2)
    assert list(store.state()["tables"]["recent"]) == ["2024-01-05-11", "2024-01-05-12"]  # ids of 11:55 still count at 12:01


def test_ids_of_hours_that_no_list_keeps_are_not_written(spark, tmp_path):
    store, at = EventStore(spark, str(tmp_path / "s")), dt.datetime(2024, 1, 5, 10, 55)
    batch = delivery(spark, ["old"], at).unionByName(delivery(spark, ["a"], at + dt.timedelta(hours=2))).unionByName(delivery(spark, ["b"], at + dt.timedelta(minutes=130)))
    store.load(batch, 0)
    written = sorted(p.name for p in (tmp_path / "s" / "recent").glob("batch=*/hour=*"))
    assert written == ["hour=2024-01-05-12", "hour=2024-01-05-13"] and [f"hour={h}" for h in sorted(store.state()["tables"]["recent"])] == written
    assert store.facts().count() == 3


def test_rows_that_are_cheap_to_read_are_not_persisted(spark, sf_dir, tmp_path, monkeypatch):
    from rillmark.sources.canonical import facts
    from rillmark.streaming.loader import stored_facts

    kept, rows = [], delivery(spark, ["a", "b d"], dt.datetime(2024, 1, 5, 10, 55))
    persist = type(rows).persist
    monkeypatch.setattr(type(rows), "persist", lambda df, *level: (kept.append(df.columns), persist(df, *level))[1])
    stored_facts(spark, facts(spark, sf_dir))
    assert not [columns for columns in kept if "properties" in columns]
    store = EventStore(spark, str(tmp_path / "s"))
    assert store.load(rows, 0, persist=False) and (store.facts().count(), store.quarantine().count()) == (1, 1)


def test_replay_has_one_outcome_for_each_case(spark, tmp_path):
    from rillmark.operators.quarantine import find
    from rillmark.sources.registry import Property, Registry, Spec

    registry = Registry()
    registry.put_project("p-1")
    at, now = dt.datetime(2024, 1, 5, 10, 0, 5, tzinfo=dt.timezone.utc), dt.datetime(2024, 1, 6, 12, tzinfo=dt.timezone.utc)
    raw = lambda m, **more: json.dumps({"messageId": m, "event": "open", "userId": "u", "timestamp": "2024-01-05T07:00:00Z"} | more)
    rows = [("p-1", raw("a"), at, 0), ("p-1", raw("b"), at, 1), ("p-1", raw("c", properties={"x": 1}), at, 2)]
    store = EventStore(spark, str(tmp_path / "s"))
    store.load(ingest(spark.createDataFrame(rows, "project_id string, raw string, received_at timestamp, pos long"), registry.snapshot()), 0)
    ids = {r["message_id"]: r["quarantine_id"] for r in store.quarantine().collect()}
    replay = lambda m, project="p-1": store.replay(registry.snapshot(), project, ids.get(m, m), now)
    assert replay("none")[0] == replay("a", "p-2")[0] == "unknown"
    assert replay("a")[0] == "still invalid" and store.facts().count() == 0
    registry.put_schema("p-1", "open", 1, Spec({"k": Property("integer")}))
    assert replay("a") == ("accepted", None) and replay("a")[0] == "already replayed"
    fact = store.facts().first()
    assert fact["is_late"] and fact["received_at"].astimezone(dt.timezone.utc) == at and store.sessionize() == 1 and store.sessions().count() == 0
    assert find(store.quarantine(), "p-1", ids["a"])["status"] == "replayed" and store.quarantine().count() == 4
    assert "x" in replay("c")[1]
    sent = spark.createDataFrame([("p-1", raw("b", timestamp="2024-01-06T11:59:00Z"), now, 0)], "project_id string, raw string, received_at timestamp, pos long")
    store.load(ingest(sent, registry.snapshot()), 1)
    assert replay("b") == ("duplicate", "already accepted") and store.facts().count() == 2
    assert find(store.quarantine(), "p-1", ids["b"])["status"] == "replayed"


def test_bootstrap_and_views(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"))
    assert store.bootstrap() == [1, 2, 3] and store.bootstrap() == []
    store.load(delivery(spark, ["a"], dt.datetime(2024, 1, 5, 10, 1)), 0)
    store.sessionize()
    store.views("v_")
    assert spark.sql("SELECT count(*) FROM v_facts JOIN v_sessions USING (project_id, day)").first()[0] == 1
    assert spark.sql("SELECT count(*) FROM v_quarantine").first()[0] == 0 and spark.sql("SELECT days FROM v_rollup").first()[0] == 1 << 4


def test_files_written_by_the_sink_are_read_back(spark, sf_dir, tmp_path):
    from rillmark.streaming.loader import file_sink

    raw = raw_events(spark, sf_dir)
    file_sink(raw, str(tmp_path / "in"))
    store = EventStore(spark, str(tmp_path / "s"))
    start(file_source(spark, str(tmp_path / "in"), 100), store, demo_snapshot(), str(tmp_path / "c")).awaitTermination()
    assert store.facts().count() == ingest(raw, demo_snapshot()).where("status = 'accepted'").count()


def test_sessions_outside_utc_are_refused(spark, tmp_path):
    import pytest

    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone, ok in (("Etc/UTC", True), ("Z", True), ("Europe/Berlin", False), ("+02:00", False)):
            spark.conf.set("spark.sql.session.timeZone", zone)
            if ok:
                EventStore(spark, str(tmp_path))
            else:
                with pytest.raises(ValueError, match="UTC"):
                    EventStore(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
