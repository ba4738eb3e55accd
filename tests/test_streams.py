import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from rillmark.operators.normalize import ingest
from rillmark.sources.generate import demo_registry, demo_snapshot, raw_events
from rillmark.sources.store import EventStore, StoreGap
from rillmark.streaming import loader
from rillmark.streaming.loader import LoadMetrics, batch_writer, events_of, file_source, log_rows, start, start_sessionizer
from rillmark.streaming.recent import start_remembering

RAW = "project_id string, raw string, received_at timestamp, pos long"


def line(message_id, at="2024-01-05T10:00:05.000Z", user="u", pos=0, ts="2024-01-05T10:00:00Z", event="click", project="p-1"):
    raw = json.dumps({"messageId": message_id, "event": event, "userId": user, "timestamp": ts, "properties": {"value": 1}})
    return {"project_id": project, "raw": raw, "received_at": at, "pos": pos}


def put(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, lines)))


def test_two_streams_and_a_fresh_checkpoint_lose_nothing(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"))
    for name in ("a", "b"):
        put(tmp_path / name, "0.json", [line(f"{name}{i}", pos=i) for i in range(5)])
    run = lambda name, checkpoint, **more: start(file_source(spark, str(tmp_path / name)), store, demo_snapshot(), str(tmp_path / checkpoint), **more).awaitTermination()
    run("a", "ca")
    run("b", "cb")
    assert store.facts().count() == 10 and len(store.state()["applied"]) == 2
    put(tmp_path / "b", "1.json", [line("b9", pos=9)])
    run("b", "fresh", recent_minutes=None)  # from the start of its source, under a name of its own
    assert len(store.state()["applied"]) == 3 and store.facts().select("message_id").distinct().count() == 11
    run("b", "fresh")
    assert sorted(store.state()["applied"].values()) == [0, 0, 1]


def test_a_gap_is_refused(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"))
    batch = spark.createDataFrame([("p-1", line("a")["raw"], dt.datetime(2024, 1, 5, 10, 1), 0)], RAW)
    write = batch_writer(store, demo_snapshot(), "one")
    with pytest.raises(StoreGap):
        write(batch, 1)
    write(batch, 0)
    write(batch, 0)
    write(batch, 1)
    assert store.applied("one") == 1


def test_outcomes_are_counted_while_rows_are_loaded(spark, tmp_path):
    put(tmp_path / "in", "0.json", [line("a"), line("a", pos=1), line("b", pos=2, event="nosuch"), line("c", pos=3, user="u2")])
    put(tmp_path / "in", "1.json", [line("d", pos=4)])
    store, told = EventStore(spark, str(tmp_path / "s")), []
    metrics = LoadMetrics(told.append)
    spark.streams.addListener(metrics)
    try:
        query = start(file_source(spark, str(tmp_path / "in")), store, demo_snapshot(False), str(tmp_path / "c"), metrics=metrics)
        query.awaitTermination()
        for _ in range(100):
            if str(query.id) in metrics.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(metrics)
    found = metrics.outcomes[str(query.id)]
    assert (found["accepted"], found["duplicate"], found["quarantined"], found["sampled_out"]) == (3, 1, 1, 0)
    assert metrics.progress[str(query.id)]["batch"] == 1 and metrics.ended[str(query.id)] is None and any("outcomes" in t for t in told)


def test_many_batches_are_sessionized_once(spark, tmp_path, monkeypatch):
    store, made = EventStore(spark, str(tmp_path / "s")), []
    for batch in range(4):
        rows = [("p-1" if i % 2 else "p-2", line(f"{batch}-{i}", user=f"u{i}", ts=f"2024-01-05T{10 + batch}:00:00Z")["raw"], dt.datetime(2024, 1, 5, 10 + batch, 1), i) for i in range(6)]
        snapshot = demo_registry()
        snapshot.put_project("p-2", snapshot.snapshot().projects["p-1"])
        for event, spec in [("click", snapshot.snapshot().find("p-1", "click", 1)[1])]:
            snapshot.put_schema("p-2", event, 1, spec)
        store.load(ingest(spark.createDataFrame(rows, RAW), snapshot.snapshot()), batch)
    assert store.sessions().count() == 0 and store.table("dirty").count() == 8
    write = store._write
    monkeypatch.setattr(store, "_write", lambda name, *rest: made.append(name) or write(name, *rest))
    assert store.sessionize() == 2 and made == ["sessions"]
    assert store.sessions().groupBy("project_id").count().collect() and store.sessions().agg(F.sum("event_count")).first()[0] == 24
    assert store.sessionize() == 0 and made == ["sessions"] and store.table("dirty").count() == 0
    before = dict(store.state()["tables"]["sessions"])
    rows = [("p-2", line("late", user="u0", ts="2024-01-05T20:00:00Z")["raw"], dt.datetime(2024, 1, 5, 20, 1), 0)]
    store.load(ingest(spark.createDataFrame(rows, RAW), snapshot.snapshot()), 4)
    assert store.sessionize() == 1 and store.sessions().agg(F.sum("event_count")).first()[0] == 25
    after = store.state()["tables"]["sessions"]
    assert sum(before[p] != after[p] for p in before) == 1  # the other project's sessions were not touched


def test_a_mark_that_comes_during_a_pass_stays_and_a_slower_pass_does_nothing(spark, tmp_path, monkeypatch):
    store, other = (EventStore(spark, str(tmp_path / "s")) for _ in range(2))
    delivery = lambda m, hour: ingest(spark.createDataFrame([("p-1", line(m, ts=f"2024-01-05T{hour}:00:00Z")["raw"], dt.datetime(2024, 1, 5, hour, 1), 0)], RAW), demo_snapshot(False))
    store.load(delivery("a", 10), 0)
    write, raced = store._write, []

    def slow(name, *rest):
        made = write(name, *rest)
        if not raced:
            raced.append(other.load(delivery("b", 12), 1) and other.sessionize())
        return made

    monkeypatch.setattr(store, "_write", slow)
    assert store.sessionize() == 0 and raced == [1]  # the other pass had newer facts
    assert store.sessions().count() == 2 and store.sessionize() == 0


def test_the_sessionizer_runs_by_its_own_clock(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"))
    query = start_sessionizer(store, str(tmp_path / "c"), seconds=0.5)
    try:
        store.load(ingest(spark.createDataFrame([("p-1", line("a")["raw"], dt.datetime(2024, 1, 5, 10, 1), 0)], RAW), demo_snapshot()), 0)
        for _ in range(300):
            if store.sessions().count():
                break
            time.sleep(0.2)
    finally:
        query.stop()
    assert store.sessions().count() == 1


def test_the_log_format_carries_project_and_user(spark):
    events = spark.createDataFrame([("p-1", '{"a":"ü\\n"}', 5), ("p-2", "not json", -1), ("p-1", "", 1 << 40)], "project_id string, raw string, user_key long")
    rows = log_rows(events)
    assert sorted(bytes(r["key"]) for r in rows.collect()) == sorted(k.to_bytes(8, "big", signed=True) for k in (5, -1, 1 << 40))
    at = dt.datetime(2024, 1, 5, 10, 0, 0, 123456)
    arrived = rows.withColumn("timestamp", F.lit(at)).withColumn("offset", F.lit(7).cast("long"))
    got = events_of(arrived).collect()
    assert sorted((r["project_id"], r["raw"]) for r in got) == sorted((r["project_id"], r["raw"]) for r in events.collect())
    later = events_of(arrived.withColumn("timestamp", F.lit(at + dt.timedelta(milliseconds=1))).withColumn("offset", F.lit(3).cast("long"))).first()
    assert later["pos"] > got[0]["pos"]  # arrival goes before offsets, which differ by partition
    broken = events_of(spark.createDataFrame([(b"{", at, 1)], "value binary, timestamp timestamp, offset long"))
    assert ingest(broken, demo_snapshot()).first()["status"] == "unreadable"


def test_state_forgets_ids_by_the_arrival_clock_and_survives_a_restart(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"))
    run = lambda: start_remembering(file_source(spark, str(tmp_path / "in"), 100), store, demo_snapshot(False), str(tmp_path / "c")).awaitTermination(120)
    put(tmp_path / "in", "0.json", [line("a", "2024-01-05T10:00:00Z"), line("a", "2024-01-05T10:10:00Z", pos=1), line("b", "2024-01-05T10:00:00Z", pos=2), line("b d", pos=3)])
    assert run() and store.facts().count() == 2 and store.quarantine().count() == 1
    put(tmp_path / "in", "1.json", [line("a", "2024-01-05T10:09:00Z", pos=4), line("b", "2024-01-05T10:11:00Z", pos=5)])
    assert run() and sorted(r["message_id"] for r in store.facts().collect()) == ["a", "b", "b"]
    assert "recent" not in {t for t, parts in store.state()["tables"].items() if parts}


def test_a_thousand_events_are_replayed_in_one_commit(spark, tmp_path):
    registry = demo_registry(False)
    store, at, now = EventStore(spark, str(tmp_path / "s")), dt.datetime(2024, 1, 5, 10, 1), dt.datetime(2024, 1, 6, tzinfo=dt.timezone.utc)
    rows = [("p-1", line(f"m{i % 900}", user=f"u{i}", event="error")["raw"].replace('"value": 1', '"value": "x"' if i < 50 else '"value": 1'), at + dt.timedelta(seconds=i), i) for i in range(1_000)]
    rows += [("p-1", line("w", event="other")["raw"], at, 2_000)]
    store.load(ingest(spark.createDataFrame(rows, RAW), registry.snapshot()), 0)
    registry.put_schema("p-1", "error", 1, registry.snapshot().find("p-1", "view", 1)[1])
    before = store.state()["seq"]
    reason = "no schema is registered for event 'error'"
    got = {r["outcome"]: r["count"] for r in store.replay_open(registry.snapshot(), "p-1", now, reason).groupBy("outcome").count().collect()}
    assert got == {"still invalid": 50, "accepted": 900, "duplicate": 50} and store.state()["seq"] == before + 1
    assert store.facts().count() == 900 and store.replays().count() == 1_000
    again = {r["outcome"]: r["count"] for r in store.replay_open(registry.snapshot(), "p-1", now).groupBy("outcome").count().collect()}
    assert again == {"still invalid": 51} and store.facts().count() == 900 and store.sessionize() == 1


def test_ids_share_states_and_are_told_apart(spark, tmp_path):
    from rillmark.streaming import recent

    at = lambda i, minute: line(f"m{i}", f"2024-01-05T10:{minute:02d}:00Z", user=f"u{i}", pos=i + 10_000 * minute)
    store, before, recent.SHARES = EventStore(spark, str(tmp_path / "s")), recent.SHARES, 2
    try:
        for minute, ids in ((0, range(40)), (10, range(20, 50)), (12, range(30))):
            put(tmp_path / "in", f"{minute}.json", [at(i, minute) for i in ids])
            assert start_remembering(file_source(spark, str(tmp_path / "in"), 100), store, demo_snapshot(False), str(tmp_path / "c")).awaitTermination(120)
    finally:
        recent.SHARES = before
    found = sorted((int(r["message_id"][1:]), r["received_at"].minute) for r in store.facts().collect())
    assert found == sorted([(i, 0) for i in range(40)] + [(i, 10) for i in range(40, 50)] + [(i, 12) for i in range(30)])
