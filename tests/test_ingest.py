import datetime as dt
import json

import pytest

from rillmark.functions.identity import bucket, bucket_of, key_bytes, key_of, valid_rate
from rillmark.functions.numbers import canonical
from rillmark.operators import normalize as N
from rillmark.operators.quarantine import QUARANTINE_SCHEMA, decode_cursor, encode_cursor, find, page, replayed
from rillmark.plans.requests import Days, Funnel, PropertyFilter, RequestError, Retention, Segment
from rillmark.sources.registry import Conflict, Property, Registry, Settings, Spec, breaking_changes

NOW = dt.datetime(2026, 9, 23, 12, tzinfo=dt.timezone.utc)
PURCHASE = Spec({
    "amount": Property("number", True), "quantity": Property("integer"), "currency": Property("string", True, ("USD", "EUR", "TRY")),
    "coupon": Property("string"), "gift": Property("boolean"), "email": Property("string"),
})


@pytest.fixture
def registry():
    r = Registry()
    r.put_project("p", Settings(("email",)))
    assert r.put_schema("p", "purchase", 1, PURCHASE) == ("created", [])
    return r


def event(**changes):
    base = {"messageId": "m-1", "event": "purchase", "userId": "ada", "timestamp": "2026-09-23T11:59:00.000Z", "properties": {"amount": 12.5, "currency": "USD"}} | changes
    return json.dumps({k: v for k, v in base.items() if v is not ...})


def run(registry, raw, at=NOW):
    return N.Normalizer(registry.snapshot())("p", raw, at)


@pytest.mark.parametrize(("raw", "reason"), [
    ("[]", "must be a JSON object"), ("nonsense", "must be a JSON object"), (event(messageId=...), "messageId is required"), (event(messageId="a b"), "messageId is required"),
    (event(messageId="x" * 129), "messageId is required"), (event(event="9lives"), "event is required"), (event(event=...), "event is required"), (event(userId=...), "userId or anonymousId"),
    (event(userId="x" * 257), "limited to 256"), (event(userId="a\u0007b"), "control characters"), (event(timestamp="2026-09-23T11:59:00"), "timestamp is required"),
    (event(timestamp=1), "timestamp is required"), (event(version="2"), "version, when present"), (event(version=0), "version, when present"), (event(version=9), "at version 9"),
    (event(event="other"), "no schema is registered for event 'other'"), (event(properties=[1]), "properties must be a JSON object"),
])
def test_first_reason_wins(registry, raw, reason):
    got = run(registry, raw)
    assert got["status"] == "quarantined" and reason in got["reason"]


@pytest.mark.parametrize("text", ["2026-09-23T14:59:00+03:00", "2026-09-23T14:59:00+0300", "2026-09-23T06:59:00-05:00", "2026-09-23T11:59:00z", "2026-09-23T11:59:00.0009999Z"])
def test_offsets_are_one_instant(registry, text):
    assert run(registry, event(timestamp=text))["ts"] == dt.datetime(2026, 9, 23, 11, 59, tzinfo=dt.timezone.utc)


@pytest.mark.parametrize(("shift", "status", "late"), [
    (dt.timedelta(hours=-2), "accepted", False), (dt.timedelta(hours=-2, milliseconds=-1), "accepted", True), (dt.timedelta(minutes=5), "accepted", False),
    (dt.timedelta(minutes=5, milliseconds=1), "quarantined", None), (dt.timedelta(days=-90), "accepted", True), (dt.timedelta(days=-90, milliseconds=-1), "quarantined", None),
])
def test_lateness_bounds(registry, shift, status, late):
    at = (NOW + shift).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
    got = run(registry, event(timestamp=at))
    assert (got["status"], got["is_late"]) == (status, late)


@pytest.mark.parametrize(("raw", "reasons"), [
    ('{"amount":"x"}', ["property 'amount' must be a finite number", "required property 'currency' is missing"]),
    ('{"amount":1,"currency":"GBP"}', ["not one of its allowed values"]), ('{"amount":1,"currency":"USD","quantity":1.5}', ["must be an integer"]),
    ('{"amount":1,"currency":"USD","quantity":1e3}', ["must be an integer"]), ('{"amount":1,"amount":2,"currency":"USD"}', ["'amount' appears more than once"]),
    ('{"amount":1e999,"currency":"USD"}', ["must be a finite number"]), ('{"amount":1,"currency":"USD","gift":"yes"}', ["must be a boolean"]),
    ('{"amount":1,"currency":"USD","x":1}', ["'x' is not declared in purchase@1"]), ('{"amount":null,"currency":"USD"}', ["required property 'amount' is missing"]),
])
def test_property_reasons(registry, raw, reasons):
    _, got = N.check_properties("purchase", 1, PURCHASE, N.read_json(raw), set())
    assert len(got) == len(reasons) and all(r in g for r, g in zip(reasons, got, strict=True))


def test_stored_text_and_redaction(registry):
    got = run(registry, event(properties={"amount": 12.50, "quantity": 3, "currency": "EUR", "gift": True, "email": "a@b.c", "coupon": None}))
    assert got["properties"] == {"amount": "12.5", "quantity": "3", "currency": "EUR", "gift": "true", "email": "[redacted]"}
    again = run(registry, event(properties={"amount": 1, "currency": "EUR", "email": "[redacted]"}))
    assert again["status"] == "accepted"
    bad = run(registry, event(properties={"amount": "x", "currency": "EUR", "email": "a@b.c"}))
    assert "a@b.c" not in bad["payload"] and "[redacted]" in bad["payload"]
    large = run(registry, event(properties={"amount": "x" * 70_000, "currency": "EUR"}))
    assert large["payload"] == "{}" and "64 KiB" in large["reason"]


@pytest.mark.parametrize(("value", "text"), [(12.5, "12.5"), (100, "100"), (0.1, "0.1"), (-0.0, "-0"), (1e15, "1E+15"), (123456789012345.0, "123456789012345"), (1.5e-7, "1.5E-07"), (0.00001, "1E-05"), (2.5e300, "2.5E+300"), (0.001, "0.001"), (0.0001, "0.0001"), (1e14, "100000000000000")])
def test_number_text(value, text):
    assert canonical(value) == text


def test_sampling_comes_last_and_keeps_its_share(registry):
    registry.put_project("p", Settings((), {"purchase": 0.1}))
    normal = N.Normalizer(registry.snapshot())
    kept = sum(normal("p", event(userId=f"u{i}"), NOW)["status"] == "accepted" for i in range(4_000))
    assert abs(kept - 400) < 4 * (4_000 * 0.1 * 0.9) ** 0.5
    assert normal("p", event(userId="u1", properties={}), NOW)["status"] == "quarantined"


def test_bucket_reads_the_key_as_unsigned(spark):
    from pyspark.sql import functions as F

    keys = [0, 1, -1, 2**63 - 1, -(2**63), key_of("ada", None), key_of(None, "ada")]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", bucket(F.col("k")).alias("b")).collect()
    assert all(r["b"] == bucket_of(r["k"]) for r in rows) and bucket_of(-1) == 1615
    found = spark.createDataFrame([(k,) for k in keys], "k long").select("k", key_bytes(F.col("k")).alias("x")).collect()
    assert all(bytes(r["x"]) == r["k"].to_bytes(8, "big", signed=True) for r in found)
    assert key_of("ada", None) == key_of("ada", "x") != key_of(None, "ada")


@pytest.mark.parametrize(("rate", "ok"), [(1.0, True), (0.1, True), (0.0001, True), (0.00015, False), (0, False), (1.5, False), (-0.1, False)])
def test_rates(rate, ok):
    assert valid_rate(rate) is ok


def test_batch_duplicates_and_outcomes(spark, registry):
    raws = [event(), event(), event(messageId="m-2"), event(messageId="m-3", properties={}), event(messageId="m-3")]
    df = spark.createDataFrame([("p", r, NOW.replace(tzinfo=None), i) for i, r in enumerate(raws)], "project_id string, raw string, received_at timestamp, pos long")
    rows = N.ingest(df, registry.snapshot())
    assert {(r["status"], r["n"]) for r in rows.groupBy("status").count().withColumnRenamed("count", "n").collect()} == {("accepted", 3), ("duplicate", 1), ("quarantined", 1)}
    assert [(r["pos"], r["status"]) for r in N.not_accepted(rows).collect()] == [(1, "duplicate"), (3, "quarantined")]


def test_schema_evolution(registry):
    grown = Spec(PURCHASE.properties | {"channel": Property("string")})
    assert registry.put_schema("p", "purchase", 1, PURCHASE) == ("unchanged", [])
    assert registry.put_schema("p", "purchase", 1, grown) == ("updated", [])
    assert registry.put_schema("p", "purchase", 1, PURCHASE)[0] == "breaking"
    assert registry.put_schema("q", "purchase", 1, PURCHASE)[0] == "not_found"
    assert registry.put_schema("p", "purchase", 2, PURCHASE)[0] == "created"
    assert registry.snapshot().find("p", "purchase", None)[0] == 2
    changed = Spec({"amount": Property("integer", False), "currency": Property("string", True, ("USD", "GBP")), "quantity": Property("integer", False, None), "new": Property("string", True)})
    found = breaking_changes(PURCHASE, changed)
    for part in ("coupon is gone", "amount was number and is integer", "amount became optional", "currency lost the value 'EUR'", "new is new and required"):
        assert any(part in f for f in found)
    assert "65 properties, 64" in Spec({f"p{i}": Property("string") for i in range(65)}).problems()[0]
    assert any("twice" in x for x in Spec({"a": Property("string", False, ("x", "x"))}).problems())
    assert any("only strings" in x for x in Spec({"a": Property("number", False, ("x",))}).problems())


@pytest.mark.parametrize("shared", [False, True])
def test_registry_folder_is_compared_and_swapped(spark, tmp_path, monkeypatch, shared):
    from rillmark.sources import files

    if shared:  # as on a file system that is not the driver's
        monkeypatch.setattr(files, "folder", lambda path, spark=None: files.SharedFolder(spark, path))
    a = Registry(str(tmp_path / "catalog"), spark)
    a.put_project("p")
    b = Registry(str(tmp_path / "catalog"), spark)
    before = b.snapshot()
    a.put_schema("p", "purchase", 1, PURCHASE)
    with pytest.raises(Conflict):
        b._swap(before, before)
    assert b.put_schema("p", "other", 1, PURCHASE)[0] == "created" and b.snapshot().find("p", "purchase", 1)
    monkeypatch.setattr(a, "refresh", a.snapshot)  # a writer that does not see the newest revision cannot write over it
    with pytest.raises(Conflict):
        a.put_schema("p", "third", 1, PURCHASE)
    assert not b.log.put(1, "{}") and b.log.newest()[0] == b.snapshot().revision == 3


def test_old_revisions_go_and_their_numbers_stay_taken(tmp_path, monkeypatch):
    from rillmark.sources import files

    monkeypatch.setattr(files, "KEPT", 3)
    log = files.Numbered(str(tmp_path / "log"))
    assert all(log.put(n, str(n)) for n in range(1, 8))
    assert len(log.folder.names()) == 3 and not log.put(2, "late") and log.newest() == (7, "7")


def test_listing_is_ordered(spark, registry):
    registry.put_schema("p", "purchase", 2, PURCHASE)
    registry.put_schema("p", "add", 1, PURCHASE)
    rows = registry.snapshot().listing(spark, "p").collect()
    assert [(r["event_name"], r["version"]) for r in rows] == [("add", 1), ("purchase", 1), ("purchase", 2)]
    assert Spec.from_json(json.loads(rows[0]["spec"])) == PURCHASE and registry.snapshot().listing(spark, "q").count() == 0


def test_deliveries_are_bounded(spark, registry):
    got = N.deliver(spark, "p", [event(), event(messageId="m-2", event="other")], NOW, registry.snapshot())
    assert [r["status"] for r in got.orderBy("pos").collect()] == ["accepted", "quarantined"]
    assert got.first()["received_at"].astimezone(dt.timezone.utc) == NOW
    for raws in ([], ["{}"] * 501, ["x" * 70_000], ["x" * 50_000] * 100):
        assert N.request_problems(raws)
        with pytest.raises(RequestError):
            N.deliver(spark, "p", raws, NOW, registry.snapshot())


def test_messages_without_project_or_arrival_are_counted_and_stored_nowhere(registry):
    normal = N.Normalizer(registry.snapshot())
    assert normal(None, event(), NOW)["status"] == normal("p", event(), None)["status"] == "unreadable"


def test_the_normaliser_runs_once(spark, registry):
    df = spark.createDataFrame([("p", event(), NOW, 0)], "project_id string, raw string, received_at timestamp, pos long")
    assert N.ingest(df, registry.snapshot())._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_bounds():
    days = Days(dt.date(2026, 1, 1), dt.date(2026, 1, 31))
    assert "stands twice" in Funnel(("a", "a"), days, 60, project="p").problems()[0]
    assert "2 to 8" in Funnel(tuple("abcdefghi"), days, 60, project="p").problems()[0]
    assert Funnel(("a", "b"), Days(days.end, days.start), 0, project="p").problems() == ["window: 1 to 7776000 seconds are possible", "the range ends before it begins"]
    assert not Retention("a", "b", days, 63, project="p").problems() and Retention("a", "b", days, 64, project="p").problems()
    start = dt.date(2026, 1, 1)
    assert not Retention("a", "b", Days(start, start + dt.timedelta(days=192)), 63, project="p").problems()
    assert Retention("a", "b", Days(start, start + dt.timedelta(days=193)), 63, project="p").problems()
    assert Segment(days, project="").problems() == ["project: missing"]
    assert not Days(start, start + dt.timedelta(days=365)).problems() and Days(start, start + dt.timedelta(days=366)).problems()
    assert "no number" in Segment(days, "a", (PropertyFilter("x", "gt", ("abc",)),), project="p").problems()[0]
    assert "takes one value" in PropertyFilter("x", "eq", ("a", "b")).problems()[0]
    assert "1 to 100 values" in PropertyFilter("x", "in", tuple(map(str, range(101)))).problems()[0]


def test_quarantine_pages_and_replay(spark, registry):
    key = "00000000-0000-0000-0000-{:012d}"
    at = dt.datetime(2026, 9, 1)
    rows = [("p", at + dt.timedelta(minutes=i // 2), key.format(i), f"m{i}", "e", "r", event(properties={"amount": 1, "currency": "USD", "campaign": "x"}), "open", at) for i in range(7)]
    rows.append(rows[3][:7] + ("replayed", at + dt.timedelta(days=1)))
    df = spark.createDataFrame(rows, QUARANTINE_SCHEMA)
    seen, cursor = [], None
    while True:
        items, cursor = page(df, "p", 2, cursor)
        seen += [r["message_id"] for r in items]
        if cursor is None:
            break
    assert seen == ["m6", "m5", "m4", "m2", "m1", "m0"]
    assert page(df, "p", 200, "garbage!")[0] and page(df, "other", 5) == ([], None)
    assert decode_cursor(encode_cursor(at, key.format(1))) == (at.replace(tzinfo=dt.timezone.utc), key.format(1))
    row = find(df, "p", key.format(0))
    row_at = row.asDict() | {"received_at": NOW}
    assert N.replay(row_at, registry.snapshot())["status"] == "quarantined"
    registry.put_schema("p", "purchase", 1, Spec(PURCHASE.properties | {"campaign": Property("string")}))
    assert N.replay(row_at, registry.snapshot())["status"] == "accepted"
    closed = df.unionByName(spark.createDataFrame([tuple(replayed(row, dt.datetime(2026, 9, 30)))], QUARANTINE_SCHEMA))
    assert find(closed, "p", key.format(0))["status"] == "replayed"
