"""Events judged by columns come out as the rules on one event have them."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from rillmark.operators import normalize as N
from rillmark.operators.accept import judged
from rillmark.sources.registry import Property, Registry, Settings, Spec

NOW = dt.datetime(2026, 9, 23, 12, 0, 0, 123456)
RAW = "project_id string, raw string, received_at timestamp, pos long"
SPEC = Spec({"amount": Property("number", True), "n": Property("integer"), "cur": Property("string", False, ("USD", "€")), "note": Property("string"), "gift": Property("boolean"), "email": Property("string")})


@pytest.fixture(scope="module")
def snapshot():
    registry = Registry()
    registry.put_project("p", Settings(("email", "n"), {"buy": 0.3}))
    registry.put_project("q", Settings())
    for project in "pq":
        registry.put_schema(project, "buy", 1, SPEC)
        registry.put_schema(project, "buy", 3, Spec(SPEC.properties | {"late": Property("boolean")}))
        registry.put_schema(project, "bare", 1, Spec({}))
    return registry.snapshot()


NUMBERS = ["0", "-0", "1", "-7", "12.5", "12.50", "100.0", "0.1", "0.0001", "0.00001", "-0.0", "0.0", "1e3", "1E-7", "123456789012345", "1234567890123456", "99999999999999.9", "999999999999999.9", "1234567.12345678",
           "9223372036854775807", "9223372036854775808", "1" * 40, "1e400", "-1.5e-9", "0.1234567890123456", "NaN", "01", "1.", '"1"', "true", "null", "[1]", "{}"]
STRINGS = ['"USD"', '"€"', '"usd"', '""', '"[redacted]"', json.dumps("x" * 1_024), json.dumps("x" * 1_025), json.dumps("é" * 1_024, ensure_ascii=False), json.dumps("😀" * 512, ensure_ascii=False), json.dumps("😀" * 513, ensure_ascii=False),
           '"\\ud83d\\ude00"', '"\\ud800"', '"a\\u0000b"', '"tab\\t"', "1", "false", "null", "[]"]
TIMES = ["2026-09-23T11:59:00Z", "2026-09-23T11:59:00.5Z", "2026-09-23T11:59:00.1239999Z", "2026-09-23 11:59:00+00:00", "2026-09-23T14:59:00+03:00", "2026-09-23T14:59:00+0300", "2026-09-24T01:59:00+14:00", "2026-09-24T02:59:00+15:00",
         "2026-09-23t11:59:00z", "2026-09-23T11:59Z", "2026-09-23T11:59:00", "2026-02-30T11:59:00Z", "2026-09-23T24:00:00Z", "2026-09-23T11:59:60Z", "2026-09-23T12:05:00.123Z", "2026-09-23T12:05:00.124Z", "2026-09-23T10:00:00.123Z",
         "2026-09-23T10:00:00.122Z", "2026-06-25T12:00:00.123Z", "2026-06-25T12:00:00.122Z", "0000-01-01T00:00:00Z", "9999-12-31T23:59:59Z", "2026-09-23T11:59:00.1234567890Z", " 2026-09-23T11:59:00Z", "x", "2026-09-23T11:59:00-00:30", "2026-09-23T11:59:00+03:99"]
NAMES = ['"m-1"', '"a b"', '""', '"' + "x" * 128 + '"', '"' + "x" * 129 + '"', '"é"', "1", "null", '"a\\n"']


def raw_event(rng):
    one = lambda usual, others, p=0.12: rng.choice(others) if rng.random() < p else usual
    fields = [("messageId", one('"m-1"', NAMES)), ("event", one('"buy"', ['"bare"', '"none"', '"9x"', "null", '"b y"'])), ("userId", one('"ada"', ['""', "null", "5", '"' + "u" * 257 + '"', '"é' + "u" * 255 + '"', '"a\\u0085"', '"a\\u0007"']))]
    fields += [("timestamp", json.dumps(one(TIMES[0], TIMES, 0.3))), ("version", one("null", ["1", "3", "2", "0", "-1", "65536", "1.0", '"1"', "true", "99999999999"]))]
    if rng.random() < 0.2:
        fields.append(("anonymousId", rng.choice(['"x"', "null", "7", '"\\u0001"'])))
    inner = [("amount", one("12.5", NUMBERS, 0.5)), ("n", one("3", NUMBERS, 0.3)), ("cur", one('"USD"', STRINGS, 0.2)), ("note", one('"hi"', STRINGS, 0.3)), ("gift", one("true", ["false", "null", "1", '"true"'])), ("email", one('"a@b"', STRINGS, 0.2)), ("late", "true"), ("extra", "null")]
    inner = [x for x in inner if rng.random() < (0.95 if x[0] == "amount" else 0.03 if x[0] in ("late", "extra") else 0.5)]
    rng.shuffle(inner)
    if inner and rng.random() < 0.05:
        inner.append(inner[0])
    fields.append(("properties", one("{" + ",".join(f'"{k}":{v}' for k, v in inner) + "}", ["null", "[]", '"x"', "{}"], 0.05)))
    fields = [f for f in fields if rng.random() < 0.97]
    rng.shuffle(fields)
    if rng.random() < 0.04:
        fields.append(rng.choice(fields))
    text = "{" + ",".join(f'"{k}":{v}' for k, v in fields) + "}"
    return rng.choice([" {}\n", "{} x", "{}{}", "{}]", "[{}]", "{}}}", '{},"y"', "{}\x00"]).format(text, text) if rng.random() < 0.06 else text


def rows_of(df):
    order = lambda v: sorted(v.items()) if isinstance(v, dict) else v
    return sorted(repr([(k, order(v)) for k, v in sorted(r.asDict(recursive=True).items())]) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_columns_agree_with_the_rules_on_one_event(spark, snapshot, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["p", "p", "q", "r"]) if i % 40 else None, raw_event(rng), NOW if i % 50 else None, i) for i in range(2_500)]
    rows += [("p", raw, NOW, 9_000 + i) for i, raw in enumerate(["", "null", "[]", "{}", None, "nonsense", '"x"', "1", "{" * 2_000, '{"a":' * 1_500 + "1" + "}" * 1_500])]
    df = spark.createDataFrame(rows, RAW).repartition(4)
    got, wanted = rows_of(N.normalize(df, snapshot)), rows_of(N.one_by_one(df, snapshot))
    assert got == wanted
    statuses = {r["status"]: r["count"] for r in N.one_by_one(df, snapshot).groupBy("status").count().collect()}
    fits = judged(df, snapshot).where("fits").count()
    assert statuses["accepted"] > 100 and statuses["sampled_out"] > 50
    assert fits > 0.6 * (statuses["accepted"] + statuses["sampled_out"])  # of events made to be odd


def test_usual_events_never_reach_the_python_rules(spark, snapshot):
    rows = [("p", json.dumps({"messageId": f"m{i}", "event": "buy", "userId": f"ü{i}", "timestamp": "2026-09-23T11:59:00.000Z", "properties": {"amount": i / 8, "cur": "€", "email": "x"}}, ensure_ascii=i % 2 > 0), NOW, i) for i in range(1, 200)]
    df = spark.createDataFrame(rows, RAW)
    assert judged(df, snapshot).where("not fits").count() == 0


def test_events_nested_too_deep_do_not_read(spark, snapshot):
    usual = {"messageId": "m", "event": "buy", "userId": "u", "timestamp": "2026-09-23T11:59:00Z", "properties": {"amount": 1}}
    text = lambda depth: json.dumps(usual)[:-1] + ',"more":' + "[" * (depth - 1) + "]" * (depth - 1) + "}"
    rows = [("p", text(depth), NOW, depth) for depth in (5, 63, 64, 65, 900, 30_000)]
    got = {r["pos"]: r["reason"] for r in N.normalize(spark.createDataFrame(rows, RAW), snapshot).collect()}
    assert got == {5: None, 63: None, 64: None, 65: N.NOT_OBJECT, 900: N.NOT_OBJECT, 30_000: N.NOT_OBJECT}


def test_an_empty_catalog_and_no_events(spark, snapshot):
    from rillmark.sources.registry import Snapshot

    df = spark.createDataFrame([("p", '{"messageId":"m","event":"buy","userId":"u","timestamp":"2026-09-23T11:59:00Z"}', NOW, 1)], RAW)
    assert N.normalize(df, Snapshot()).first()["reason"] == "no schema is registered for event 'buy'"
    assert N.normalize(df.limit(0), snapshot).count() == 0 and N.normalize(df.withColumn("key", F.lit("k")), snapshot, "key").first()["key"] == "k"


def test_events_are_read_and_judged_once(spark, snapshot, tmp_path):
    path = str(tmp_path / "raw")
    spark.createDataFrame([("p", "{}", NOW, 1)], RAW).write.parquet(path)
    plan = N.ingest(spark.read.parquet(path), snapshot)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1 and plan.count("parseJson") == 1


def test_long_events_are_left_to_the_python_rules(spark, snapshot):
    event = {"messageId": "m", "event": "buy", "userId": "u", "timestamp": "2026-09-23T11:59:00.000Z", "properties": {"amount": 1}}
    raws = [json.dumps(event) + " " * 70_000, json.dumps(event | {"more": "x" * 70_000}), json.dumps(event | {"properties": {"amount": 1, "big": "b" * 70_000}})]
    df = spark.createDataFrame([("p", raw, NOW, i) for i, raw in enumerate(raws)], RAW)
    assert rows_of(N.normalize(df, snapshot)) == rows_of(N.one_by_one(df, snapshot))
    assert judged(df, snapshot).where("fits").count() == 0
