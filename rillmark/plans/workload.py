"""The registered queries over the driver's tables, each with its DuckDB SQL where SQL has one."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numbers import to_number
from ..functions.stats import upper_median, value_counts
from ..operators import facts as X
from ..operators import quarantine as Q
from ..operators import retention as R
from ..operators import rollup as M
from ..operators import sampling as S
from ..operators import segment as G
from ..operators import sessions as Z
from ..operators.funnel import funnel
from ..sources.canonical import CANONICAL_SQL, PROJECT, SHARED_SQL, facts, shared_facts
from ..sources.generate import RAW_SQL, seed_sql
from ..sources.odd_events import ODD_SQL, outcomes_by_rule
from .requests import Days, Funnel, PropertyFilter, Retention, Sampled, Segment, Sessions

D = dt.date
JANUARY = Days(D(2024, 1, 1), D(2024, 1, 31))
FUNNEL3 = Funnel(("signup", "click", "purchase"), Days(D(2024, 1, 3), D(2024, 1, 20)), 7 * 86_400, project=PROJECT)
FUNNEL4 = Funnel(("view", "signup", "click", "purchase"), Days(D(2024, 1, 3), D(2024, 1, 20)), 3 * 86_400, project=PROJECT)
TIGHT = Funnel(("signup", "click", "purchase", "error"), JANUARY, 6 * 3_600, project=PROJECT)
RETENTION = Retention("signup", "purchase", Days(D(2024, 1, 2), D(2024, 1, 12)), 14, project=PROJECT)
HALF = Sampled(5_000)
UNSCALED = Sampled()
VIEWS = Retention("view", "purchase", Days(D(2024, 1, 2), D(2024, 1, 12)), 14, project=PROJECT)


# --- DuckDB SQL -----------------------------------------------------------------------------


def _funnel_sql(q: Funnel, sampled: Sampled = Sampled()) -> str:
    k, w = len(q.steps), q.window_seconds * 1000
    names = ", ".join(f"'{s}'" for s in q.steps)
    end = q.days.end + dt.timedelta(days=1)
    levels = [f"q0 AS (SELECT user_key, t, list_position([{names}], event_name) AS step FROM facts WHERE event_name IN ({names}) AND ts >= TIMESTAMP '{q.days.start}' "
              f"AND ts < TIMESTAMP '{end}' + INTERVAL {q.window_seconds} SECOND AND (event_name <> '{q.steps[0]}' OR ts < TIMESTAMP '{end}') AND NOT is_late AND sample_bucket < {sampled.threshold})",
              "q1 AS (SELECT *, CASE WHEN step = 1 THEN t END AS s1 FROM q0)"]
    for i in range(2, k + 1):
        before = f"last_value(s{i - 1} IGNORE NULLS) OVER (PARTITION BY user_key ORDER BY t, step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        levels.append(f"q{i} AS (SELECT *, CASE WHEN step = {i} AND t <= {before} + {w} THEN {before} END AS s{i} FROM q{i - 1})")
    per_user = ", ".join(f"max_by(t - s{i}, t) FILTER (WHERE s{i} IS NOT NULL) AS d{i}" for i in range(1, k + 1))
    rows = " UNION ALL ".join(
        f"SELECT {i} AS step, '{q.steps[i - 1]}' AS event, round_even(count(d{i}) * {sampled.scale}, 0)::BIGINT AS users, "
        f"list_sort(list(d{i}) FILTER (WHERE d{i} IS NOT NULL))[count(d{i}) // 2 + 1] AS med FROM per_user"
        for i in range(1, k + 1))
    return f"""WITH {CANONICAL_SQL}, {', '.join(levels)}, per_user AS (SELECT user_key, {per_user} FROM q{k} GROUP BY user_key), rows AS ({rows}),
    placed AS (SELECT *, lag(users) OVER (ORDER BY step) AS before, first_value(users) OVER (ORDER BY step) AS start FROM rows)
    SELECT step, event, users, CASE WHEN step = 1 THEN 1.0::DOUBLE WHEN before > 0 THEN users::DOUBLE / before ELSE 0.0 END AS conversion_from_previous,
           CASE WHEN start > 0 THEN users::DOUBLE / start ELSE 0.0 END AS conversion_from_start,
           CASE WHEN step > 1 THEN med / 1000.0::DOUBLE END AS median_seconds_from_start FROM placed"""


def _retention_sql(q: Retention, sampled: Sampled = Sampled()) -> str:
    last = q.days.end + dt.timedelta(days=q.follow)
    return f"""WITH {CANONICAL_SQL}, r AS (
        SELECT user_key, event_name, ts::DATE AS d FROM facts WHERE NOT is_late AND sample_bucket < {sampled.threshold} AND ts::DATE BETWEEN DATE '{q.days.start}' AND DATE '{last}'
    ), c AS (SELECT user_key, min(d) AS day FROM r WHERE event_name = '{q.start_event}' AND d <= DATE '{q.days.end}' GROUP BY user_key),
    b AS (SELECT DISTINCT user_key, d FROM r WHERE event_name = '{q.return_event}'),
    sizes AS (SELECT day, count(*) AS users FROM c GROUP BY day),
    hits AS (SELECT c.day, b.d - c.day AS k, count(*) AS n FROM c JOIN b USING (user_key) WHERE b.d >= c.day AND b.d - c.day <= {q.follow} GROUP BY ALL)
    SELECT s.day, g.k::INTEGER AS k, round_even(s.users * {sampled.scale}, 0)::BIGINT AS users, round_even(coalesce(h.n, 0) * {sampled.scale}, 0)::BIGINT AS retained
    FROM sizes s CROSS JOIN range(0, {q.follow + 1}) AS g(k) LEFT JOIN hits h ON h.day = s.day AND h.k = g.k"""


def _segment_sql(q: Segment, where: str = "true", sampled: Sampled = Sampled(), late: bool = False) -> str:
    end = q.days.end + dt.timedelta(days=1)
    rows = f"""WITH {CANONICAL_SQL}, s AS (
        SELECT ts::DATE AS day, is_late, round_even(sum(10000.0::DOUBLE / sample_threshold), 0)::BIGINT AS events,
               round_even(count(DISTINCT user_key) FILTER (WHERE sample_bucket < {sampled.threshold}) * {sampled.scale}, 0)::BIGINT AS users
        FROM deduped WHERE ts >= TIMESTAMP '{q.days.start}' AND ts < TIMESTAMP '{end}' {f"AND event_name = '{q.event}'" if q.event else ''} AND ({where}) GROUP BY ALL)"""
    return rows + (" SELECT coalesce(sum(events), 0)::BIGINT AS late_events FROM s WHERE is_late" if late else " SELECT day, events, users FROM s WHERE NOT is_late")


_SESSIONS_SQL = f"""WITH {CANONICAL_SQL}, ready AS (SELECT ts::DATE AS day, user_key, ts, t FROM deduped WHERE NOT is_late),
    gaps AS (SELECT *, CASE WHEN t - lag(t) OVER w > 1800000 OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS starts FROM ready WINDOW w AS (PARTITION BY day, user_key ORDER BY ts)),
    numbered AS (SELECT *, sum(starts) OVER (PARTITION BY day, user_key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM gaps),
    sessions AS (SELECT '{PROJECT}' AS project_id, day, user_key, user_key::VARCHAR AS user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS event_count
                 FROM numbered GROUP BY day, user_key, session)"""
_SESSIONS_DAILY_SQL = (
    _SESSIONS_SQL + " SELECT day, count(*) AS sessions, count(DISTINCT user_key) AS users, list_sort(list(epoch_ms(session_end) - epoch_ms(session_start)))[count(*) // 2 + 1] / 1000.0::DOUBLE "
    "AS median_duration_seconds, avg(event_count) AS events_per_session FROM sessions GROUP BY day")
_MASKS_SQL = f"""WITH {CANONICAL_SQL} SELECT '{PROJECT}' AS project_id, event_name, date_trunc('month', ts)::DATE AS month, user_key,
    bit_or(1::BIGINT << (day(ts) - 1)::INTEGER) AS days, min(sample_threshold)::INTEGER AS sample_threshold, min(sample_bucket)::INTEGER AS sample_bucket
    FROM facts WHERE NOT is_late GROUP BY ALL"""
_QUARANTINE_CTE = f"""q AS (SELECT '{PROJECT}' AS project_id, ts AS received_at, lpad(event_id::VARCHAR, 12, '0') AS quarantine_id, 'e-' || event_id AS message_id, event_type AS event_name,
    CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS reason, 'open' AS status, 0 AS v FROM events WHERE event_type = 'error'),
    versions AS (SELECT * FROM q UNION ALL SELECT * REPLACE ('replayed' AS status, 1 AS v) FROM q WHERE quarantine_id::BIGINT % 3 = 0),
    newest AS (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY quarantine_id ORDER BY v DESC) = 1)"""


# --- the queries ----------------------------------------------------------------------------


def _quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Errors as rejected events; every third was replayed."""
    events = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'error'")
    base = events.select(
        F.lit(PROJECT).alias("project_id"), F.col("ts").cast("timestamp").alias("received_at"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("quarantine_id"),
        F.concat(F.lit("e-"), F.col("event_id")).alias("message_id"), F.col("event_type").alias("event_name"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("reason"),
        F.lit("open").alias("status"), F.col("ts").cast("timestamp").alias("updated_at"), "event_id")
    again = base.where("event_id % 3 = 0").withColumn("status", F.lit("replayed")).withColumn("updated_at", F.expr("updated_at + interval 1 hour"))
    return base.unionByName(again).drop("event_id")


def _lateness(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.normalize import timing

    events = spark.read.parquet(f"{sf}/events.parquet")
    ts = F.col("ts").cast("timestamp")
    # Arrival from six minutes before the event to 91 days after it, on the exact boundaries too.
    shift = F.element_at(F.array(*[F.lit(m) for m in (-300_001, -300_000, 0, 7_200_000, 7_200_001, 7_776_000_000, 7_776_000_001)]), (F.col("event_id") % 7 + 1).cast("int"))
    received = F.timestamp_millis(F.unix_millis(ts) + shift)
    return events.select(timing(F.timestamp_millis(F.unix_millis(ts)), received).alias("timing")).groupBy("timing").agg(F.count("*").alias("n"))


def _names(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.normalize import is_event_name, is_message_id

    words = spark.read.parquet(f"{sf}/customer.parquet").select(F.explode(F.array("c_name", "c_mktsegment", F.concat(F.lit("9"), "c_name"), F.translate("c_name", "#", " "))).alias("name"))
    return words.groupBy(is_event_name(F.col("name")).alias("event_ok"), is_message_id(F.col("name")).alias("message_ok")).agg(F.count("*").alias("n"))


def _numeric_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf).select(to_number(F.col("properties")["k"]).alias("k"))
    return rows.groupBy((F.col("k") % 10).cast("int").alias("digit")).agg(F.count("*").alias("n"), F.sum("k").alias("total"))


def _median_upper(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return upper_median(value_counts(rows, ["event_type"], "ms"), ["event_type"]).select("event_type", "n", F.col("median").cast("long").alias("median_ms"))


def _funnel(q: Funnel, sampled: Sampled | None = Sampled(), fold: bool = False):
    return lambda spark, sf: funnel(facts(spark, sf), q, sampled, fold)


def _segment(q: Segment, sampled: Sampled | None = Sampled()):
    return lambda spark, sf: G.segment(facts(spark, sf), q, sampled)


def _rollup(spark: SparkSession, sf: str) -> DataFrame:
    return M.merged(M.month_masks(facts(spark, sf)))


def _filter(name: str, operator: str, *values: str) -> Segment:
    return Segment(JANUARY, "purchase", (PropertyFilter(name, operator, values),), project=PROJECT)


def _shared(sql: str) -> str:
    return sql.replace(CANONICAL_SQL, SHARED_SQL)


def _seed(spark: SparkSession, sf: str) -> DataFrame:
    """The load that the customers would make."""
    from ..sources.generate import seed_shape

    return seed_shape(spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").cast("long").alias("id")))


def _normalize(sampled: bool):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        from ..operators.normalize import outcomes
        from ..sources.generate import demo_snapshot, raw_events

        return outcomes(raw_events(spark, sf), demo_snapshot(sampled))

    return query


def _stream(sampled: bool):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        from ..streaming.loader import stream_once

        return stream_once(spark, sf, sampled)

    return query


def _answer(ask):
    """A question to a store that was loaded in batches and compacted, with copies that arrived after that on some days."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        from ..sources.answers import Answers
        from ..streaming.loader import stored_facts

        return ask(Answers(stored_facts(spark, facts(spark, sf), late_copies=True)))

    return query


def _by_user(ask):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        import uuid

        from ..sources.answers import facts_by_user
        from ..streaming.loader import stored_facts

        return ask(facts_by_user(stored_facts(spark, facts(spark, sf)), f"by_user_{uuid.uuid4().hex}", buckets=8))

    return query


def _replayed_set(spark: SparkSession, sf: str) -> DataFrame:
    """All events that had no schema are replayed in one job once it is registered; what became of each, and the versions that count."""
    from ..operators.normalize import ingest
    from ..sources.generate import demo_registry, raw_events
    from ..sources.store import EventStore
    from ..streaming.loader import work_dir

    registry = demo_registry(sampled=False)
    store = EventStore(spark, f"{work_dir(spark)}/store")
    store.load(ingest(raw_events(spark, sf), registry.snapshot()), 0, recent_minutes=None)
    registry.put_schema(PROJECT, "error", 1, registry.snapshot().find(PROJECT, "view", 1)[1])
    outcomes = store.replay_open(registry.snapshot(), PROJECT, dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc), "no schema is registered for event 'error'", recent_minutes=None)
    versions = Q.latest(store.quarantine()).join(outcomes.select("quarantine_id", "outcome"), "quarantine_id", "left")
    return versions.groupBy("status", F.coalesce("outcome", F.lit("")).alias("outcome")).agg(F.count("*").alias("n"))


def _remembering(spark: SparkSession, sf: str) -> DataFrame:
    from ..streaming.loader import stream_remembering

    return stream_remembering(spark, sf)


def _two_streams(spark: SparkSession, sf: str) -> DataFrame:
    from ..streaming.loader import stream_twice

    return stream_twice(spark, sf)


def _store(read):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        from ..streaming.loader import stored_facts

        return read(stored_facts(spark, facts(spark, sf)))

    return query


def _expired(store) -> DataFrame:
    """What is left on the 15th of April: ninety days of facts and sessions, and the whole rollup."""
    store.expire(dt.datetime(2024, 4, 15))
    tables = {"facts": store.facts(), "rollup": store.rollup().withColumn("day", F.col("month")), "sessions": store.sessions().select("day", "user_key").distinct()}
    counted = [table.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.min("day").alias("first")) for name, table in tables.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def _viewed(store) -> DataFrame:
    """The committed tables through their SQL views."""
    store.views("rillmark_")
    return store.spark.sql("SELECT day, count(*) AS events, (SELECT count(*) FROM rillmark_rollup) AS masks FROM rillmark_facts GROUP BY day")


def _next_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = _quarantine(spark, sf).withColumn("quarantine_id", F.concat(F.lit("00000000-0000-0000-0000-"), "quarantine_id"))
    _, cursor = Q.page(rows, PROJECT, 20)
    return Q.open_rows(rows, PROJECT, cursor).limit(20).select("quarantine_id", "message_id", "reason")


def _found(spark: SparkSession, sf: str) -> DataFrame:
    rows = _quarantine(spark, sf)
    least = rows.agg(F.min("quarantine_id")).first()[0]
    return Q.found(rows, PROJECT, least or "").select("quarantine_id", "message_id", "status")


def _listing(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog with a schema for every event that occurs, listed."""
    from ..sources.generate import demo_registry

    registry = demo_registry()
    spec = registry.snapshot().find(PROJECT, "view", 1)[1]
    for row in spark.read.parquet(f"{sf}/events.parquet").select("event_type").distinct().collect():  # as many as a catalog holds
        registry.put_schema(PROJECT, row[0], 1, spec)
    return registry.snapshot().listing(spark, PROJECT)


def _buckets(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.identity import bucket

    key = (F.col("event_id").cast("decimal(19,0)") * 7_919 - 50_000) * 1_000_000_007  # of both signs, and exact: 64 bits hold those of 1.1 million events
    return spark.read.parquet(f"{sf}/events.parquet").groupBy((bucket(key) % 100).alias("bucket")).agg(F.count("*").alias("n"), F.sum(bucket(key)).alias("total"))


def _replayed(spark: SparkSession, sf: str) -> DataFrame:
    """Two events that had no schema are replayed once it is registered; the versions that count, by reason."""
    from ..operators.normalize import ingest
    from ..sources.generate import demo_registry, raw_events
    from ..sources.store import EventStore
    from ..streaming.loader import work_dir

    registry = demo_registry(sampled=False)
    store = EventStore(spark, f"{work_dir(spark)}/store")
    store.load(ingest(raw_events(spark, sf), registry.snapshot()), 0)
    registry.put_schema(PROJECT, "error", 1, registry.snapshot().find(PROJECT, "view", 1)[1])
    missing = store.quarantine().where("reason like 'no schema %'").orderBy("received_at", "quarantine_id").limit(2)
    for row in missing.select("quarantine_id").collect():
        store.replay(registry.snapshot(), PROJECT, row[0], dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc))
    return Q.latest(store.quarantine()).groupBy("reason", "status").agg(F.count("*").alias("n"))


def _recent(spark: SparkSession, sf: str) -> DataFrame:
    """All events are delivered again, even ones after five minutes and odd ones after eleven; outcomes of that second delivery."""
    from ..operators.normalize import ingest
    from ..sources.generate import demo_snapshot, raw_events
    from ..sources.store import EventStore
    from ..streaming.loader import work_dir

    raw, snapshot = raw_events(spark, sf), demo_snapshot(sampled=False)
    store = EventStore(spark, f"{work_dir(spark)}/store")
    store.load(ingest(raw, snapshot), 0, recent_minutes=100 * 1_440)
    later = F.when(F.col("pos") % 2 == 0, F.expr("interval 5 minutes")).otherwise(F.expr("interval 11 minutes"))
    again = store.mark_seen(ingest(raw.withColumn("received_at", F.col("received_at") + later), snapshot), 10)
    return again.groupBy("status", F.when(F.col("status") == "duplicate", F.col("reason")).alias("why")).agg(F.count("*").alias("n"))


VALUES = 40


def _evolution(spark: SparkSession, sf: str) -> DataFrame:
    """Schemas follow the events: every day proposes the values seen so far as a property's list of values, and then, day by day
    again, so few of them as were seen then.  What the registry made of each proposal."""
    from ..sources.registry import Property, Registry, Spec

    events = spark.read.parquet(f"{sf}/events.parquet").select("event_type", F.dayofmonth("ts").alias("day"), (F.col("event_id") % VALUES).cast("string").alias("value"))
    firsts = events.groupBy("event_type", "value").agg(F.min("day").alias("day"))
    known = firsts.groupBy("event_type").agg(F.collect_list(F.struct("day", "value")).alias("values"))
    days = events.groupBy("event_type").agg(F.sort_array(F.collect_set("day")).alias("days"))
    registry, rows = Registry(), []
    registry.put_project(PROJECT)
    for name, values, own in sorted(map(tuple, known.join(days, "event_type").collect())):  # at most VALUES values and 31 days of an event
        for phase in ("grow", "shrink"):
            for day in own:
                seen = tuple(sorted(v["value"] for v in values if v["day"] <= day))
                outcome, reasons = registry.put_schema(PROJECT, name, 1, Spec({"kind": Property("string", False, seen), "value": Property("number", True)}))
                rows.append((name, phase, day, outcome, len(reasons)))
    return spark.createDataFrame(rows, "event_name string, phase string, day int, outcome string, n_reasons int")


_ENTRIES: dict[str, tuple] = {
    "segment_all": (_segment(Segment(JANUARY, project=PROJECT)), _segment_sql(Segment(JANUARY, project=PROJECT))),
    "segment_event": (_segment(Segment(JANUARY, "view", project=PROJECT), HALF), _segment_sql(Segment(JANUARY, "view", project=PROJECT), sampled=HALF)),
    "segment_eq": (_segment(_filter("k", "eq", "7")), _segment_sql(_filter("k", "eq", "7"), "coalesce(k, '') = '7'")),
    "segment_neq_missing": (_segment(_filter("k", "neq", "7")), _segment_sql(_filter("k", "neq", "7"), "coalesce(k, '') <> '7'")),
    "segment_in": (_segment(_filter("k", "in", "1", "2", "3", "")), _segment_sql(_filter("k", "in", "1"), "coalesce(k, '') IN ('1', '2', '3', '')")),
    "segment_gt": (_segment(_filter("value", "gt", "50")), _segment_sql(_filter("value", "gt", "50"), "value > 50")),
    "segment_lt": (_segment(_filter("k", "lt", "20.5")), _segment_sql(_filter("k", "lt", "20.5"), "try_cast(k AS DOUBLE) < 20.5")),
    "segment_late": (lambda s, d: G.late_events(facts(s, d), Segment(JANUARY, project=PROJECT)), _segment_sql(Segment(JANUARY, project=PROJECT), late=True)),
    "segment_scaled": (_segment(Segment(JANUARY, project=PROJECT), HALF), _segment_sql(Segment(JANUARY, project=PROJECT), sampled=HALF)),
    "funnel_3step": (_funnel(FUNNEL3), _funnel_sql(FUNNEL3)),
    "funnel_4step": (_funnel(FUNNEL4), _funnel_sql(FUNNEL4)),
    "funnel_tight": (_funnel(TIGHT), _funnel_sql(TIGHT)),
    "funnel_sampled": (_funnel(FUNNEL4, HALF), _funnel_sql(FUNNEL4, HALF)),
    "funnel_fold": (_funnel(FUNNEL4, fold=True), _funnel_sql(FUNNEL4)),
    "retention_events": (lambda s, d: R.retention_from_events(facts(s, d), RETENTION, UNSCALED), _retention_sql(RETENTION)),
    "retention_rollup": (lambda s, d: R.retention_from_rollup(M.month_masks(facts(s, d)), RETENTION, UNSCALED), _retention_sql(RETENTION)),
    "retention_join": (lambda s, d: R.retention_by_join(facts(s, d), RETENTION, UNSCALED), _retention_sql(RETENTION)),
    "retention_scaled": (lambda s, d: R.retention_from_rollup(M.month_masks(facts(s, d)), RETENTION, HALF), _retention_sql(RETENTION, HALF)),
    "funnel_stored_threshold": (_funnel(FUNNEL4, None), _funnel_sql(FUNNEL4, HALF)),
    "funnel_unsampled_steps": (_funnel(FUNNEL3, None), _funnel_sql(FUNNEL3)),
    "retention_stored_threshold": (lambda s, d: R.retention_from_rollup(M.month_masks(facts(s, d)), VIEWS), _retention_sql(VIEWS, HALF)),
    "retention_events_stored_threshold": (lambda s, d: R.retention_from_events(facts(s, d), VIEWS), _retention_sql(VIEWS, HALF)),
    "segment_stored_threshold": (_segment(Segment(JANUARY, project=PROJECT), None), _segment_sql(Segment(JANUARY, project=PROJECT), sampled=HALF)),
    "sessions_table": (lambda s, d: Z.sessions(facts(s, d)), _SESSIONS_SQL + " SELECT * FROM sessions"),
    "sessions_session_window": (lambda s, d: Z.sessions_by_window(facts(s, d)), _SESSIONS_SQL + " SELECT * FROM sessions"),
    "sessions_daily": (
        lambda s, d: Z.sessions_daily(Z.sessions(facts(s, d)), Sessions(JANUARY, project=PROJECT)),
        _SESSIONS_DAILY_SQL),
    "sampling_threshold": (
        lambda s, d: S.threshold_frame(M.month_masks(facts(s, d)), PROJECT, JANUARY, ["view", "click"]),
        f"WITH {CANONICAL_SQL} SELECT coalesce(nullif(min(sample_threshold), 0), 10000)::INTEGER AS threshold FROM facts WHERE NOT is_late AND event_name IN ('view', 'click') AND ts < TIMESTAMP '2024-02-01'"),
    "rollup_month_masks": (_rollup, _MASKS_SQL),
    "dedup_earliest": (
        lambda s, d: X.dedup_earliest(facts(s, d)).select("event_name", "user_key", "ts", "message_id", "received_at", "is_late"),
        f"WITH {CANONICAL_SQL} SELECT event_name, user_key, ts, message_id, make_timestamp(received_ms * 1000) AS received_at, is_late FROM deduped"),
    "quarantine_latest": (
        lambda s, d: Q.latest(_quarantine(s, d)).groupBy("reason", "status").agg(F.count("*").alias("n")),
        f"WITH {_QUARANTINE_CTE} SELECT reason, status, count(*) AS n FROM newest GROUP BY ALL"),
    "quarantine_page": (
        lambda s, d: Q.open_rows(_quarantine(s, d), PROJECT).limit(50).select("quarantine_id", "message_id", "reason"),
        f"WITH {_QUARANTINE_CTE} SELECT quarantine_id, message_id, reason FROM newest WHERE status = 'open' ORDER BY received_at DESC, quarantine_id DESC LIMIT 50"),
    "median_upper": (
        _median_upper,
        "SELECT event_type, count(*) AS n, list_sort(list(epoch_us(ts) // 1000))[count(*) // 2 + 1] AS median_ms FROM events GROUP BY event_type"),
    "numeric_text": (
        _numeric_text,
        f"WITH {CANONICAL_SQL} SELECT (try_cast(k AS DOUBLE) % 10)::INTEGER AS digit, count(*) AS n, sum(try_cast(k AS DOUBLE)) AS total FROM facts GROUP BY ALL"),
    "lateness_classes": (
        _lateness,
        "SELECT CASE event_id % 7 WHEN 0 THEN 'future' WHEN 6 THEN 'beyond_retention' WHEN 4 THEN 'late' WHEN 5 THEN 'late' ELSE 'on_time' END AS timing, count(*) AS n FROM events GROUP BY ALL"),
    "name_rules": (
        _names,
        "WITH w AS (SELECT unnest([c_name, c_mktsegment, '9' || c_name, replace(c_name, '#', ' ')]) AS name FROM customer) "
        "SELECT regexp_full_match(name, '[A-Za-z][A-Za-z0-9_.:-]{0,127}') AS event_ok, regexp_full_match(name, '[!-~]{1,128}') AS message_ok, count(*) AS n FROM w GROUP BY ALL"),
    "tenant_funnel": (lambda s, d: funnel(shared_facts(s, d), FUNNEL3), _shared(_funnel_sql(FUNNEL3))),
    "tenant_retention_events": (lambda s, d: R.retention_from_events(shared_facts(s, d), RETENTION), _shared(_retention_sql(RETENTION))),
    "tenant_retention_rollup": (lambda s, d: R.retention_from_rollup(M.month_masks(shared_facts(s, d)), RETENTION), _shared(_retention_sql(RETENTION))),
    "tenant_segment": (lambda s, d: G.segment(shared_facts(s, d), _filter("k", "eq", "7")), _shared(_segment_sql(_filter("k", "eq", "7"), "coalesce(k, '') = '7'"))),
    "tenant_segment_late": (lambda s, d: G.late_events(shared_facts(s, d), Segment(JANUARY, project=PROJECT)), _shared(_segment_sql(Segment(JANUARY, project=PROJECT), late=True))),
    "tenant_sessions_daily": (lambda s, d: Z.sessions_daily(Z.sessions(shared_facts(s, d)), Sessions(JANUARY, project=PROJECT)), _shared(_SESSIONS_DAILY_SQL)),
    "tenant_sampling_threshold": (
        lambda s, d: S.threshold_frame(M.month_masks(shared_facts(s, d)), PROJECT, JANUARY, ["view"]),
        f"WITH {SHARED_SQL} SELECT coalesce(nullif(min(sample_threshold), 0), 10000)::INTEGER AS threshold FROM facts WHERE NOT is_late AND event_name = 'view' AND ts < TIMESTAMP '2024-02-01'"),
    "quarantine_next_page": (
        _next_page,
        f"WITH {_QUARANTINE_CTE} SELECT '00000000-0000-0000-0000-' || quarantine_id AS quarantine_id, message_id, reason FROM newest WHERE status = 'open' ORDER BY received_at DESC, quarantine_id DESC LIMIT 20 OFFSET 20"),
    "quarantine_find": (
        _found,
        f"WITH {_QUARANTINE_CTE} SELECT quarantine_id, message_id, status FROM newest WHERE quarantine_id = (SELECT min(quarantine_id) FROM newest)"),
    "schema_listing": (
        _listing,
        """SELECT DISTINCT event_type AS event_name, 1 AS version, '{"k": {"type": "integer", "required": false}, "value": {"type": "number", "required": true}, "email": {"type": "string", "required": false}, """
        """"kind": {"type": "string", "required": false, "enum": ["a", "b"]}}' AS spec FROM events"""),
    "schema_evolution": (
        _evolution,
        f"""WITH e AS (SELECT event_type, day(ts)::INTEGER AS day, event_id % {VALUES} AS value FROM events), f AS (SELECT event_type, value, min(day) AS first FROM e GROUP BY ALL),
        d AS (SELECT DISTINCT event_type, day FROM e), sizes AS (SELECT d.event_type, d.day, count(*) AS size FROM d JOIN f ON f.event_type = d.event_type AND f.first <= d.day GROUP BY ALL),
        steps AS (SELECT *, lag(size) OVER w AS before, max(size) OVER (PARTITION BY event_type) AS whole FROM sizes WINDOW w AS (PARTITION BY event_type ORDER BY day))
        SELECT event_type AS event_name, 'grow' AS phase, day, CASE WHEN before IS NULL THEN 'created' WHEN size = before THEN 'unchanged' ELSE 'updated' END AS outcome, 0 AS n_reasons FROM steps
        UNION ALL SELECT event_type, 'shrink', day, CASE WHEN size = whole THEN 'unchanged' ELSE 'breaking' END, (whole - size)::INTEGER FROM steps"""),
    "user_buckets": (
        _buckets,
        "WITH k AS (SELECT ((event_id * 7919 - 50000) * 1000000007)::HUGEINT AS key FROM events), b AS (SELECT ((key + CASE WHEN key < 0 THEN 18446744073709551616::HUGEINT ELSE 0 END) % 10000)::INTEGER AS b FROM k) "
        "SELECT b % 100 AS bucket, count(*) AS n, sum(b)::BIGINT AS total FROM b GROUP BY ALL"),
    "quarantine_replay": (
        _replayed,
        f"WITH {RAW_SQL}, r AS (SELECT rejected AS reason, row_number() OVER (PARTITION BY rejected ORDER BY t) AS k FROM outcome WHERE status = 'quarantined') "
        "SELECT reason, CASE WHEN reason like 'no schema %' AND k <= 2 THEN 'replayed' ELSE 'open' END AS status, count(*) AS n FROM r GROUP BY ALL"),
    "recent_ids": (
        _recent,
        f"WITH {RAW_SQL}, again AS (SELECT CASE WHEN status = 'accepted' AND pos % 2 = 0 THEN 'duplicate' ELSE status END AS status, "
        "CASE WHEN status = 'accepted' AND pos % 2 = 0 THEN 'already accepted' WHEN status = 'duplicate' THEN 'repeated within the batch' END AS why FROM outcome) SELECT status, why, count(*) AS n FROM again GROUP BY ALL"),
    "answer_funnel": (_answer(lambda a: a.funnel(FUNNEL4)), _funnel_sql(FUNNEL4, HALF)),
    "answer_retention_rollup": (_answer(lambda a: a.retention(VIEWS)), _retention_sql(VIEWS, HALF)),
    "answer_retention_events": (_answer(lambda a: a.retention(replace(VIEWS, source="events"))), _retention_sql(VIEWS, HALF)),
    "answer_segment": (_answer(lambda a: a.segment(Segment(JANUARY, project=PROJECT))), _segment_sql(Segment(JANUARY, project=PROJECT), sampled=HALF)),
    "answer_late_events": (_answer(lambda a: a.late_events(Segment(JANUARY, project=PROJECT))), _segment_sql(Segment(JANUARY, project=PROJECT), late=True)),
    "answer_sessions": (_answer(lambda a: a.sessions(Sessions(JANUARY, project=PROJECT))), _SESSIONS_DAILY_SQL),
    "by_user_funnel": (_by_user(lambda table: funnel(table, FUNNEL4)), _funnel_sql(FUNNEL4, HALF)),
    "by_user_retention": (_by_user(lambda table: R.retention_from_events(table, VIEWS)), _retention_sql(VIEWS, HALF)),
    "quarantine_replay_set": (
        _replayed_set,
        f"""WITH {RAW_SQL}, r AS (SELECT *, CASE WHEN rejected NOT LIKE 'no schema %' THEN '' WHEN pos % 47 = 0 OR pos % 53 = 0 THEN 'still invalid'
            WHEN row_number() OVER (PARTITION BY message_id, rejected LIKE 'no schema %' AND NOT (pos % 47 = 0 OR pos % 53 = 0) ORDER BY t + CASE WHEN pos % 20 = 0 THEN 10800000 ELSE 1000 END) > 1 THEN 'duplicate'
            ELSE 'accepted' END AS outcome FROM outcome WHERE status = 'quarantined')
        SELECT CASE WHEN outcome IN ('accepted', 'duplicate') THEN 'replayed' ELSE 'open' END AS status, outcome, count(*) AS n FROM r GROUP BY ALL"""),
    "store_facts": (
        _store(lambda store: X.dedup_earliest(store.facts()).select("day", "event_name", "user_key", "ts", "message_id", "received_at", "is_late")),
        f"WITH {CANONICAL_SQL} SELECT ts::DATE AS day, event_name, user_key, ts, message_id, make_timestamp(received_ms * 1000) AS received_at, is_late FROM deduped"),
    "store_rollup": (_store(lambda store: store.rollup()), _MASKS_SQL),
    "store_sessions": (_store(lambda store: store.sessions()), _SESSIONS_SQL + " SELECT * FROM sessions"),
    "seed_shape": (_seed, seed_sql("(SELECT c_custkey AS id FROM customer)")),
    "normalize_rules": (outcomes_by_rule, ODD_SQL),
    "store_expired": (
        _store(_expired),
        f"WITH {CANONICAL_SQL} SELECT 'facts' AS name, count(*) AS n, min(ts::DATE) AS first FROM deduped WHERE ts::DATE >= DATE '2024-01-16' "
        f"UNION ALL SELECT 'rollup', count(DISTINCT (event_name, date_trunc('month', ts), user_key)), min(date_trunc('month', ts))::DATE FROM facts WHERE NOT is_late "
        f"UNION ALL SELECT 'sessions', count(DISTINCT (ts::DATE, user_key)), min(ts::DATE) FROM deduped WHERE NOT is_late AND ts::DATE >= DATE '2024-01-16'"),
    "store_views": (
        _store(_viewed),
        f"WITH {CANONICAL_SQL}, d AS (SELECT ts::DATE AS day, count(*) AS events FROM deduped GROUP BY ALL), m AS (SELECT count(DISTINCT (event_name, date_trunc('month', ts), user_key)) AS masks FROM facts WHERE NOT is_late) "
        "SELECT day, events, masks FROM d CROSS JOIN m"),
    "normalize_outcomes": (_normalize(True), None),
    "normalize_unsampled": (_normalize(False), f"WITH {RAW_SQL} SELECT status, CASE WHEN status = 'duplicate' THEN 'repeated within the batch' ELSE rejected END AS reason, count(*) AS n FROM outcome GROUP BY ALL"),
    "stream_load": (_stream(True), None),
    "stream_two_sources": (
        _two_streams,
        f"WITH {RAW_SQL.replace('PARTITION BY message_id,', 'PARTITION BY message_id, pos % 2,')} "
        "SELECT event_name, count(DISTINCT (user_id, t, message_id)) AS n, count(DISTINCT user_id) AS users FROM outcome WHERE status = 'accepted' GROUP BY ALL"),
    "stream_remembering": (
        _remembering,
        f"""WITH {RAW_SQL}, arrived AS (SELECT *, t + CASE WHEN pos % 20 = 0 THEN 10800000 ELSE 1000 END AS ms FROM judged WHERE rejected IS NULL),
            told AS (SELECT *, ms - lag(ms) OVER (PARTITION BY message_id ORDER BY ms, pos) AS since FROM arrived)
        SELECT event_name, count(DISTINCT (user_id, t, message_id)) AS n, count(DISTINCT user_id) AS users FROM told WHERE since IS NULL OR since > 600000 GROUP BY ALL"""),
    "stream_unsampled": (
        _stream(False),
        f"WITH {RAW_SQL} SELECT event_name, count(DISTINCT (user_id, t, message_id)) AS n, count(DISTINCT user_id) AS users FROM outcome WHERE status = 'accepted' GROUP BY ALL"),
}

QUERIES = {name: entry[0] for name, entry in _ENTRIES.items()}
ORACLES = {name: entry[1] for name, entry in _ENTRIES.items() if entry[1]}
