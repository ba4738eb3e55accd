"""Streaming load: raw events from files (or Kafka) into the event store.

Lateness is a stored column of the arrival clock, so no watermark ever drops an event.  The
checkpoint and the store's commits together load every batch exactly once.
"""

from __future__ import annotations

import logging
import time
import uuid
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions.identity import key_bytes
from ..operators.normalize import ingest
from ..sources.registry import Registry, Snapshot
from ..sources.store import RECENT_MINUTES, EventStore, StoreGap

LOG = logging.getLogger(__name__)
BACKOFF_S, BACKOFF_MAX_S = 0.1, 30.0
SESSION_SECONDS = 15.0
OFFSET_BITS = 20
STATUSES = ("accepted", "sampled_out", "duplicate", "quarantined", "unreadable")


def log_rows(events: DataFrame) -> DataFrame:
    """``key, value`` of raw events (``project_id, raw, user_key``): a user's in one partition, the project in the value."""
    return events.select(key_bytes(F.col("user_key")).alias("key"), F.to_json(F.struct("project_id", "raw")).cast("binary").alias("value"))


def events_of(rows: DataFrame) -> DataFrame:
    """The events again, from ``value, timestamp, offset`` of a topic's rows.

    ``pos`` orders by arrival, then by offset: offsets of different partitions have no order.  A value that does not read
    has no project, and is counted as unreadable."""
    value = F.from_json(F.col("value").cast("string"), "project_id string, raw string")
    arrived = F.unix_millis(F.date_trunc("millisecond", F.col("timestamp")))
    pos = F.shiftleft(arrived, OFFSET_BITS).bitwiseOR(F.col("offset").cast("long").bitwiseAND(F.lit((1 << OFFSET_BITS) - 1)))
    return rows.select(value.alias("e"), F.col("timestamp").alias("received_at"), pos.alias("pos")).select("e.project_id", "e.raw", "received_at", "pos")


def kafka_source(spark: SparkSession, servers: str, topic: str, max_offsets: int = 50_000) -> DataFrame:
    """``project_id, raw, received_at, pos`` from a topic that :func:`kafka_sink` fills (needs Spark's Kafka package)."""
    return events_of(spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("maxOffsetsPerTrigger", max_offsets).load())


def file_source(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """The same columns from JSON lines that arrive as files."""
    return spark.readStream.schema("project_id string, raw string, received_at timestamp, pos long").option("maxFilesPerTrigger", max_files).json(path)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a checkpoint gives its query; the same after a restart, another one for every other checkpoint."""
    return spark.read.text(f"{checkpoint.rstrip('/')}/metadata").select(F.get_json_object("value", "$.id")).first()[0]


def expected(store: EventStore, batch_id: int, writer: str) -> bool:
    """Whether the batch is the writer's next one; False if the store has it, an error if it has not got those before."""
    last = store.applied(writer)
    if batch_id > last + 1:
        raise StoreGap(f"batch {batch_id} of {writer} follows batch {last} of this store: the batches between went elsewhere; begin with a new checkpoint")
    return batch_id > last


def load_batch(store: EventStore, rows: DataFrame, batch_id: int, writer: str) -> None:
    """One batch of rows that are judged already."""
    if expected(store, batch_id, writer):
        store.load(rows, batch_id, writer, recent_minutes=None)


def batch_writer(
    store: EventStore, catalog: Registry | Snapshot, writer: str | Callable[[], str], retries: int = 5, recent_minutes: int | None = RECENT_MINUTES, metrics: LoadMetrics | None = None,
) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: normalise with the newest catalog, mark ids accepted lately, load, and try the same batch again on failure.

    ``writer`` names the stream: batches count for each name on its own, so streams that share a store, or one that begins
    anew, lose nothing.  A batch behind one that the store has not got is refused."""
    names: list[str] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        if not names:
            names.append(writer() if callable(writer) else writer)
        if not expected(store, batch_id, names[0]):
            return
        snapshot = catalog.refresh() if isinstance(catalog, Registry) else catalog
        judged = store.mark_seen(ingest(batch, snapshot), recent_minutes)
        seen = Observation()
        counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
        rows = judged.observe(seen, *counts).persist()
        try:
            wait = BACKOFF_S
            for left in range(retries, -1, -1):
                try:
                    loaded = store.load(rows, batch_id, names[0], recent_minutes=recent_minutes)
                    if loaded and metrics is not None:
                        metrics.add(names[0], seen.get)
                    return
                except Exception:
                    if not left:
                        raise
                    time.sleep(wait)
                    wait = min(2 * wait, BACKOFF_MAX_S)
        finally:
            rows.unpersist()

    return write


class LoadMetrics(StreamingQueryListener):
    """What running loads report: outcomes, counted while the rows are loaded, and how far each stream is behind.

    ``spark.streams.addListener(metrics)`` makes Spark push the progress; ``sink``, if given, gets every report as a dict."""

    def __init__(self, sink: Callable[[dict], None] | None = None):
        self.outcomes: dict[str, Counter] = {}
        self.progress: dict[str, dict] = {}
        self.ended: dict[str, str | None] = {}
        self.sink = sink

    def add(self, writer: str, counts: dict) -> None:
        self.outcomes.setdefault(writer, Counter()).update(counts)
        self._report({"stream": writer, "outcomes": dict(counts)})

    def _report(self, what: dict) -> None:
        if self.sink:
            self.sink(what)

    def onQueryStarted(self, event) -> None:
        self._report({"stream": str(event.id), "started": event.timestamp})

    def onQueryProgress(self, event) -> None:
        found = lag_of(event.progress)
        self.progress[str(event.progress.id)] = found
        self._report({"stream": str(event.progress.id)} | found)

    def onQueryIdle(self, event) -> None:
        self._report({"stream": str(event.id), "idle": event.timestamp})

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.id)] = event.exception
        self._report({"stream": str(event.id), "ended": event.exception})


def kafka_sink(rows: DataFrame, servers: str, topic: str) -> None:
    """Raw events (``project_id, raw, user_key``) to a topic, one user's in one partition (needs Spark's Kafka package)."""
    options = {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", "kafka.enable.idempotence": "true", "kafka.compression.type": "lz4"}
    log_rows(rows).write.format("kafka").options(**options).save()


def file_sink(rows: DataFrame, path: str) -> None:
    """The same events as JSON lines that :func:`file_source` reads."""
    rows.select("project_id", "raw", "received_at", "pos").write.mode("append").json(path)


def start(
    stream: DataFrame, store: EventStore, catalog: Registry | Snapshot, checkpoint: str, available_now: bool = True, recent_minutes: int | None = RECENT_MINUTES, metrics: LoadMetrics | None = None,
):
    """Loads a stream; the store counts its batches under the id of the checkpoint."""
    spark = stream.sparkSession
    write = batch_writer(store, catalog, lambda: stream_id(spark, checkpoint), recent_minutes=recent_minutes, metrics=metrics)
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def start_sessionizer(store: EventStore, checkpoint: str, seconds: float = SESSION_SECONDS):
    """A job of its own interval that makes the sessions of the project days marked since its last pass.

    Spark's clock source ticks it; a pass that fails is logged and made again at the next tick, as its marks stay."""

    def tick(_: DataFrame, __: int) -> None:
        try:
            store.sessionize()
        except Exception:
            LOG.exception("a pass of the sessionizer failed")

    clock = store.spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    return clock.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=f"{int(seconds * 1000)} milliseconds").start()


def lag_of(last) -> dict:
    metrics = [s.metrics or {} for s in last.sources]
    behind = [int(m["maxOffsetsBehindLatest"]) for m in metrics if "maxOffsetsBehindLatest" in m]
    return {"batch": last.batchId, "input_rows_per_second": last.inputRowsPerSecond, "processed_rows_per_second": last.processedRowsPerSecond, "behind": max(behind, default=None)}


def lag(query) -> dict:
    """How far a running load is behind: last batch, rows a second in and through, and offsets not read yet where the source tells."""
    last = query.lastProgress
    return lag_of(last) if last else {"batch": None, "input_rows_per_second": 0.0, "processed_rows_per_second": 0.0, "behind": None}


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; without that, a temporary one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="rillmark-stream")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events as a stream of raw events."""
    from ..sources.generate import raw_from

    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return raw_from(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def loaded(store: EventStore) -> DataFrame:
    """``event_name, n, users`` of a store, deduplicated."""
    from ..operators.facts import dedup_earliest

    return dedup_earliest(store.facts().drop("properties")).groupBy("event_name").agg(F.count("*").alias("n"), F.count_distinct("user_key").alias("users"))


def stream_once(spark: SparkSession, sf_dir: str, sampled: bool = True) -> DataFrame:
    """The driver's events through the whole stream; returns ``event_name, n, users`` of the deduplicated store."""
    from ..sources.generate import demo_snapshot

    root = work_dir(spark)
    store = EventStore(spark, f"{root}/store")
    start(event_stream(spark, sf_dir), store, demo_snapshot(sampled), f"{root}/checkpoint").awaitTermination()
    return loaded(store)


def stream_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams, with the even and the odd events, into one store, the second one twice: again with a fresh checkpoint."""
    from ..sources.generate import demo_snapshot

    root, snapshot = work_dir(spark), demo_snapshot(False)
    store = EventStore(spark, f"{root}/store")
    for odd, checkpoint in ((0, "even"), (1, "odd"), (1, "again")):
        half = event_stream(spark, sf_dir).where(F.col("pos") % 2 == odd)
        start(half, store, snapshot, f"{root}/{checkpoint}", recent_minutes=None).awaitTermination()
    return loaded(store)


def stream_remembering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events with copies told by the stream's state: ``event_name, n, users`` of the store."""
    from ..sources.generate import demo_snapshot
    from .recent import start_remembering

    root = work_dir(spark)
    store = EventStore(spark, f"{root}/store")
    start_remembering(event_stream(spark, sf_dir), store, demo_snapshot(False), f"{root}/checkpoint").awaitTermination()
    return loaded(store)


def stored_facts(spark: SparkSession, facts: DataFrame, parts: int = 3, late_copies: bool = False) -> EventStore:
    """A store that got ``facts`` in batches, one of them twice, and was compacted in between.

    With ``late_copies`` those of every third day arrive once more, an hour later, after the compaction."""
    from ..operators.normalize import SCHEMA

    store = EventStore(spark, f"{work_dir(spark)}/store")
    more = {"status": F.lit("accepted"), "reason": F.lit(None).cast("string"), "payload": F.lit(None).cast("string"), "quarantine_id": F.lit(None).cast("string"), "pos": F.lit(0).cast("long")}
    rows = facts.withColumns(more).select(*[f.split()[0] for f in SCHEMA.split(", ")])
    part = F.pmod(F.xxhash64("message_id", "received_at"), F.lit(parts))
    for batch in range(parts):
        for _ in range(1 + batch % 2):
            store.load(rows.where(part == batch), batch, persist=False)
        if not batch:
            store.compact("rollup", 1)
    store.compact("facts", 1)
    if late_copies:
        store.load(rows.where(F.dayofmonth("ts") % 3 == 0).withColumn("received_at", F.expr("received_at + interval 1 hour")), parts, persist=False)
    store.sessionize()
    return store
