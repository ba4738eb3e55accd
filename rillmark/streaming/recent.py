"""Recent message ids as state of the stream: a copy that arrives within some minutes is marked.

For every (project, message id) the stream keeps when it was last accepted.  Ids share a state by their hash (``SHARES`` of them
for a project), so a batch reads and writes as many states at most, not one for each id.  Copies are judged by the
arrival clock of the events; an id is dropped by the wall clock once it is as old, so
the state holds the ids of some minutes and no more.  It is written with the stream's checkpoint, so it survives a restart, and
an id is remembered only together with the batch that was loaded.  This layer spares the store most copies; counts
rest on the facts' own deduplication.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from ..operators.normalize import SCHEMA, normalize
from ..sources.registry import Snapshot
from ..sources.store import RECENT_MINUTES, EventStore

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: States of a project; part of the state's layout, so another number needs a new checkpoint.
SHARES = 4_096
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


def recent_ids(minutes: float) -> StatefulProcessor:
    """The state of the ids of one share.  The class is made here because Spark starts a process of its own for it on the driver,
    which has not got this package: a class of a function travels whole."""
    names, limit = list(NAMES), int(minutes * 60_000)

    class RecentIds(StatefulProcessor):
        def init(self, handle) -> None:
            self.seen = handle.getValueState("seen", "ids array<string>, arrived array<long>, kept array<long>", ttlDurationMs=limit)

        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
            now, known, changed = timerValues.getCurrentProcessingTimeInMs(), {}, False
            if self.seen.exists():
                known = {i: (at, kept) for i, at, kept in zip(*self.seen.get(), strict=True) if kept + limit > now}
            for r in sorted(rows, key=lambda r: (r["arrived_ms"] or 0, r["pos"] or 0)):
                values = {n: r[n] for n in names}
                if r["status"] == "accepted":
                    last = known.get(r["message_id"])
                    if last is not None and r["arrived_ms"] <= last[0] + limit:
                        values |= {"status": "duplicate", "reason": "already accepted"}
                    else:
                        known[r["message_id"]], changed = (r["arrived_ms"], now), True
                yield Row(**values)
            if changed:
                self.seen.update(([*known], [at for at, _ in known.values()], [kept for _, kept in known.values()]))

        def close(self) -> None:
            pass

    return RecentIds()


def mark_recent(rows: DataFrame, minutes: float = RECENT_MINUTES) -> DataFrame:
    """Normalised rows of a stream; accepted ones whose id was accepted up to ``minutes`` before become ``duplicate``."""
    # Rows that cannot be duplicates are dealt by position and leave no state.
    dealt = F.when(F.col("status") == "accepted", F.xxhash64("message_id")).otherwise(F.xxhash64("pos"))
    keyed = rows.withColumn("project_key", F.coalesce("project_id", F.lit(""))).withColumn("share", F.pmod(dealt, F.lit(SHARES)).cast("int")).withColumn("arrived_ms", F.unix_millis("received_at"))
    return keyed.groupBy("project_key", "share").transformWithState(
        statefulProcessor=recent_ids(minutes), outputStructType=StructType.fromDDL(SCHEMA), outputMode="append", timeMode="ProcessingTime")


def start_remembering(stream: DataFrame, store: EventStore, snapshot: Snapshot, checkpoint: str, minutes: float = RECENT_MINUTES, available_now: bool = True):
    """Loads a stream whose copies of the last minutes are told by its own state, not by the store's list of ids.

    ``available_now`` takes what there is as one batch: state with a time to live makes Spark run empty batches for as long
    as it may, so a query that waits for the last of them never ends."""
    from .loader import load_batch, stream_id

    spark: SparkSession = stream.sparkSession
    conf, key = spark.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key)
    rows = mark_recent(normalize(stream, snapshot), minutes)

    def write(batch: DataFrame, batch_id: int) -> None:
        load_batch(store, batch, batch_id, stream_id(spark, checkpoint))

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(once=True) if available_now else writer.trigger(processingTime="1 second")
    conf.set(key, PROVIDER)  # read when the query starts
    try:
        return writer.start()
    finally:
        conf.set(key, before)
