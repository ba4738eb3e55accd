"""The questions over an event store, one call each.

Each reads only the partitions of its days, scales by the stored threshold within its own plan, takes
the source that the request names, and searches for copies only on days that may hold some.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from ..operators.facts import dedup_earliest
from ..operators.funnel import funnel
from ..operators.retention import retention_from_events, retention_from_rollup
from ..operators.sampling import sampling_for
from ..operators.segment import late_events, segment
from ..operators.sessions import sessions_daily
from ..plans.requests import Days, Funnel, Retention, Sampled, Segment, Sessions
from .store import EventStore

BUCKETS = 64


class Answers:
    def __init__(self, store: EventStore):
        self.store = store

    def _facts(self, days: Days) -> tuple[DataFrame, bool | list[dt.date]]:
        facts, single = self.store.facts_of(days)
        stored = {d for d in self.store.state()["tables"]["facts"] if days.start.isoformat() <= d <= days.end.isoformat()}
        return facts, len(single) == len(stored) or single

    def _rollup(self, days: Days) -> DataFrame:
        """Partial rows of the months touched; what reads them merges by itself."""
        first = days.start.replace(day=1).isoformat()
        return self.store.table("rollup", lambda month: first <= month <= days.end.isoformat())

    def funnel(self, q: Funnel) -> DataFrame:
        days = Days(q.days.start, q.days.end + dt.timedelta(days=1, seconds=q.window_seconds))
        return funnel(self._facts(days)[0], q, rollup=self._rollup(days))

    def retention(self, q: Retention) -> DataFrame:
        """From the rollup or the events, as the request says."""
        days = Days(q.days.start, q.days.end + dt.timedelta(days=q.follow))
        if q.source == "rollup":
            return retention_from_rollup(self._rollup(days), q)
        return retention_from_events(self._facts(days)[0], q, rollup=self._rollup(days))

    def segment(self, q: Segment) -> DataFrame:
        facts, single = self._facts(q.days)
        return segment(facts, q, rollup=self._rollup(q.days), single=single)

    def late_events(self, q: Segment) -> DataFrame:
        facts, single = self._facts(q.days)
        return late_events(facts, q, single)

    def sessions(self, q: Sessions) -> DataFrame:
        return sessions_daily(self.store.sessions(q.days), q)

    def sampling(self, project: str, days: Days, events: list[str] | None = None) -> Sampled:
        """The threshold that the answers of these days and events are scaled by, to be shown beside them."""
        return sampling_for(self._rollup(days), project, days, events)


def facts_by_user(store: EventStore, name: str, days: Days | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The facts of the days, one of each, as the table ``name`` in ``buckets`` buckets by user, sorted by user and time.

    Funnels and retention over it need no exchange by user, however often they are asked.  The table is a copy of what is
    committed now; made again, it holds what was committed since.  A bucket is one file, so ``buckets`` grows with the facts."""
    facts, single = store.facts_of(days)
    rows = dedup_earliest(facts, single).drop("day").repartition(buckets, "user_key").sortWithinPartitions("user_key", "ts")
    written = rows.write.mode("overwrite").format("parquet").bucketBy(buckets, "user_key").sortBy("user_key", "ts")
    written.option("path", f"{store.root}/by_user/{name}").saveAsTable(name)
    return store.spark.table(name)
