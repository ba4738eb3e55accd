"""The event store: Parquet tables below numbered manifests.

Every load writes directories of its own (``batch=<name>/<partition>=<value>``) and then one
manifest, a JSON document that names the live directories of each table by partition.  Readers
take the newest manifest, so a crash at any point costs nothing and counts nothing twice, and
what a reader or a load lists does not grow with the batches once loaded.

- A stream's batch is remembered by its writer's name; compaction, replays and expiry are
  manifests as well, but under names of their own, so they never take the id of a batch.
- Facts are partitioned by day, quarantine by day of arrival, the rollup by month, sessions by day
  and project.
- A load only marks the project days it brings facts of.  ``sessionize`` computes the sessions of all
  marked project days from those days alone, once however many loads marked them, and replaces
  them in one commit with the marks it has read; marks that come meanwhile stay for the next pass.
- Rollup rows are partial and merge on reading.
- Compaction of facts keeps one row per identity, in a directory whose name begins with ``unique-``;
  a day that consists of one such directory needs no search for copies.
- Two writers at once: the slower one finds its number taken, reads the new manifest and tries
  again.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.facts import FACT_SCHEMA, IDENTITY, dedup_earliest
from ..operators.quarantine import QUARANTINE_SCHEMA, find, latest, replayed
from ..operators.rollup import ROLLUP_SCHEMA, merged, month_masks
from ..operators.sessions import SESSION_SCHEMA, sessions
from ..plans.requests import Days
from .files import Numbered

FACT_DAYS, QUARANTINE_DAYS, ROLLUP_MONTHS = 90, 30, 25
RECENT_MINUTES = 10
ATTEMPTS = 10
#: Schema and partition column of each table.
TABLES = {
    "facts": (FACT_SCHEMA + ", day date", "day"),
    "quarantine": (QUARANTINE_SCHEMA + ", day date", "day"),
    "rollup": (ROLLUP_SCHEMA, "month"),
    "sessions": (SESSION_SCHEMA + ", part string", "part"),
    "dirty": ("project_id string, day date, marked_at timestamp, marked date", "marked"),
    "replays": ("project_id string, quarantine_id string, outcome string, reason string, replayed_at timestamp, day date", "day"),
    "recent": ("project_id string, message_id string, received_at timestamp, hour string", "hour"),
}
#: Changes of the manifest's layout by number, each made once (see bootstrap).
STEPS: dict[int, Callable[[dict], dict]] = {
    1: lambda state: state | {"tables": {name: {} for name in ("facts", "quarantine", "rollup", "sessions")} | state["tables"]},
    2: lambda state: state | {"tables": {"recent": {}} | state["tables"]},
    3: lambda state: state | {"tables": state["tables"] | {"sessions": {}}, "resweep": sorted(state["tables"].get("facts", {}))},  # sessions by day and project
}
UNIQUE = "unique-"
#: Bytes of a day's files that one task compacts; a larger day is dealt to several.
SLOT_BYTES = 16 * 1024 * 1024


class StoreConflict(RuntimeError):
    """Other writers were faster each time."""


class StoreGap(RuntimeError):
    """A stream goes on behind batches that the store has not got."""


def part_of(project_id, day):
    """Partition of a project's sessions of a day; begins with the day."""
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("-"), F.lower(F.hex(F.xxhash64(project_id))))


class EventStore:
    def __init__(self, spark: SparkSession, root: str):
        zone = spark._jvm.java.time.ZoneId.of(spark.conf.get("spark.sql.session.timeZone")).getRules()
        if not zone.isFixedOffset() or zone.getOffset(spark._jvm.java.time.Instant.EPOCH).getTotalSeconds():
            raise ValueError("days are UTC days: set spark.sql.session.timeZone to UTC")
        self.spark, self.root = spark, root.rstrip("/")
        self.log = Numbered(f"{self.root}/manifests", spark)

    # --- manifests ---

    def state(self) -> dict:
        """``seq``, ``applied`` (writer: last batch) and ``tables`` (table: partition: live directories)."""
        found = self.log.newest()
        state = json.loads(found[1]) if found else {"applied": {}, "tables": {}}
        state["seq"] = found[0] if found else 0
        for name in TABLES:
            state["tables"].setdefault(name, {})
        return state

    def applied(self, writer: str = "stream") -> int:
        """Id of the last batch of a writer, -1 if it has none."""
        return self.state()["applied"].get(writer, -1)

    def bootstrap(self) -> list[int]:
        """Makes the layout changes that this store has not seen yet, in order; their numbers."""
        made: list[int] = []

        def change(state: dict) -> dict | None:
            made[:] = [n for n in sorted(STEPS) if n not in state.get("steps", [])]
            for n in made:
                state = STEPS[n](state)
            return state | {"steps": sorted(STEPS)} if made else None

        self._commit(change)
        return made

    def _commit(self, change: Callable[[dict], dict | None]) -> bool:
        """Puts what ``change`` makes of the newest state; False if it has nothing to do."""
        for attempt in range(ATTEMPTS):
            state = self.state()
            after = change(state)
            if after is None:
                return False
            if self.log.put(state["seq"] + 1, json.dumps({k: v for k, v in after.items() if k != "seq"})):
                return True
            time.sleep(0.01 * attempt)
        raise StoreConflict

    # --- files ---

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _children(self, path: str) -> list:
        fs, p = self._fs(path)
        return list(fs.listStatus(p)) if fs.exists(p) else []

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _write(self, name: str, rows: DataFrame, batch: str) -> dict[str, list[str]]:
        """Writes one directory of a table; the partitions it got."""
        column = TABLES[name][1]
        path = f"{self.root}/{name}/batch={batch}"
        rows.write.mode("overwrite").partitionBy(column).parquet(path)
        return {s.getPath().getName().partition("=")[2]: [batch] for s in self._children(path) if s.isDirectory()}

    def _read(self, name: str, parts: dict[str, list[str]]) -> DataFrame:
        schema, column = TABLES[name]
        paths = [f"{self.root}/{name}/batch={b}/{column}={p}" for p, batches in sorted(parts.items()) for b in batches]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema + ", batch string").option("basePath", f"{self.root}/{name}").parquet(*paths).drop("batch")

    # --- reading ---

    def table(self, name: str, keep: Callable[[str], bool] = lambda part: True) -> DataFrame:
        """Committed rows; ``keep`` chooses partitions by their value, so others are not even listed."""
        return self._read(name, {p: b for p, b in self.state()["tables"][name].items() if keep(p)})

    def facts(self) -> DataFrame:
        return self.table("facts")

    def rollup(self) -> DataFrame:
        return merged(self.table("rollup"))

    def quarantine(self) -> DataFrame:
        return self.table("quarantine").drop("day")

    def sessions(self, days: Days | None = None) -> DataFrame:
        """Sessions as of the last :meth:`sessionize`; with ``days``, other days are not even listed."""
        return self.table("sessions", _among(days)).drop("part")

    def facts_of(self, days: Days | None = None) -> tuple[DataFrame, list[dt.date]]:
        """Facts of the days, and those days on which no identity stands twice."""
        keep = _among(days)
        parts = {day: b for day, b in self.state()["tables"]["facts"].items() if keep(day)}
        return self._read("facts", parts), [dt.date.fromisoformat(day) for day, b in sorted(parts.items()) if _is_unique(b)]

    def replays(self) -> DataFrame:
        """What became of every event that :meth:`replay_open` judged."""
        return self.table("replays").drop("day")

    def views(self, prefix: str = "") -> None:
        """Temporary views of the committed tables for SQL; made again, they show what was committed since."""
        for name in ("facts", "quarantine", "rollup", "sessions"):
            getattr(self, name)().createOrReplaceTempView(prefix + name)

    # --- writing ---

    def load(self, rows: DataFrame, batch: int, writer: str = "stream", recent_minutes: int | None = RECENT_MINUTES, persist: bool = True) -> bool:
        """One batch of normalised rows (see operators.normalize); False, and nothing done, if the writer's batch is in already.

        The rows are read twice and so persisted meanwhile; ``persist=False`` is for rows that are the same on every reading
        and cost less to read again than to keep."""
        if batch <= self.applied(writer):
            return False
        own = persist and not rows.is_cached
        rows = rows.persist() if own else rows
        try:
            return self._load(rows, f"{writer}-{batch}-{uuid.uuid4().hex[:8]}", {writer: batch}, recent_minutes)
        finally:
            if own:
                rows.unpersist()

    def _load(self, rows: DataFrame, name: str, applied: dict[str, int], recent_minutes: int | None) -> bool:
        accepted = rows.where("status = 'accepted'").select(*_names(FACT_SCHEMA)).withColumn("day", F.to_date("ts"))
        # Rebalanced by day: a day's rows stand together, and a large day is split by size, not by a fixed number.
        facts = self._write("facts", accepted.hint("rebalance", "day").sortWithinPartitions("day", "project_id", "event_name", "user_key", "ts"), name)
        rejected = rows.where("status = 'quarantined'").select(
            "project_id", "received_at", "quarantine_id", "message_id", "event_name", "reason", "payload", F.lit("open").alias("status"), F.col("received_at").alias("updated_at"), F.to_date("received_at").alias("day"))
        added = {"facts": facts, "quarantine": self._write("quarantine", rejected, name)}
        fresh = self._read("facts", facts)
        added["rollup"] = self._write("rollup", month_masks(fresh), name) if facts else {}
        if recent_minutes and facts:
            added["recent"] = self._remember(fresh, name, recent_minutes)
        added["dirty"] = self._mark(fresh, name) if facts else {}
        return self._add(added, applied, recent_minutes)

    def _mark(self, facts: DataFrame, name: str) -> dict[str, list[str]]:
        now = F.current_timestamp()
        return self._write("dirty", facts.select("project_id", "day").distinct().select("project_id", "day", now.alias("marked_at"), F.to_date(now).alias("marked")).coalesce(1), name)

    def _remember(self, facts: DataFrame, name: str, minutes: int) -> dict[str, list[str]]:
        """Ids of the hours that ``_add`` may keep; those of older hours, which it would drop at once, are not written."""
        newest = F.date_trunc("hour", F.max("received_at"))
        oldest = facts.agg(F.date_trunc("hour", newest - F.expr(f"interval {int(minutes)} minutes")).alias("oldest")).scalar()
        rows = facts.where(F.col("received_at") >= oldest)
        return self._write("recent", rows.select("project_id", "message_id", "received_at", F.date_format("received_at", "yyyy-MM-dd-HH").alias("hour")), name)

    def _add(self, added: dict[str, dict[str, list[str]]], applied: dict[str, int], recent_minutes: int | None = RECENT_MINUTES, unchanged: dict[str, list[str]] | None = None) -> bool:
        """Commits new directories.

        False, and nothing done, if one of the ``applied`` batches is in already, or one of the quarantine's partitions
        ``unchanged`` (partition: directories) is not."""

        def change(state: dict) -> dict | None:
            tables = state["tables"]
            if any(b <= state["applied"].get(w, -1) for w, b in applied.items()):
                return None
            if any(tables["quarantine"].get(part) != batches for part, batches in (unchanged or {}).items()):
                return None
            for name, parts in added.items():
                for part, batches in parts.items():
                    tables[name][part] = tables[name].get(part, []) + batches
            if tables["recent"] and recent_minutes:
                newest = dt.datetime.strptime(max(tables["recent"]), "%Y-%m-%d-%H")
                oldest = (newest - dt.timedelta(minutes=recent_minutes)).strftime("%Y-%m-%d-%H")
                tables["recent"] = {hour: b for hour, b in tables["recent"].items() if hour >= oldest}
            state["applied"] |= applied
            return state

        return self._commit(change)

    # --- sessions ---

    def sessionize(self) -> int:
        """Sessions of all project days that loads have marked, computed anew and put in place of the old ones in one commit
        with the marks; the number of project days.  Of two passes at once, one finds its marks gone and does nothing."""
        state = self.state()
        marks, resweep = state["tables"]["dirty"], state.get("resweep", [])
        if not marks and not resweep:
            return 0
        whole = [day for day in resweep if day in state["tables"]["facts"]]
        dirty = self._read("dirty", marks).select("project_id", "day")
        if whole:
            old = self._read("facts", {day: state["tables"]["facts"][day] for day in whole})
            dirty = dirty.unionByName(old.select("project_id", "day"))
        dirty = dirty.distinct().withColumn("part", part_of(F.col("project_id"), F.col("day"))).persist()
        try:
            parts = {r["part"]: r["day"].isoformat() for r in dirty.select("part", "day").collect()}  # as many as the manifest names anyway
            days = {day: state["tables"]["facts"][day] for day in set(parts.values()) if day in state["tables"]["facts"]}
            facts = self._read("facts", days).join(dirty.select("project_id", "day"), ["project_id", "day"], "left_semi")
            found = sessions(facts, single=[dt.date.fromisoformat(day) for day, b in days.items() if _is_unique(b)])
            made = self._write("sessions", found.withColumn("part", part_of(F.col("project_id"), F.col("day"))).hint("rebalance", "part"), f"sessions-{uuid.uuid4().hex[:8]}")
        finally:
            dirty.unpersist()

        def swap(state: dict) -> dict | None:
            tables = state["tables"]
            if any(not set(b) <= set(tables["dirty"].get(p, [])) for p, b in marks.items()) or state.get("resweep", []) != resweep:
                return None  # another pass has read them, from facts at least as new
            for p, b in marks.items():
                if not (left := [x for x in tables["dirty"].pop(p) if x not in b]):
                    continue
                tables["dirty"][p] = left
            for part, day in parts.items():
                tables["sessions"].pop(part, None)
                if part in made and day in tables["facts"]:  # else expired meanwhile
                    tables["sessions"][part] = made[part]
            return {k: v for k, v in state.items() if k != "resweep"}

        return len(parts) if self._commit(swap) else 0

    # --- recent message ids ---

    def mark_seen(self, rows: DataFrame, minutes: int | None = RECENT_MINUTES) -> DataFrame:
        """Accepted rows whose message id a committed batch accepted within ``minutes`` before become ``duplicate``.

        A cheap first layer that may miss copies, never more: counts rest on the facts' own deduplication.
        None turns it off."""
        recent = self.state()["tables"]["recent"]
        if not minutes or not recent:
            return rows
        seen = self._read("recent", recent).groupBy("project_id", "message_id").agg(F.max("received_at").alias("_seen"))
        accepted = F.col("status") == "accepted"
        until = F.col("_seen") + F.expr(f"interval {int(minutes)} minutes")
        key = F.when(accepted, F.col("message_id")).otherwise(F.concat(F.lit(" "), F.col("pos").cast("string")))  # no id has a space
        seen = seen.select(F.col("project_id").alias("_p"), F.col("message_id").alias("_m"), "_seen")
        joined = rows.withColumn("_key", key).join(seen, (F.col("project_id") == F.col("_p")) & (F.col("_key") == F.col("_m")), "left")
        joined = joined.withColumn("_again", F.coalesce(F.col("received_at") <= until, F.lit(False)))
        joined = joined.withColumn("reason", F.when(F.col("_again"), "already accepted").otherwise(F.col("reason")))
        return joined.withColumn("status", F.when(F.col("_again"), "duplicate").otherwise(F.col("status"))).drop("_p", "_m", "_key", "_seen", "_again")

    # --- replay ---

    def replay(self, snapshot, project_id: str, quarantine_id: str, now: dt.datetime) -> tuple[str, str | None]:
        """Judges a quarantined event again, as of its own arrival: its outcome and the reason.

        ``unknown``, ``already replayed`` and ``still invalid`` change nothing; ``accepted``, ``sampled_out`` and
        ``duplicate`` (the id was accepted lately) close the event, the first one with its fact, in one commit."""
        from ..operators.normalize import Normalizer, rows_frame

        for _ in range(ATTEMPTS):
            parts = self.state()["tables"]["quarantine"]
            row = find(self._read("quarantine", parts).drop("day"), project_id, quarantine_id)
            if row is None or project_id not in snapshot.projects:
                return "unknown", None
            if row["status"] != "open":
                return "already replayed", None
            arrived = row["received_at"].astimezone(dt.timezone.utc)
            judged = Normalizer(snapshot)(project_id, row["payload"], arrived)
            status, reason, name = judged["status"], None, f"replay-{uuid.uuid4().hex[:8]}"
            if status == "quarantined":
                return "still invalid", judged["reason"]
            if status == "accepted":
                marked = self.mark_seen(rows_frame(self.spark, [judged | {"received_at": now.astimezone(dt.timezone.utc)}])).first()
                status, reason = marked["status"], marked["reason"]
            day = arrived.date()
            closed = self.spark.createDataFrame([(*replayed(row, now), day)], TABLES["quarantine"][0])
            added = {"quarantine": self._write("quarantine", closed, name)}
            if status == "accepted":
                added["facts"] = self._write("facts", rows_frame(self.spark, [judged]).select(*_names(FACT_SCHEMA)).withColumn("day", F.to_date("ts")), name)
                fresh = self._read("facts", added["facts"])
                added["rollup"] = self._write("rollup", month_masks(fresh), name)
                added["recent"] = self._remember(fresh.withColumn("received_at", F.lit(now)), name, RECENT_MINUTES)
                added["dirty"] = self._mark(fresh, name)
            # A second replay at the same time has changed the partition first, or finds it changed.
            if self._add(added, {}, unchanged={day.isoformat(): parts[day.isoformat()]}):
                return status, reason
        raise StoreConflict

    def replay_open(self, snapshot, project_id: str, now: dt.datetime, reason: str | None = None, recent_minutes: int | None = RECENT_MINUTES) -> DataFrame:
        """Judges all open events of a project (of one reason, if given) again, each as of its own arrival, in one job and one commit.

        ``quarantine_id, outcome, reason``, one row an event: ``still invalid`` changes nothing; ``accepted``, ``sampled_out`` and
        ``duplicate`` (accepted lately, or twice among these) close the event, the first one with its fact."""
        from ..operators.normalize import mark_duplicates, normalize

        at = now if now.tzinfo else now.replace(tzinfo=dt.timezone.utc)
        for _ in range(ATTEMPTS):
            parts, name = self.state()["tables"]["quarantine"], f"replay-{uuid.uuid4().hex[:8]}"
            rows = latest(self._read("quarantine", parts).where(F.col("project_id") == project_id)).where("status = 'open'")
            rows = rows if reason is None else rows.where(F.col("reason") == reason)
            raw = rows.select("project_id", F.col("payload").alias("raw"), "received_at", F.unix_micros("received_at").alias("pos"), "quarantine_id")
            judged = mark_duplicates(normalize(raw, snapshot, key="quarantine_id"))
            # An id counts as seen if it was accepted lately by the clock of the replay, not of the arrival.
            seen = self.mark_seen(judged.withColumn("arrived", F.col("received_at")).withColumn("received_at", F.lit(at)), recent_minutes)
            judged = seen.withColumn("received_at", F.col("arrived")).drop("arrived").persist()
            try:
                outcome = F.when(F.col("status") == "quarantined", "still invalid").otherwise(F.col("status"))
                found = judged.select("project_id", F.col("key").alias("quarantine_id"), outcome.alias("outcome"), "reason", F.lit(at).alias("replayed_at"), F.to_date(F.lit(at)).alias("day"))
                added = {"replays": self._write("replays", found, name)}
                closing = judged.where("status <> 'quarantined'").select(F.col("key").alias("quarantine_id"))
                closed = rows.join(closing, "quarantine_id", "left_semi").withColumn("status", F.lit("replayed")).withColumn("updated_at", F.lit(at))
                added["quarantine"] = self._write("quarantine", closed, name)
                added["facts"] = self._write("facts", judged.where("status = 'accepted'").select(*_names(FACT_SCHEMA)).withColumn("day", F.to_date("ts")).hint("rebalance", "day"), name)
            finally:
                judged.unpersist()
            if added["facts"]:
                fresh = self._read("facts", added["facts"])
                added |= {"rollup": self._write("rollup", month_masks(fresh), name), "dirty": self._mark(fresh, name)}
                if recent_minutes:
                    added["recent"] = self._remember(fresh.withColumn("received_at", F.lit(at)), name, recent_minutes)
            if self._add(added, {}, recent_minutes, unchanged={day: parts[day] for day in added["quarantine"]}):
                return self._read("replays", added["replays"]).select("quarantine_id", "outcome", "reason")
        raise StoreConflict

    # --- upkeep ---

    def compact(self, name: str, least: int = 2, keep: Callable[[str], bool] = lambda part: True) -> int:
        """Merges the directories of each partition (that ``keep`` chooses by its value) that has at least ``least``; answers do not change.

        Rollup rows are merged to one per key, facts to one per identity (the copy that arrived first), and the directory says
        so by its name; other rows are kept as they are.  Returns the number of partitions rewritten."""
        before = {p: b for p, b in self.state()["tables"][name].items() if len(b) >= least and keep(p) and not (name == "facts" and _is_unique(b))}
        if not before:
            return 0
        rows, column = self._read(name, before), TABLES[name][1]
        order = {"facts": ["project_id", "event_name", "user_key", "ts"], "rollup": ["project_id", "event_name", "user_key"]}.get(name, ["project_id"])
        if name == "facts":  # copies are searched where the files are made: rows are exchanged and sorted once
            dealt = rows.withColumn("_slot", self._slot(before)).repartition(column, "_slot")
            rows = dedup_earliest(dealt, order=[column, *order, "message_id", "_slot"]).drop("_slot")
        else:
            rows = merged(rows) if name == "rollup" else rows.hint("rebalance", column)
        new = self._write(name, rows.sortWithinPartitions(column, *order), f"{UNIQUE if name == 'facts' else 'compact-'}{uuid.uuid4().hex[:8]}")

        def swap(state: dict) -> dict | None:
            parts = state["tables"][name]
            if any(not set(b) <= set(parts.get(p, [])) for p, b in before.items()):
                return None  # expired or compacted meanwhile: the new directories stay unnamed
            for part, batches in before.items():
                parts[part] = [b for b in parts[part] if b not in batches] + new.get(part, [])
            return state

        return len(before) if self._commit(swap) else 0

    def _slot(self, days: dict[str, list[str]]) -> Column:
        """Which of its day's tasks a fact goes to; copies go to the same one."""
        slots = []
        for day, batches in days.items():
            files = [self._fs(f"{self.root}/facts/batch={b}/day={day}") for b in batches]
            size = sum(fs.getContentSummary(path).getLength() for fs, path in files)
            slots += [F.lit(dt.date.fromisoformat(day)), F.lit(max(1, -(-size // SLOT_BYTES)))]
        return F.pmod(F.xxhash64(*IDENTITY), F.create_map(*slots)[F.col("day")])

    def expire(self, now: dt.datetime) -> None:
        """Drops partitions older than their table keeps; the rollup outlives the facts."""
        day = lambda days: (now.date() - dt.timedelta(days=days)).isoformat()
        months = now.year * 12 + now.month - 1 - ROLLUP_MONTHS
        least = {
            "facts": day(FACT_DAYS), "sessions": day(FACT_DAYS), "quarantine": day(QUARANTINE_DAYS), "replays": day(QUARANTINE_DAYS), "rollup": f"{months // 12:04d}-{months % 12 + 1:02d}-01",
            "recent": (now - dt.timedelta(minutes=RECENT_MINUTES)).strftime("%Y-%m-%d-%H"),
        }

        def drop(state: dict) -> dict:
            for name, oldest in least.items():
                state["tables"][name] = {p: b for p, b in state["tables"][name].items() if p >= oldest}
            return state

        self._commit(drop)

    def vacuum(self, older_than: dt.timedelta = dt.timedelta(days=1)) -> int:
        """Deletes directories no manifest names any more, and old enough that no load or reader is at work with them."""
        live = {(t, b) for t, parts in self.state()["tables"].items() for batches in parts.values() for b in batches}
        named = {(t, b, p) for t, parts in self.state()["tables"].items() for p, batches in parts.items() for b in batches}
        limit = (time.time() - older_than.total_seconds()) * 1000
        gone = 0
        for table in TABLES:
            for directory in self._children(f"{self.root}/{table}"):
                batch = directory.getPath().getName().partition("=")[2]
                if (table, batch) not in live:
                    parts = [directory]
                else:
                    parts = [s for s in self._children(directory.getPath().toString()) if s.isDirectory() and (table, batch, s.getPath().getName().partition("=")[2]) not in named]
                for status in parts:
                    if status.getModificationTime() <= limit:
                        self._delete(status.getPath().toString())
                        gone += 1
        return gone


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _is_unique(batches: list[str]) -> bool:
    return len(batches) == 1 and batches[0].startswith(UNIQUE)


def _among(days: Days | None) -> Callable[[str], bool]:
    """Whether a partition whose value begins with a day lies in the range."""
    return lambda part: days is None or days.start.isoformat() <= part[:10] <= days.end.isoformat()


def expired(table: str, df: DataFrame, now: dt.datetime) -> DataFrame:
    """The rows of a table that are still kept at ``now``."""
    day = F.lit(now.date())
    if table == "rollup":
        return df.where(F.col("month") >= F.add_months(F.trunc(day, "month"), -ROLLUP_MONTHS))
    if table == "quarantine":
        return df.where(F.to_date("received_at") >= F.date_sub(day, QUARANTINE_DAYS))
    return df.where((F.col("day") if "day" in df.columns else F.to_date("ts")) >= F.date_sub(day, FACT_DAYS))
