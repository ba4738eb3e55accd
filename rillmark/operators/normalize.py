"""Validation and normalisation of raw events.

A raw event becomes accepted, sampled_out or quarantined (with the first reason that applies,
as text); ``duplicate`` is decided among the accepted ones of a batch.  Events that meet all rules
are judged by column expressions (``accept``).  The rest, as a rule few, goes through an Arrow map that
says why: repeated keys and up to ten reasons in the order of the text have no built-in expression.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from json.encoder import encode_basestring_ascii as quoted

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.identity import BUCKETS, bucket_of, key_of
from ..functions.numbers import canonical
from ..functions.ship import ship_code
from ..plans.requests import EVENT_NAME, RequestError
from ..sources.registry import Property, Settings, Snapshot, Spec
from .reasons import BAD_IDENTITY, BAD_VERSION, IN_FUTURE, MUST_BE, NO_EVENT, NO_IDENTITY, NO_MESSAGE_ID, NO_TIMESTAMP, NOT_OBJECT, NOT_PROPERTIES, TOO_LARGE, TOO_OLD

MESSAGE_ID = re.compile(r"[!-~]{1,128}")
TIMESTAMP = re.compile(r"(\d{4})-(\d{2})-(\d{2})[Tt ](\d{2}):(\d{2})(?::(\d{2})(?:\.(\d+))?)?(?:[Zz]|([+-])(\d{2}):?(\d{2}))")
MAX_ID, MAX_STRING, MAX_REPORTED, MAX_NAME, MAX_PAYLOAD = 256, 1_024, 10, 64, 64 * 1_024
MAX_BATCH, MAX_REQUEST, MAX_DEPTH = 500, 4 * 1_024 * 1_024, 64
ESCAPED_SURROGATE = re.compile(r"\\u[dD][89a-fA-F]")
CONTROL = re.compile("[\x00-\x1f\x7f-\x9f]")  # the category of control characters, whole
REDACTED = "[redacted]"
LATE, FUTURE, RETENTION = dt.timedelta(hours=2), dt.timedelta(minutes=5), dt.timedelta(days=90)

SCHEMA = (
    "project_id string, status string, reason string, event_name string, user_key long, ts timestamp, message_id string, user_id string, anonymous_id string, "
    "schema_version int, properties map<string,string>, received_at timestamp, is_late boolean, sample_threshold int, sample_bucket int, payload string, quarantine_id string, pos long"
)
EMPTY_ROW = dict.fromkeys(f.split()[0] for f in SCHEMA.split(", "))


# --- rules as columns -----------------------------------------------------------------------


def is_event_name(name: Column) -> Column:
    return F.coalesce(name.rlike(f"^{EVENT_NAME.pattern}$") & ~name.contains("\n"), F.lit(False))


def is_message_id(name: Column) -> Column:
    return F.coalesce(name.rlike(f"^{MESSAGE_ID.pattern}$") & ~name.contains("\n"), F.lit(False))


def timing(ts: Column, received: Column) -> Column:
    """``future``, ``beyond_retention``, ``late`` or ``on_time`` by the collector's clock; bounds belong to the milder class."""
    age = F.unix_millis(received) - F.unix_millis(ts)
    ms = lambda d: int(d.total_seconds() * 1000)
    return F.when(age < -ms(FUTURE), "future").when(age > ms(RETENTION), "beyond_retention").when(age > ms(LATE), "late").otherwise("on_time")


# --- rules on one event ---------------------------------------------------------------------


class Pairs(list):
    """A JSON object as its (key, value) pairs, repeats included."""

    def get(self, name: str):
        """The last value of a key."""
        return next((v for k, v in reversed(self) if k == name), None)


def _refuse(token: str):
    raise ValueError(token)


DECODER = json.JSONDecoder(object_pairs_hook=Pairs, parse_constant=_refuse)


def read_json(raw: str | None):
    """The value of a JSON text; an error if it does not read, or is nested deeper than ``MAX_DEPTH``."""
    value = DECODER.decode(raw or "")
    if raw.count("[") + raw.count("{") > MAX_DEPTH:
        level = [value]
        for _ in range(MAX_DEPTH):
            level = [v for x in level if isinstance(x, list) for v in ((p[1] for p in x) if isinstance(x, Pairs) else x)]
        if any(isinstance(x, list) for x in level):
            raise ValueError("nested too deep")
    return _mended(value) if ESCAPED_SURROGATE.search(raw) else value


def _mended(value):
    """Halves of surrogate pairs, which no text can hold, become replacement characters."""
    if isinstance(value, str):
        return value.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    if isinstance(value, Pairs):
        return Pairs((_mended(k), _mended(v)) for k, v in value)
    return [_mended(v) for v in value] if isinstance(value, list) else value


def utf16_length(text: str) -> int:
    return len(text) if text.isascii() else len(text) + sum(c > "￿" for c in text)


def parse_timestamp(text: object) -> dt.datetime | None:
    """An instant in milliseconds (cut, not rounded) from ISO 8601 text with an explicit offset."""
    if not isinstance(text, str) or not 20 <= len(text) <= 40 or not (m := TIMESTAMP.fullmatch(text)):
        return None
    year, month, day, hour, minute, second = (int(x or 0) for x in m.groups()[:6])
    try:
        at = dt.datetime(year, month, day, hour, minute, second, int((m[7] or "0")[:3].ljust(3, "0")) * 1000, dt.timezone.utc)
        offset = dt.timedelta(hours=int(m[9] or 0), minutes=int(m[10] or 0))
        if offset > dt.timedelta(hours=14):
            return None
        return at + offset if m[8] == "-" else at - offset
    except (ValueError, OverflowError):
        return None


def _value(name: str, p: Property, value: object) -> tuple[str | None, str | None]:
    """Stored text of a property value, or what is wrong with it."""
    if p.type == "string" and isinstance(value, str):
        if utf16_length(value) > MAX_STRING:
            return None, f"property '{name}' is longer than {MAX_STRING} characters"
        if p.enum is not None and value not in p.enum:
            return None, f"property '{name}' has a value that is not one of its allowed values"
        return value, None
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if p.type == "number" and number:
        try:
            if math.isfinite(float(value)):
                return canonical(value), None
        except OverflowError:
            pass
    if p.type == "integer" and number and isinstance(value, int) and -(1 << 63) <= value < 1 << 63:
        return str(value), None
    if p.type == "boolean" and isinstance(value, bool):
        return str(value).lower(), None
    return None, f"property '{name}' must be {MUST_BE[p.type]}"


def check_properties(event: str, version: int, spec: Spec, given: object, redact: set[str]) -> tuple[dict[str, str], list[str]]:
    """Stored properties and at most ten reasons against them."""
    if given is None:
        given = Pairs()
    if not isinstance(given, Pairs):
        return {}, [NOT_PROPERTIES]
    stored: dict[str, str] = {}
    seen: set[str] = set()
    reasons: list[str] = []
    for name, value in given:
        p = spec.properties.get(name)
        if p is None:
            shown = name if len(name) <= MAX_NAME else name[:MAX_NAME] + "..."
            reasons.append(f"property '{shown}' is not declared in {event}@{version}")
        elif value is None:
            continue
        elif name in seen:
            reasons.append(f"property '{name}' appears more than once")
        else:
            seen.add(name)
            text, reason = (REDACTED, None) if name in redact and value == REDACTED else _value(name, p, value)
            if reason:
                reasons.append(reason)
            else:
                stored[name] = REDACTED if name in redact else text
    reasons += [f"required property '{n}' is missing" for n, p in spec.properties.items() if p.required and n not in seen]
    return stored, reasons[:MAX_REPORTED]


@dataclass(frozen=True)
class Normalizer:
    snapshot: Snapshot

    def __call__(self, project: str, raw: str | None, received_at: dt.datetime, pos: int = 0) -> dict:
        """One row of ``SCHEMA``.  A message without project or arrival is ``unreadable``: counted, and stored nowhere."""
        out = EMPTY_ROW.copy()
        if project is None or received_at is None:
            return out | {"status": "unreadable", "reason": "no project or no time of arrival", "message_id": "", "event_name": "", "pos": pos}
        received_at = received_at.astimezone(dt.timezone.utc) if received_at.tzinfo else received_at.replace(tzinfo=dt.timezone.utc)
        received_at = received_at.replace(microsecond=received_at.microsecond // 1000 * 1000)
        out |= {"project_id": project, "received_at": received_at, "message_id": "", "event_name": "", "pos": pos}
        settings = self.snapshot.projects.get(project, Settings())
        try:
            event = read_json(raw)
        except (ValueError, RecursionError):
            event = None
        reason = self._fill(out, event, settings, received_at)
        if reason is None:
            return out | {"status": "accepted" if out["sample_bucket"] < out["sample_threshold"] else "sampled_out"}
        payload = quarantine_payload(event, raw, set(settings.redact))
        if payload is None:
            payload, reason = "{}", reason + TOO_LARGE
        identity = hashlib.sha256(f"{project}\0{raw}\0{received_at.isoformat()}\0{pos}".encode("utf-8", "surrogatepass")).hexdigest()
        return out | {"status": "quarantined", "reason": reason, "payload": payload, "quarantine_id": f"{identity[:8]}-{identity[8:12]}-{identity[12:16]}-{identity[16:20]}-{identity[20:32]}"}

    def _fill(self, out: dict, event: object, settings: Settings, received_at: dt.datetime) -> str | None:
        """Fills ``out`` as far as the event goes; returns the first reason to reject it."""
        if not isinstance(event, Pairs):
            return NOT_OBJECT

        def text(name: str) -> str | None:
            value = event.get(name)
            return value if isinstance(value, str) else None

        message_id, name = text("messageId"), text("event")
        if message_id is None or not MESSAGE_ID.fullmatch(message_id):
            out["event_name"] = name or ""
            return NO_MESSAGE_ID
        out["message_id"] = message_id
        if name is None or not EVENT_NAME.fullmatch(name):
            return NO_EVENT
        out["event_name"] = name
        user, anonymous = text("userId") or "", text("anonymousId") or ""
        if not user and not anonymous:
            return NO_IDENTITY
        if any(utf16_length(x) > MAX_ID or CONTROL.search(x) for x in (user, anonymous) if x):
            return BAD_IDENTITY
        ts = parse_timestamp(text("timestamp"))
        if ts is None:
            return NO_TIMESTAMP
        version = event.get("version")
        if version is not None and (not isinstance(version, int) or isinstance(version, bool) or not 1 <= version <= 65_535):
            return BAD_VERSION
        age = received_at - ts
        if age < -FUTURE:
            return IN_FUTURE
        if age > RETENTION:
            return TOO_OLD
        found = self.snapshot.find(out["project_id"], name, version)
        if found is None:
            return f"no schema is registered for event '{name}'" + ("" if version is None else f" at version {version}")
        stored, reasons = check_properties(name, *found, event.get("properties"), set(settings.redact))
        if reasons:
            return "; ".join(reasons)
        key = key_of(user, anonymous)
        out |= {
            "user_key": key, "ts": ts, "user_id": user, "anonymous_id": anonymous, "schema_version": found[0], "properties": stored, "is_late": age > LATE,
            "sample_threshold": settings.threshold(name), "sample_bucket": bucket_of(key),
        }
        return None


def _dump(value: object, redact: set[str], depth: int = 0) -> str:
    """JSON text that keeps repeated keys; redacts the keys of top-level ``properties``."""
    if isinstance(value, Pairs):
        parts = []
        for k, v in value:
            hidden = depth == 1 and k in redact
            inner = redact if depth == 0 and k == "properties" else set()
            parts.append(f"{quoted(k)}:{quoted(REDACTED) if hidden else _dump(v, inner, depth + 1)}")
        return "{" + ",".join(parts) + "}"
    if isinstance(value, list):
        return "[" + ",".join(_dump(v, set(), depth + 2) for v in value) + "]"
    return quoted(value) if isinstance(value, str) else json.dumps(value)


def quarantine_payload(event: object, raw: str | None, redact: set[str]) -> str | None:
    """What is kept of a rejected event: redacted, at most 64 KiB, otherwise None.  Unreadable text is kept as a JSON string."""
    text = _dump(event, redact) if isinstance(event, Pairs) else json.dumps(raw) if event is None else json.dumps(event)
    return text if len(text.encode()) <= MAX_PAYLOAD else None


# --- on DataFrames --------------------------------------------------------------------------


def rows_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Rows of the normaliser as a DataFrame, for a handful of events on the driver."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)


def normalize(df: DataFrame, snapshot: Snapshot, key: str | None = None) -> DataFrame:
    """Rows of ``SCHEMA`` from ``project_id, raw, received_at, pos``; in-batch duplicates are not marked yet.

    Events that meet all rules are judged by columns (see ``accept``), the others one by one for their reason.
    The text column ``key``, if named, comes out beside them under that name."""
    from .accept import finished, judged

    ship_code(df.sparkSession)  # before any function that needs it is made
    inputs = ["project_id", "raw", F.col("received_at").cast("timestamp").alias("received_at"), F.col("pos").cast("long").alias("pos")]
    events = judged(df.select(*inputs, *([F.col(key).cast("string").alias("key")] if key else [])), snapshot)
    return finished(events, snapshot, [f.split()[0] for f in SCHEMA.split(", ")] + ["key"] * bool(key))


def one_by_one(df: DataFrame, snapshot: Snapshot, key: bool = False) -> DataFrame:
    """The same by the rules on one event, for any events."""
    ship_code(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(snapshot)  # bounded by the catalog's limits

    schema = SCHEMA + (", key string" if key else "")
    target = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = Normalizer(shared.value)
        for batch in batches:
            rows = [own(*row) for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)]
            columns = [[row[name] for row in rows] for name in target.names]
            at = target.names.index("properties")
            columns[at] = [None if p is None else list(p.items()) for p in columns[at]]
            arrays = [pa.array(c, f.type) for c, f in zip(columns, target, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays + list(batch.columns[4:]), names=target.names + ["key"] * bool(key))

    return df.mapInArrow(run, schema)


def mark_duplicates(rows: DataFrame) -> DataFrame:
    """Accepted events after the first of their message id become ``duplicate``; others are untouched.

    One window over all rows, so that what makes them runs once; rows that cannot be duplicates are dealt by position and arrival."""
    accepted = F.col("status") == "accepted"
    other = F.xxhash64("pos", "received_at", "quarantine_id").cast("string")
    first = Window.partitionBy("project_id", accepted, F.when(accepted, F.col("message_id")).otherwise(other)).orderBy("pos")
    again = accepted & (F.row_number().over(first) > 1)
    marked = rows.withColumn("_again", again)
    marked = marked.withColumn("reason", F.when(F.col("_again"), "repeated within the batch").otherwise(F.col("reason")))
    return marked.withColumn("status", F.when(F.col("_again"), "duplicate").otherwise(F.col("status"))).drop("_again")


def ingest(df: DataFrame, snapshot: Snapshot) -> DataFrame:
    return mark_duplicates(normalize(df, snapshot))


def request_problems(raws: list[str]) -> list[str]:
    """What is wrong with the size of one delivery; an empty list if it can be taken."""
    sizes = [len(r.encode("utf-8", "surrogatepass")) for r in raws]
    rules = (
        (1 <= len(raws) <= MAX_BATCH, f"{len(raws)} events, 1 to {MAX_BATCH} are possible"),
        (len(raws) != 1 or sizes[0] <= MAX_PAYLOAD, f"the event is larger than {MAX_PAYLOAD} bytes"),
        (sum(sizes) <= MAX_REQUEST, f"the events are larger than {MAX_REQUEST} bytes"),
    )
    return [problem for holds, problem in rules if not holds]


def deliver(spark: SparkSession, project_id: str, raws: list[str], received_at: dt.datetime, snapshot: Snapshot) -> DataFrame:
    """One delivery of 1 to 500 raw events as judged rows; raises ``RequestError`` beyond the bounds."""
    if found := request_problems(raws):
        raise RequestError(found)
    rows = [(project_id, raw, received_at, i) for i, raw in enumerate(raws)]
    return ingest(spark.createDataFrame(rows, "project_id string, raw string, received_at timestamp, pos long"), snapshot)


def outcomes(df: DataFrame, snapshot: Snapshot | None = None) -> DataFrame:
    """``status, reason, n``."""
    if snapshot is None:
        from ..sources.generate import demo_snapshot

        snapshot = demo_snapshot()
    return ingest(df, snapshot).groupBy("status", "reason").agg(F.count("*").alias("n"))


def not_accepted(rows: DataFrame) -> DataFrame:
    """``pos, message_id, status, reason`` of what was not accepted, in order."""
    return rows.where("status <> 'accepted'").select("pos", "message_id", "status", "reason").orderBy("pos")


def replay(row, snapshot: Snapshot) -> dict:
    """A quarantined row normalised again, as of its own arrival."""
    return Normalizer(snapshot)(row["project_id"], row["payload"], row["received_at"])
