"""The quarantine: rejected events, their newest versions, and pages of them."""

from __future__ import annotations

import base64
import binascii
import datetime as dt
import uuid

from pyspark.sql import DataFrame, Row, Window, functions as F

QUARANTINE_SCHEMA = (
    "project_id string, received_at timestamp, quarantine_id string, message_id string, event_name string, reason string, "
    "payload string, status string, updated_at timestamp"
)
MAX_PAGE = 200
_EPOCH_TICKS, _TICKS = 621_355_968_000_000_000, 10_000_000  # of 0001-01-01, 100 ns each


def latest(rows: DataFrame) -> DataFrame:
    """The newest version of each quarantined event."""
    newest = Window.partitionBy("project_id", "received_at", "quarantine_id").orderBy(F.col("updated_at").desc())
    return rows.withColumn("_v", F.row_number().over(newest)).where("_v = 1").drop("_v")


def encode_cursor(received_at: dt.datetime, quarantine_id: str) -> str:
    at = received_at if received_at.tzinfo else received_at.replace(tzinfo=dt.timezone.utc)
    since = at - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    ticks = _EPOCH_TICKS + (since.days * 86_400 + since.seconds) * _TICKS + since.microseconds * 10
    return base64.urlsafe_b64encode(f"{ticks}:{uuid.UUID(quarantine_id).hex}".encode()).decode().rstrip("=")


def decode_cursor(cursor: str | None) -> tuple[dt.datetime, str] | None:
    """Position of a cursor; None (the first page) for one that does not read."""
    if not cursor or len(cursor) > 128:
        return None
    try:
        ticks, _, key = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode().partition(":")
        if not ticks.isascii() or not ticks.isdigit() or len(key) != 32:
            return None
        at = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=(int(ticks) - _EPOCH_TICKS) // 10)
        return at, str(uuid.UUID(hex=key))
    except (binascii.Error, UnicodeDecodeError, ValueError, OverflowError):
        return None


def open_rows(rows: DataFrame, project_id: str, cursor: str | None = None) -> DataFrame:
    """Open events, newest first, behind the cursor."""
    own = rows.where(F.col("project_id") == project_id)
    if at := decode_cursor(cursor):  # the key columns agree over versions, so this may go before the dedup
        own = own.where(F.struct("received_at", "quarantine_id") < F.struct(F.lit(at[0]).alias("received_at"), F.lit(at[1]).alias("quarantine_id")))
    return latest(own).where("status = 'open'").orderBy(F.col("received_at").desc(), F.col("quarantine_id").desc())


def page(rows: DataFrame, project_id: str, limit: int, cursor: str | None = None) -> tuple[list[Row], str | None]:
    """At most ``limit`` (1 to 200) open events and the cursor of the next page, if there is one."""
    limit = max(1, min(limit, MAX_PAGE))
    found = open_rows(rows, project_id, cursor).limit(limit + 1).collect()
    if len(found) <= limit:
        return found, None
    last = found[limit - 1]
    return found[:limit], encode_cursor(last["received_at"], last["quarantine_id"])


def found(rows: DataFrame, project_id: str, quarantine_id: str) -> DataFrame:
    """The newest version of one event, if there is one."""
    return latest(rows.where((F.col("project_id") == project_id) & (F.col("quarantine_id") == quarantine_id)))


def find(rows: DataFrame, project_id: str, quarantine_id: str) -> Row | None:
    return found(rows, project_id, quarantine_id).first()


def replayed(row: Row, now: dt.datetime) -> Row:
    """The version row that closes ``row``."""
    return Row(**(row.asDict() | {"status": "replayed", "updated_at": now}))
