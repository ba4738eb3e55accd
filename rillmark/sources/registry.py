"""The catalog: projects, registered event schemas, and what may change in them.

A small registry on the driver, kept as one JSON document per revision; a snapshot is frozen
and can be shipped to executors.  A revision is written only where none of its number exists,
so of two writers in any two processes one wins and the other sees a conflict.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.identity import BUCKETS, threshold_of, valid_rate
from ..plans.requests import valid_event, valid_property
from .files import Numbered

TYPES = ("string", "number", "integer", "boolean")
MAX_PROPERTIES, MAX_ENUM, MAX_ENUM_LENGTH, MAX_PROPERTY_NAME = 64, 256, 256, 64
MAX_REDACTED, MAX_SAMPLED = 64, 256
MAX_VERSION = 65_535
RETRIES = 5


@dataclass(frozen=True)
class Property:
    type: str
    required: bool = False
    enum: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Spec:
    """The shape of one event at one version; property order is the order of reports."""

    properties: dict[str, Property] = field(default_factory=dict)

    def problems(self) -> list[str]:
        found = [f"{len(self.properties)} properties, {MAX_PROPERTIES} are possible"] if len(self.properties) > MAX_PROPERTIES else []
        return found + [f"{name}: {p}" for name, spec in self.properties.items() for p in _property_problems(name, spec)]

    def to_json(self) -> dict:
        return {n: {"type": p.type, "required": p.required} | ({"enum": list(p.enum)} if p.enum is not None else {}) for n, p in self.properties.items()}

    @staticmethod
    def from_json(value: dict) -> Spec:
        return Spec({n: Property(p["type"], p.get("required", False), tuple(p["enum"]) if "enum" in p else None) for n, p in value.items()})


def _property_problems(name: str, p: Property) -> list[str]:
    values = p.enum or ()
    rules = (
        (valid_property(name), f"not a property name (letters, digits, underscores, no digit first, {MAX_PROPERTY_NAME} at most)"),
        (p.type in TYPES, f"type is none of {', '.join(TYPES)}"),
        (p.enum is None or p.type == "string", "only strings can have a list of values"),
        (p.enum is None or 1 <= len(values) <= MAX_ENUM, f"the list of values holds {len(values)}, 1 to {MAX_ENUM} are possible"),
        (all(v is not None and len(v) <= MAX_ENUM_LENGTH for v in values), f"a listed value is null or above {MAX_ENUM_LENGTH} characters"),
        (len(set(values)) == len(values), "a value is listed twice"),
    )
    return [problem for holds, problem in rules if not holds]


#: A version may only grow by optional properties.  Each rule names what breaks for one property, from its old and
#: new form (None: not there), or nothing.
EVOLUTION = (
    lambda old, new: ["is gone"] if old and not new else [],
    lambda old, new: ["is new and required"] if new and not old and new.required else [],
    lambda old, new: [f"was {old.type} and is {new.type}"] if old and new and old.type != new.type else [],
    lambda old, new: ["became required" if new.required else "became optional"] if old and new and old.required != new.required else [],
    lambda old, new: ["got a list of values"] if old and new and old.enum is None and new.enum is not None else [],
    lambda old, new: ["lost its list of values"] if old and new and old.enum is not None and new.enum is None else [],
    lambda old, new: [f"lost the value {v!r}" for v in sorted(set(old.enum or ()) - set(new.enum or ()))] if old and new and new.enum is not None else [],
)


def breaking_changes(current: Spec, proposed: Spec) -> list[str]:
    """Why ``proposed`` cannot replace ``current`` in place, sorted by property."""
    names = sorted(current.properties.keys() | proposed.properties.keys())
    return [f"{n} {broken}" for n in names for rule in EVOLUTION for broken in rule(current.properties.get(n), proposed.properties.get(n))]


@dataclass(frozen=True)
class Settings:
    redact: tuple[str, ...] = ()
    sample_rates: dict[str, float] = field(default_factory=dict)

    def problems(self) -> list[str]:
        found = [f"redact: more than {MAX_REDACTED} names"] if len(self.redact) > MAX_REDACTED else []
        found += [f"redact: {n!r} is not a property name" for n in self.redact if not valid_property(n)]
        found += [f"sampling: more than {MAX_SAMPLED} events"] if len(self.sample_rates) > MAX_SAMPLED else []
        for name, rate in self.sample_rates.items():
            found += [] if valid_event(name) else [f"sampling: {name!r} is not an event name"]
            found += [] if valid_rate(rate) else [f"sampling: the rate of {name!r} is not one of 1/{BUCKETS} to 1 in steps of 1/{BUCKETS}"]
        return found

    def threshold(self, event: str) -> int:
        return threshold_of(self.sample_rates.get(event, 1.0))


@dataclass(frozen=True)
class Snapshot:
    """Everything the normaliser needs, at one revision."""

    revision: int = 0
    projects: dict[str, Settings] = field(default_factory=dict)
    schemas: dict[str, dict[str, dict[int, Spec]]] = field(default_factory=dict)

    def find(self, project: str, event: str, version: int | None) -> tuple[int, Spec] | None:
        versions = self.schemas.get(project, {}).get(event, {})
        number = max(versions, default=None) if version is None else version
        return (number, versions[number]) if number in versions else None

    def listing(self, spark: SparkSession, project: str) -> DataFrame:
        """``event_name, version, spec`` of a project, in order."""
        rows = [(e, v, json.dumps(s.to_json())) for e, vs in self.schemas.get(project, {}).items() for v, s in vs.items()]
        return spark.createDataFrame(rows, "event_name string, version int, spec string").orderBy("event_name", "version")


class Conflict(RuntimeError):
    """Another writer was faster."""


class Registry:
    """The catalog in a folder of numbered revisions (or in memory without a path)."""

    def __init__(self, path: str | None = None, spark: SparkSession | None = None):
        self.log = None if path is None else Numbered(path, spark)
        self._snapshot = Snapshot()
        self.refresh()

    def snapshot(self) -> Snapshot:
        return self._snapshot

    def refresh(self) -> Snapshot:
        """Takes over a newer revision of the folder, never an older one."""
        if self.log and (found := self.log.newest()) and found[0] > self._snapshot.revision:
            d = json.loads(found[1])
            projects = {k: Settings(tuple(v["redact"]), v["sample_rates"]) for k, v in d["projects"].items()}
            schemas = {p: {e: {int(v): Spec.from_json(s) for v, s in vs.items()} for e, vs in es.items()} for p, es in d["schemas"].items()}
            self._snapshot = Snapshot(found[0], projects, schemas)
        return self._snapshot

    def _swap(self, before: Snapshot, after: Snapshot) -> None:
        if self.refresh().revision != before.revision:
            raise Conflict
        if self.log:
            value = {
                "projects": {k: {"redact": list(s.redact), "sample_rates": s.sample_rates} for k, s in after.projects.items()},
                "schemas": {p: {e: {str(v): s.to_json() for v, s in vs.items()} for e, vs in es.items()} for p, es in after.schemas.items()},
            }
            if not self.log.put(after.revision, json.dumps(value)):
                raise Conflict
        self._snapshot = after

    def put_project(self, project: str, settings: Settings = Settings()) -> list[str]:
        if found := settings.problems():
            return found
        for _ in range(RETRIES):
            s = self.refresh()
            try:
                self._swap(s, Snapshot(s.revision + 1, s.projects | {project: settings}, s.schemas))
            except Conflict:
                continue
            return []
        raise Conflict

    def put_schema(self, project: str, event: str, version: int, spec: Spec) -> tuple[str, list[str]]:
        """``created``, ``updated``, ``unchanged``, ``breaking``, ``invalid`` or ``not_found``, with reasons."""
        if found := spec.problems() + ([] if 1 <= version <= MAX_VERSION else [f"version: 1 to {MAX_VERSION} are possible"]) + ([] if valid_event(event) else ["event: not an event name"]):
            return "invalid", found
        for _ in range(RETRIES):
            s = self.refresh()
            if project not in s.projects:
                return "not_found", []
            events = s.schemas.get(project, {})
            old = events.get(event, {}).get(version)
            if old == spec:
                return "unchanged", []
            if old is not None and (found := breaking_changes(old, spec)):
                return "breaking", found
            new = s.schemas | {project: events | {event: events.get(event, {}) | {version: spec}}}
            try:
                self._swap(s, Snapshot(s.revision + 1, s.projects, new))
            except Conflict:
                continue
            return ("created" if old is None else "updated"), []
        raise Conflict
