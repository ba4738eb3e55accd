"""Query requests and their bounds.  Every request can say what is wrong with it before a plan is built.

Each request names the one project it is about; no query reads rows of another.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field

from ..functions.identity import BUCKETS

MAX_RANGE_DAYS, MAX_STEPS = 366, 8
MAX_RETENTION_DAYS, MAX_RETENTION_SPAN = 63, 256
MAX_FILTERS, MAX_FILTER_VALUES = 10, 100
MAX_WINDOW_SECONDS = 90 * 86_400
EVENT_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_.:-]{0,127}")
PROPERTY_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,63}")
OPERATORS = ("eq", "neq", "in", "gt", "lt")


class RequestError(ValueError):
    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


def valid_event(name: object) -> bool:
    return isinstance(name, str) and EVENT_NAME.fullmatch(name) is not None


def valid_property(name: object) -> bool:
    return isinstance(name, str) and PROPERTY_NAME.fullmatch(name) is not None


class Request:
    def problems(self) -> list[str]:
        raise NotImplementedError

    def checked(self):
        if found := self.problems():
            raise RequestError(found)
        return self


@dataclass(frozen=True)
class Days(Request):
    """Whole UTC days, both ends inclusive."""

    start: dt.date
    end: dt.date

    def problems(self) -> list[str]:
        if self.end < self.start:
            return ["the range ends before it begins"]
        return [f"the range is longer than {MAX_RANGE_DAYS} days"] if (self.end - self.start).days >= MAX_RANGE_DAYS else []


@dataclass(frozen=True)
class Sampled:
    """How user counts were scaled; ``threshold`` 10,000 means not at all."""

    threshold: int = BUCKETS

    @staticmethod
    def at(threshold: int | None) -> Sampled:
        return Sampled(threshold) if threshold and 0 < threshold < BUCKETS else Sampled()

    @property
    def scale(self) -> float:
        return BUCKETS / self.threshold

    @property
    def is_estimate(self) -> bool:
        return self.threshold < BUCKETS


def _event(name: object, what: str) -> list[str]:
    return [] if valid_event(name) else [f"{what}: not an event name"]


@dataclass(frozen=True, kw_only=True)
class OfProject(Request):
    project: str

    def project_problems(self) -> list[str]:
        return [] if isinstance(self.project, str) and self.project else ["project: missing"]


@dataclass(frozen=True)
class Funnel(OfProject):
    steps: tuple[str, ...]
    days: Days
    window_seconds: int

    def problems(self) -> list[str]:
        if not self.steps or not 2 <= len(self.steps) <= MAX_STEPS:
            return [f"steps: 2 to {MAX_STEPS} are needed"]
        found = self.project_problems() + [p for i, s in enumerate(self.steps) for p in _event(s, f"step {i + 1}")]
        if len(set(self.steps)) < len(self.steps):
            found.append("steps: an event stands twice")
        if not 0 < self.window_seconds <= MAX_WINDOW_SECONDS:
            found.append(f"window: 1 to {MAX_WINDOW_SECONDS} seconds are possible")
        return found + self.days.problems()


@dataclass(frozen=True)
class Retention(OfProject):
    start_event: str
    return_event: str
    days: Days
    follow: int
    source: str = "rollup"

    def problems(self) -> list[str]:
        found = self.project_problems() + _event(self.start_event, "first event") + _event(self.return_event, "returning event") + self.days.problems()
        span = (self.days.end - self.days.start).days
        if not 1 <= self.follow <= MAX_RETENTION_DAYS:
            found.append(f"follow: 1 to {MAX_RETENTION_DAYS} days are possible")
        elif span >= 0 and span + self.follow >= MAX_RETENTION_SPAN:
            found.append(f"cohorts and the days that follow them cover more than {MAX_RETENTION_SPAN} days")
        if self.source not in ("rollup", "events"):
            found.append("source: neither rollup nor events")
        return found


@dataclass(frozen=True)
class PropertyFilter:
    name: str
    operator: str
    values: tuple[str, ...]

    def problems(self) -> list[str]:
        if not valid_property(self.name):
            return ["filter: not a property name"]
        if self.operator not in OPERATORS:
            return [f"filter {self.name}: operator is none of {', '.join(OPERATORS)}"]
        most = MAX_FILTER_VALUES if self.operator == "in" else 1
        if not 1 <= len(self.values) <= most:
            return [f"filter {self.name}: takes 1 to {most} values" if most > 1 else f"filter {self.name}: takes one value"]
        if self.operator in ("gt", "lt"):
            try:
                float(self.values[0])
            except ValueError:
                return [f"filter {self.name}: {self.values[0]!r} is no number to compare with"]
        return []


@dataclass(frozen=True)
class Segment(OfProject):
    days: Days
    event: str | None = None
    filters: tuple[PropertyFilter, ...] = field(default=())

    def problems(self) -> list[str]:
        found = self.project_problems() + ([] if self.event is None else _event(self.event, "event")) + self.days.problems()
        if len(self.filters) > MAX_FILTERS:
            found.append(f"filters: more than {MAX_FILTERS}")
        return found + [p for f in self.filters for p in f.problems()]


@dataclass(frozen=True)
class Sessions(OfProject):
    days: Days

    def problems(self) -> list[str]:
        return self.project_problems() + self.days.problems()
