"""Number text: how stored property values are written and compared."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

#: Text that counts as a number; Spark's cast alone would also take suffixes, blanks and names.
NUMERIC = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def to_number(text: Column) -> Column:
    """Double of numeric text, null for anything else (also for NaN)."""
    value = F.when(text.rlike(NUMERIC), text.try_cast("double"))
    return F.when(~F.isnan(value), value)


def canonical(number: float | int) -> str:
    """Shortest text that reads back as the same double; with an exponent where that is -5 or less, or 15 or more."""
    value = float(number)
    sign, digits, exponent = Decimal(repr(value)).as_tuple()
    text = "".join(map(str, digits)).rstrip("0") or "0"
    lead = "-" if sign else ""
    if value == 0:
        return lead + "0"
    point = len(digits) + exponent  # digits before the decimal point
    order = point - 1
    if -5 < order < 15:
        if point <= 0:
            return f"{lead}0.{'0' * -point}{text}"
        whole = text[:point].ljust(point, "0")
        return lead + whole + (f".{text[point:]}" if text[point:] else "")
    return f"{lead}{text[0]}{'.' + text[1:] if text[1:] else ''}E{'-' if order < 0 else '+'}{abs(order):02d}"
