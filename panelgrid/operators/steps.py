"""Time steps of a panel: fixed spans, and calendar steps of months, weeks or business days.

A step numbers moments by consecutive integers. Fixed spans number microseconds since 1970;
calendar steps number days, business days or months, and the time of day rides along. Numbers
are arithmetic on the timestamp, so grids, positions and chunks need no look at other rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000
DAY = 86_400

_UNIT_SECONDS = {
    "D": DAY, "DAY": DAY, "H": 3600, "HOUR": 3600, "T": 60, "MIN": 60, "MINUTE": 60,
    "S": 1, "SECOND": 1, "W": 7 * DAY, "WEEK": 7 * DAY,
}
_WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
_MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
#: Calendar units: how a month is marked, months of the unit, month that anchors it by default.
_CALENDAR = {
    "MS": ("month start", 1, 0), "M": ("month end", 1, 0), "ME": ("month end", 1, 0),
    "BMS": ("business month start", 1, 0), "BM": ("business month end", 1, 0), "BME": ("business month end", 1, 0),
    "QS": ("month start", 3, 0), "Q": ("month end", 3, 11), "QE": ("month end", 3, 11),
    "BQS": ("business month start", 3, 0), "BQ": ("business month end", 3, 11), "BQE": ("business month end", 3, 11),
    "YS": ("month start", 12, 0), "AS": ("month start", 12, 0), "Y": ("month end", 12, 11),
    "YE": ("month end", 12, 11), "A": ("month end", 12, 11), "BYS": ("business month start", 12, 0),
    "BAS": ("business month start", 12, 0), "BY": ("business month end", 12, 11),
    "BYE": ("business month end", 12, 11), "BA": ("business month end", 12, 11),
}


def _first_of(month: Column) -> Column:
    return F.add_months(F.lit("1970-01-01").cast("date"), month.cast("int"))


def _weekday(day: Column) -> Column:
    """0 on Mondays."""
    return F.pmod(F.unix_date(day) + 3, F.lit(7))


def _monday_or(day: Column, move: tuple[int, int]) -> Column:
    """A Saturday or Sunday moved by as many days."""
    weekday = _weekday(day)
    return F.date_add(day, F.when(weekday == 5, move[0]).when(weekday == 6, move[1]).otherwise(0))


#: The day that marks a month, by its number since January 1970.
MONTH_MARKS = {
    "month start": _first_of,
    "month end": lambda month: F.last_day(_first_of(month)),
    "business month start": lambda month: _monday_or(_first_of(month), (2, 1)),
    "business month end": lambda month: _monday_or(F.last_day(_first_of(month)), (-1, -2)),
}
KINDS = ("time", "day", "business day", *MONTH_MARKS)


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a zone-less timestamp."""
    day = F.unix_date(F.to_date(ts)).cast("long")
    return day * DAY + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def micros_of_day(ts: Column) -> Column:
    """Microseconds since midnight."""
    parts = (F.date_part(F.lit("SECONDS"), ts) * MICROS).cast("long")
    return (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long") * MICROS + parts


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp."""
    return F.unix_date(F.to_date(ts)).cast("long") * (DAY * MICROS) + micros_of_day(ts)


def from_epoch_micros(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01").cast("timestamp_ntz"))


def mark(kind: str, number: Column) -> Column:
    """The day that a calendar step's number stands for."""
    if kind == "day":
        return F.date_from_unix_date(number.cast("int"))
    if kind == "business day":
        week, weekday = F.floor(number / 5), F.pmod(number, F.lit(5))
        return F.date_from_unix_date((week * 7 + weekday - 3).cast("int"))
    return MONTH_MARKS[kind](number)


def number_of(kind: str, ts: Column) -> Column:
    """The number of the last mark up to a time; of a ``time`` step its microseconds."""
    if kind == "time":
        return epoch_micros(ts)
    day = F.to_date(ts)
    if kind == "day":
        return F.unix_date(day).cast("long")
    if kind == "business day":
        days = F.unix_date(day).cast("long") + 3
        return F.floor(days / 7) * 5 + F.least(F.pmod(days, F.lit(7)), F.lit(4))
    month = ((F.year(day) - 1970) * 12 + F.month(day) - 1).cast("long")
    return F.when(day < mark(kind, month), month - 1).otherwise(month)


def is_marked(kind: str, ts: Column) -> Column:
    """Whether a time falls on a mark of the calendar."""
    return F.lit(True) if kind == "time" else F.to_date(ts) == mark(kind, number_of(kind, ts))


def time_of(kind: str, number: Column, after: Column) -> Column:
    """The time of a number; ``after`` are the microseconds since midnight on calendar steps."""
    if kind == "time":
        return from_epoch_micros(number)
    return F.timestamp_add("MICROSECOND", after, mark(kind, number).cast("timestamp_ntz"))


@dataclass(frozen=True)
class Step:
    """Numbers ``phase + k * size`` of a kind; ``unit`` is what ``phase`` repeats in."""

    kind: str
    size: int
    unit: int = 1
    phase: int = 0

    def position(self, ts: Column) -> Column:
        """Consecutive integers along a series that has a row on each step."""
        if self.kind == "time" and self.size % (DAY * MICROS) == 0:
            return F.floor(F.unix_date(F.to_date(ts)).cast("long") / (self.size // (DAY * MICROS)))
        if self.kind == "time" and self.size % MICROS == 0:
            return F.floor(epoch_seconds(ts) / (self.size // MICROS))
        return F.floor((number_of(self.kind, ts) - self.phase) / self.size)

    def remainder(self, ts: Column) -> list[Column]:
        """What all rows of a series on this step have in common: where they lie within a step."""
        number = number_of(self.kind, ts)
        within = F.pmod(number - self.phase, F.lit(self.size))
        return [within] if self.kind == "time" else [
            within, F.date_diff(F.to_date(ts), mark(self.kind, number)), micros_of_day(ts)]

    def first_number(self, first: Column) -> Column:
        """Of the first mark that is not before a time's day."""
        number = number_of(self.kind, first)
        if self.kind == "time":
            return number
        number = F.when(is_marked(self.kind, first), number).otherwise(number + 1)
        return number + F.pmod(F.lit(self.phase) - number, F.lit(self.unit))

    def last_number(self, first: Column, last: Column) -> Column:
        """Of the last mark up to a time; one less if its time of day is before that of the grid."""
        number = number_of(self.kind, last)
        if self.kind == "time":
            return number
        number = number - F.pmod(number - self.phase, F.lit(self.unit))
        return F.when(micros_of_day(last) < micros_of_day(first), number - 1).otherwise(number)


def parse_step(frequency: str) -> Step:
    """The step of a frequency: ``1D``, ``6h``, ``15min``, ``30 s``; ``MS``, ``ME``, ``QS-FEB``, ``YE``,
    ``W-MON``, ``B`` and the business forms of months, quarters and years, each with a leading number."""
    match = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+)(?:-([A-Za-z]{3}))?\s*", frequency)
    if not match:
        raise ValueError(f"not a frequency: {frequency!r}")
    count, unit, anchor = int(match.group(1) or 1), match.group(2), (match.group(3) or "").upper()
    if not count:
        raise ValueError(f"a step of nothing: {frequency!r}")
    if unit == "B" and not anchor:
        return Step("business day", count)
    if unit == "W":
        weekday = anchor or "SUN"
        if weekday in _WEEKDAYS:
            # Day 0 was a Thursday.
            return Step("day", 7 * count, 7, (_WEEKDAYS.index(weekday) - 3) % 7)
    elif unit in _CALENDAR:
        kind, months, default = _CALENDAR[unit]
        if not anchor or (anchor in _MONTHS and months > 1):
            return Step(kind, count * months, months, (_MONTHS.index(anchor) if anchor else default) % months)
    elif not anchor:
        name = unit.upper()
        for known in (name, name.removesuffix("S")):
            if known in _UNIT_SECONDS:
                return Step("time", count * _UNIT_SECONDS[known] * MICROS)
    raise ValueError(f"not a frequency: {frequency!r}")
