"""Column expressions that read text fields. None of them raises under ANSI mode."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelgrid.fixed_values import STATE_CODES, STATE_FIPS

_DIGITS = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
NUMBER = rf"^{_DIGITS}$"
_AMOUNT = rf"^{_DIGITS}[KMBkmb]?$"
_EVENT_TIME = r"^\d{1,2}-[A-Za-z]{3}-\d{2} \d{2}:\d{2}:\d{2}$"
_SLASH_TIME = r"^(\d{1,2})/(\d{1,2})/(\d{4})(?: (\d{1,2}):(\d{2})(?::(\d{2}))?)?$"
_MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"


def parse_damage(text: Column) -> Column:
    """``12.5K`` -> 12500.0; K, M and B scale, anything unreadable is 0."""
    cleaned = F.trim(text)
    suffix = F.upper(F.right(cleaned, F.lit(1)))
    factor = (
        F.when(suffix == "K", F.lit(1e3))
        .when(suffix == "M", F.lit(1e6))
        .when(suffix == "B", F.lit(1e9))
        .otherwise(F.lit(1.0))
    )
    number = F.rtrim(cleaned, F.lit("KMBkmb")).try_cast("double")
    return F.when(cleaned.rlike(_AMOUNT), number * factor).otherwise(F.lit(0.0))


def parse_event_time(text: Column) -> Column:
    """``03-OCT-98 12:30:00`` first, then ISO, then month/day/year; null when none fits.

    Two-digit years 69..99 are 19xx and 00..68 are 20xx. The result carries no
    zone, so the session time zone never moves it.
    """

    padded = F.lpad(text, 18, "0")  # 01-OCT-98 12:30:00, whatever the day's width

    def dashed_part(start: int, length: int) -> Column:
        return F.substring(padded, start, length).try_cast("int")

    place = F.instr(F.lit(_MONTHS), F.upper(F.substring(padded, 4, 3)))
    month = F.when((place > 0) & (place % 3 == 1), ((place + 2) / 3).cast("int"))
    short_year = dashed_part(8, 2)
    year = F.when(short_year >= 69, short_year + 1900).otherwise(short_year + 2000)
    dashed = F.try_make_timestamp_ntz(
        year, month, dashed_part(1, 2), dashed_part(11, 2), dashed_part(14, 2), dashed_part(17, 2)
    )

    def slashed_part(group: int, default: int | None = None) -> Column:
        part = F.regexp_extract(text, _SLASH_TIME, group).try_cast("int")
        return part if default is None else F.coalesce(part, F.lit(default))

    slashed = F.try_make_timestamp_ntz(
        slashed_part(3), slashed_part(1), slashed_part(2),
        slashed_part(4, 0), slashed_part(5, 0), slashed_part(6, 0),
    )
    # The shape decides first: only rows of another shape pay for the other parsers.
    return F.when(text.rlike(_EVENT_TIME), dashed).otherwise(
        F.coalesce(text.try_cast("timestamp_ntz"), slashed)
    )


def day_floor(ts: Column) -> Column:
    """Midnight of the same day, without a zone."""
    return F.to_date(ts).cast("timestamp_ntz")


def make_day(year: Column, month: Column, day: Column) -> Column:
    """Midnight of a calendar day; null for 30 February and the like."""
    zero = F.lit(0)
    return F.try_make_timestamp_ntz(year, month, day, zero, zero, zero)


def _lookup(key: Column, table: dict[str, str]) -> Column:
    entries = [F.lit(item) for pair in table.items() for item in pair]
    return F.element_at(F.create_map(*entries), key)


def state_code(name: Column) -> Column:
    """Two-letter code of a state name in any case; unknown names stay, upper-cased."""
    return F.coalesce(_lookup(F.upper(name), STATE_CODES), F.upper(name))


def state_fips(code: Column) -> Column:
    """Census code of a two-letter state code, null when there is none."""
    return _lookup(code, STATE_FIPS)


def contains_any(text: Column, pattern: str) -> Column:
    """Whether the upper-cased text holds one of the ``|``-separated words; null does not."""
    upper = F.upper(text)
    found = reduce(or_, [upper.contains(word) for word in pattern.split("|")])
    return F.coalesce(found, F.lit(False))


def fixed_field(line: Column, start: int, end: int) -> Column:
    """Characters ``start`` up to ``end`` (0-based, end excluded), trimmed."""
    return F.trim(F.substring(line, start + 1, end - start))


def pretty_label(name: Column) -> Column:
    """``tabular_ensemble`` -> ``Tabular Ensemble``."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
