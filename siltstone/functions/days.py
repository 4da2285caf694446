"""Days out of source texts and structured times, and what is closing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import let

_TIME = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$"


def close_day(value: Column) -> Column:
    """The UTC day of a structured close time: a plain day, or a time with an offset of at most 14 hours; null for anything else."""
    number = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))

    def timed(p: Column) -> Column:
        hour, minute, second, zone = number(p["hour"]), number(p["minute"]), number(p["second"]), p["zone"]
        away = number(F.substring(zone, 2, 2)) * 60 + number(F.regexp_extract(zone, "([0-9]{2})$", 1))
        away = F.when(zone.rlike("^[+-]"), away * F.when(zone.startswith("-"), -1).otherwise(1)).otherwise(0)
        moved = lambda a: F.date_add(F.try_to_date(p["day"], "yyyy-MM-dd"), F.floor((hour * 60 + minute - a) / 1440).cast("int"))
        right = (hour <= 23) & (minute <= 59) & (second <= 59)
        return F.when(right, let(away, lambda a: F.when(F.abs(a) <= 840, moved(a))))

    def day(text: Column) -> Column:
        parts = F.struct(*[F.regexp_extract(text, _TIME, i).alias(name) for i, name in enumerate(("day", "hour", "minute", "second", "zone"), 1)])
        return F.when(text.rlike(_TIME), let(parts, timed)).when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))

    return let(F.trim(F.coalesce(value, F.lit(""))), day)


#: Formats of source dates; the two with slashes are told apart by the whole source.
SOURCE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "d.M.yyyy")


def shows_day_first(text: Column) -> Column:
    """True or false where a date with slashes can be read in one way only, else null."""
    first, second = (F.regexp_extract(F.trim(text), r"^([0-9]{1,2})/([0-9]{1,2})/[0-9]{4}$", i).try_cast("int") for i in (1, 2))
    return F.when((first > 12) & (second <= 12), True).when((second > 12) & (first <= 12), False)


def source_date(text: Column, day_first: Column) -> Column:
    """A source's date in one of five formats; slashes by the source's own habit (null: month first)."""
    value = F.trim(F.coalesce(text, F.lit("")))
    slashes = F.when(F.coalesce(day_first, F.lit(False)), F.try_to_date(value, "d/M/yyyy")).otherwise(F.try_to_date(value, "M/d/yyyy"))
    return F.coalesce(*[F.try_to_date(value, f) for f in SOURCE_FORMATS], slashes)


def closing_state(closes: Column, today: Column, window: int = 7) -> Column:
    """overdue before today, soon within the window, later beyond it; null without a day."""
    left = F.datediff(closes, today)
    return F.when(left < 0, "overdue").when(left <= window, "soon").when(closes.isNotNull(), "later")
