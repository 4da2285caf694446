"""Money, scores and dates as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Periods of pay and how many a year has.
PERIODS = {"hour": 2080, "week": 52, "biweek": 26, "month": 12, "year": 1}


def annualized(amount: Column, period: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in PERIODS.items() for x in pair])
    return amount * F.try_element_at(table, F.lower(period))


def money(text: Column) -> Column:
    """The first amount of a text: grouping commas, a decimal point, k; null if there is none."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)\s*([kK]?)", 1)
    thousands = F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)\s*([kK]?)", 2)
    return F.regexp_replace(found, ",", "").try_cast("double") * F.when(F.lower(thousands) == "k", 1000.0).otherwise(1.0)


def score_cell(cell: Column) -> Column:
    """Leading number of a score cell out of five (comma decimals allowed); null outside 0..5 or with another denominator."""
    clean = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\*\*", "")), ",", ".")
    number = F.regexp_extract(clean, r"^(\d+(?:\.\d+)?)", 1).try_cast("double")
    denominator = F.regexp_extract(clean, r"^\d+(?:\.\d+)?\s*/\s*(\d+)", 1)
    return F.when(((denominator == "") | (denominator == "5")) & number.between(0, 5), number)


def iso_week(day: Column) -> Column:
    """Year and week by ISO 8601, as 2026-W01."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.extract(F.lit("WEEK"), day).cast("string"), 2, "0"))


def days_since(day: Column, today: Column) -> Column:
    return F.greatest(F.datediff(today, day), F.lit(0))


def freshness(day: Column, today: Column, windows: tuple[int, ...] = (1, 3, 7, 14, 30)) -> Column:
    """The least window, in days, that holds a date; null beyond the last."""
    age = days_since(day, today)
    out = F.lit(None).cast("int")
    for w in reversed(windows):
        out = F.when(age <= w, w).otherwise(out)
    return out


def rate_or_null(part: Column, whole: Column) -> Column:
    """A percentage; over nothing it is absent, not 0."""
    return F.when(whole > 0, part / whole * 100)


def percentage(part: Column, whole: Column) -> Column:
    """A share for bars: 0 over nothing."""
    return F.when(whole > 0, part / whole * 100).otherwise(0.0)


_MONTHS = "(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
_CLOSES = r"(?i)(?:apply by|closes on|closing date|deadline)[: ]+(?:is |on )?"


def closing_date(text: Column) -> Column:
    """The day after a closing mark: 2026-01-31, 31 January 2026, January 31, 2026 or 31.01.2026; null if it is none of them."""
    value = F.coalesce(text, F.lit(""))
    month = lambda name: F.lpad(((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(name, 1, 3))) + 2) / 3).cast("int").cast("string"), 2, "0")
    iso = F.regexp_extract(value, _CLOSES + r"(\d{4}-\d{2}-\d{2})", 1)
    dotted = [F.regexp_extract(value, _CLOSES + r"(\d{1,2})\.(\d{1,2})\.(\d{4})", i) for i in (1, 2, 3)]
    first = [F.regexp_extract(value, _CLOSES + r"(\d{1,2}) " + _MONTHS + r",? (\d{4})", i) for i in (1, 2, 3)]
    last = [F.regexp_extract(value, _CLOSES + _MONTHS + r" (\d{1,2}),? (\d{4})", i) for i in (1, 2, 3)]
    two = lambda c: F.lpad(c, 2, "0")
    found = (
        F.when(iso != "", iso)
        .when(dotted[0] != "", F.concat_ws("-", dotted[2], two(dotted[1]), two(dotted[0])))
        .when(first[0] != "", F.concat_ws("-", first[2], month(first[1]), two(first[0])))
        .when(last[0] != "", F.concat_ws("-", last[2], month(last[0]), two(last[1])))
    )
    return F.try_to_date(found, "yyyy-MM-dd")
