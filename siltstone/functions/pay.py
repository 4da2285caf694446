"""Pay statements: amounts with grouping and k, ranges, period, currency."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# An amount: groups of three digits, or digits; up to two decimals; k.
_AMOUNT = r"((?:[0-9]{1,3}(?:[., '][0-9]{3})+|[0-9]+)(?:[.,][0-9]{1,2})?(?![0-9])\s?[kK]?)"
# Words of each period, in order of precedence, and how many of it a year has (fixed values).
PERIODS = {
    "annual": (r"/\s*(?:year|yr)\b|\bper\s+(?:year|annum)\b|\bannual(?:ly)?\b|\byearly\b", 1),
    "monthly": (r"/\s*(?:month|mo)\b|\bper\s+month\b|\bmonthly\b", 12),
    "weekly": (r"/\s*(?:week|wk)\b|\bper\s+week\b|\bweekly\b", 52),
    "daily": (r"/\s*day\b|\bper\s+day\b|\bdaily\b", None),
    "hourly": (r"/\s*(?:hour|hr)\b|\bper\s+hour\b|\bhourly\b", 2080),
}
# Signs that name one currency only (fixed values).
SIGNS = {"€": "EUR", "£": "GBP"}


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def amounts(text: Column) -> Column:
    """All amounts of a text as numbers: separators before three digits group, one before one or two digits is decimal."""

    def number(found: Column) -> Column:
        digits = F.regexp_replace(F.trim(found), r"\s?[kK]$", "")
        whole = F.regexp_replace(F.regexp_replace(digits, r"[.,]([0-9]{1,2})$", "|$1"), r"[., ']", "")
        return F.regexp_replace(whole, r"\|", ".").cast("double") * F.when(found.rlike("[kK]$"), 1000.0).otherwise(1.0)

    return F.transform(F.regexp_extract_all(_text(text), F.lit(_AMOUNT), F.lit(1)), number)


def pay_range(text: Column) -> Column:
    """(low, high) of the first amount or range; 80-100k means thousands on both ends; nulls without amounts."""
    span = F.regexp_extract(_text(text), _AMOUNT + r"\s?(?:-|–|to)\s?(?:[€£$]|[A-Z]{3} )?" + _AMOUNT, 0)
    ends = amounts(F.when(span != "", span).otherwise(_text(text)))
    low, high = F.get(ends, 0), F.when(span != "", F.get(ends, 1)).otherwise(F.get(ends, 0))
    shared = span.rlike("[kK]$") & (low < 1000) & (low * 1000 <= high)
    low = F.when(shared, low * 1000).otherwise(low)
    return F.struct(F.least(low, high).alias("low"), F.greatest(low, high).alias("high"))


def period(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (words, _) in reversed(PERIODS.items()):
        out = F.when(_text(text).rlike("(?i)" + words), F.lit(name)).otherwise(out)
    return out


def currency(text: Column) -> Column:
    """The one currency code, else the one sign of a text; '' where it names several, null where it names none."""
    codes = F.array_distinct(F.regexp_extract_all(_text(text), F.lit(r"(?<![A-Za-z])([A-Z]{3})(?![A-Za-z])"), F.lit(1)))
    table = F.create_map(*[F.lit(x) for pair in SIGNS.items() for x in pair])
    signs = F.array_distinct(F.transform(F.regexp_extract_all(_text(text), F.lit("([€£])"), F.lit(1)), lambda c: F.try_element_at(table, c)))
    one = F.when(F.size(codes) == 1, F.get(codes, 0)).when((F.size(codes) == 0) & (F.size(signs) == 1), F.get(signs, 0))
    return F.when((F.size(codes) == 0) & (F.size(signs) == 0), F.lit(None)).otherwise(F.coalesce(one, F.lit("")))


def annual(amount: Column, span: Column) -> Column:
    """A year's amount; null for daily pay and unknown periods."""
    table = F.create_map(*[F.lit(x) for name, (_, n) in PERIODS.items() if n for x in (name, n)])
    return amount * F.try_element_at(table, span)


def pay_floor(text: Column) -> Column:
    """The least amount of a thousand or more."""
    return F.array_min(F.filter(amounts(text), lambda x: x >= 1000))


def states_pay(text: Column) -> Column:
    """Whether a text states pay: an amount with a currency, or an amount beside a pay word."""
    money = rf"(?:[€£$]|\b(?:EUR|USD|GBP|CHF)\b)\s?{_AMOUNT}|{_AMOUNT}\s?(?:[€£$]|(?:EUR|USD|GBP|CHF)\b)"
    beside = rf"(?i)\b(?:salary|pay|compensation|wage|remuneration)\b[^0-9\n]{{0,20}}{_AMOUNT}"
    return _text(text).rlike(money) | _text(text).rlike(beside)
