"""Row filters of the ingest side as Column functions: unknown passes unless a filter is strict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_rule, keyword


def _any(value: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for term in terms:
        out = out | keyword(value, term)
    return out


def location_filter(
    place: Column, title: Column, allow: list[str], block: list[str], always_allow: list[str] = [], block_hard: list[str] = [], strict: bool = False
) -> Column:
    """Tiers: a hard block, always-allow, block, allow, and a title that says remote; an empty place passes unless strict."""
    value = F.trim(F.coalesce(place, F.lit("")))
    allowed = F.lit(not allow) | _any(value, allow) | F.lower(value).rlike(r"worldwide|anywhere") | keyword(title, "word:remote")
    tiers = F.when(_any(value, block_hard), False).when(_any(value, always_allow), True).when(_any(value, block), False).otherwise(allowed)
    return F.when(value == "", F.lit(not strict)).otherwise(tiers)


def salary_filter(low: Column, high: Column, currency: Column, floor: float, wanted: str) -> Column:
    """The lower bound, or else the upper one, against a floor in one currency; absent amounts and other currencies pass."""
    amount = F.coalesce(low, high)
    other = F.lower(F.coalesce(currency, F.lit(wanted))) != wanted.lower()
    return amount.isNull() | other | (amount >= floor)


#: Ordered classes of employment; a negation before a word voids it.
EMPLOYMENT = [
    (r"\bintern(ship)?\b|\bpraktik", "internship"), (r"\bcontract(or)?\b|\bfreelance\b", "contract"), (r"\btemporary\b|\btemp\b|\bseasonal\b", "temporary"),
    (r"\bpart[- ]?time\b|\bteilzeit\b", "part-time"), (r"\bfull[- ]?time\b|\bpermanent\b|\bvollzeit\b", "full-time"),
]


def employment_type(text: Column) -> Column:
    value = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\b(not?|non|no)[- ](a )?[a-z-]+", " ")
    return F.nullif(first_rule(value, EMPLOYMENT, ""), F.lit(""))


def employment_filter(text: Column, allowed: list[str], include_unknown: bool = True) -> Column:
    if unknown := set(allowed) - {label for _, label in EMPLOYMENT}:
        raise ValueError(f"no such employment type: {sorted(unknown)}")
    kind = employment_type(text)
    return F.when(kind.isNull(), F.lit(include_unknown)).otherwise(kind.isin(*allowed))


#: Facet classes of seniority, none if nothing is said.
FACETS = [
    (r"\b(intern|internship|trainee)\b", "intern"), (r"\b(junior|jr|entry|graduate)\b", "junior"), (r"\b(staff|principal)\b", "staff"),
    (r"\b(lead|head|director|vp|chief)\b", "lead"), (r"\b(senior|sr)\b", "senior"), (r"\b(mid|intermediate)\b", "mid"),
]


def facet_seniority(title: Column) -> Column:
    return F.nullif(first_rule(F.lower(F.coalesce(title, F.lit(""))), FACETS, ""), F.lit(""))


def title_fit(title: Column, wanted: Column) -> Column:
    """3 for the phrase or all of its words, 2 for 60 % and 1 for 34 % of them, else 0."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}+#]+"), lambda w: w != ""))
    have, want = words(title), words(wanted)
    share = F.size(F.array_intersect(have, want)) / F.greatest(F.size(want), F.lit(1))
    return F.when(F.size(want) == 0, 0).when(share >= 1, 3).when(share >= 0.6, 2).when(share >= 0.34, 1).otherwise(0)


def fit_score(title: Column, wanted: Column, remote: Column, place_ok: Column, pay_ok: Column) -> Column:
    """Title fit, and one point each for remote, place and pay, at most five."""
    return F.least(F.lit(5), title_fit(title, wanted) + sum((F.when(t, 1).otherwise(0) for t in (remote, place_ok, pay_ok)), F.lit(0)))


def recommendation(score: Column, hard_stop: Column, suspicious: Column) -> Column:
    """Apply from 4.0, Consider from 3.0, else Skip; a hard stop skips and a suspicion asks for a check first."""
    return (
        F.when(hard_stop, "Skip").when(score.isNull(), None).when(suspicious & (score >= 4), "Check first").when(score >= 4, "Apply").when(score >= 3, "Consider").otherwise("Skip")
    )


def triage(score: Column) -> Column:
    return F.when(score >= 3.5, "PASS").when(score >= 3.0, "MARGINAL").when(score.isNotNull(), "FAIL")


def public_url(url: Column) -> Column:
    """http(s), no credentials, and no private, local or numeric host."""
    value = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    host = F.regexp_replace(F.regexp_extract(value, r"^https?://([^/?#:]+)", 1), r"\.+$", "")
    private = host.rlike(r"^(localhost|.*\.local|.*\.internal|0x[0-9a-fx.]+|[0-9.]+|\[.*)$")
    return value.rlike(r"^https?://") & (host != "") & ~F.contains(F.regexp_extract(value, r"^https?://([^/?#]*)", 1), F.lit("@")) & ~private & F.contains(host, F.lit("."))
