"""Names of captured files, what a score hangs on, target keywords of a profile, and boards that were read in part."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most bytes of a slug, so that a company's and a role's together keep a file's name short.
SLUG_BYTES = 60


def _folded(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[\s_]+", "-"), "^-+|-+$", "")


def _within(text: Column, most: int) -> Column:
    """The first characters of a text that fit into so many bytes."""

    def add(kept: Column, char: Column) -> Column:
        fits = ~kept["full"] & (F.octet_length(kept["text"]) + F.octet_length(char) <= most)
        return F.struct(F.when(fits, F.concat(kept["text"], char)).otherwise(kept["text"]).alias("text"), (~fits).alias("full"))

    chars = F.filter(F.split(F.left(text, F.lit(most)), ""), lambda c: c != "")
    return F.aggregate(chars, F.struct(F.lit("").alias("text"), F.lit(False).alias("full")), add)["text"]


def capture_slug(text: Column, most: int = SLUG_BYTES) -> Column:
    """ASCII letters, digits and hyphens of a name; of a name without any, the letters and digits of its own script."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    plain = F.left(_folded(F.regexp_replace(lower, r"[^A-Za-z0-9_\s-]", "")), F.lit(most))
    own = _within(_folded(F.regexp_replace(lower, r"[^\p{L}\p{M}\p{N}\s_-]", "")), most)
    return F.when(plain != "", plain).otherwise(own)


def score_levers(hard_stops: Column, soft_gaps: Column, confidence_gaps: Column, unknown: Column, strengths: Column) -> Column:
    """(holding, close, verify, strengths) of a report's lists; nulls are empty."""
    none = F.array().cast("array<string>")
    stops, soft, open_, dark, strong = (F.coalesce(c, none) for c in (hard_stops, soft_gaps, confidence_gaps, unknown, strengths))
    verify = F.concat(open_, F.transform(dark, lambda label: F.concat(label, F.lit(" evidence is unknown"))))
    return F.struct(stops.alias("holding"), F.array_distinct(soft).alias("close"), verify.alias("verify"), strong.alias("strengths"))


def card_reason(decision: Column, levers: Column) -> Column:
    """(decision, plus, minus): the call, the first strength, and the first hard stop or else gap; null where all are missing."""
    plus, minus = F.get(levers["strengths"], 0), F.coalesce(F.get(levers["holding"], 0), F.get(levers["close"], 0))
    some = (F.coalesce(decision, F.lit("")) != "") | plus.isNotNull() | minus.isNotNull()
    return F.when(some, F.struct(decision.alias("decision"), plus.alias("plus"), minus.alias("minus")))


def target_keywords(primary: Column, archetypes: Column) -> Column:
    """A profile's own roles, then its archetypes' names: trimmed, distinct, without blanks."""
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce(primary, none), F.coalesce(archetypes, none))
    return F.array_distinct(F.filter(F.transform(both, lambda k: F.trim(k)), lambda k: k.isNotNull() & (k != "")))


def truncation_note(company: Column, reason: Column, fetched: Column, total: Column) -> Column:
    """One line on a board that was read in part; null for one that was read whole."""
    of = F.concat(F.lit(", "), fetched.cast("string"), F.lit(" of "), total.cast("string"))
    omitted = F.concat(company, F.lit(" (descriptions omitted"), F.coalesce(F.concat(of, F.lit(" with descriptions")), F.lit("")), F.lit(")"))
    read = F.coalesce(of, F.concat(F.lit(", "), fetched.cast("string"), F.lit(" read")), F.lit(""))
    return F.when(reason == "descriptions-omitted", omitted).otherwise(F.concat(company, F.lit(" ("), reason, read, F.lit(")")))
