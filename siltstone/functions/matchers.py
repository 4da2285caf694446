"""Filters by content, domain, workplace, company and search text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import keyword


def content_keyword(text: Column, term: str) -> Column:
    """A keyword in a long text: marked ones as in titles, plain ones anywhere."""
    if term.startswith(("word:", "stem:")):
        return keyword(text, term)
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(term.strip().lower())) if term.strip() else F.lit(False)


def content_traits(text: Column, traits: list[str], min_match: int = 1) -> Column:
    """At least min_match of the traits (alternatives by |; repeated traits count once); no traits let all pass."""
    own = {t.strip().lower(): t for t in reversed(traits) if t.strip()}
    tests = [reduce(Column.__or__, [content_keyword(text, a.strip()) for a in t.split("|")]) for t in own.values()]
    return sum((t.cast("int") for t in tests), F.lit(0)) >= min_match if tests else F.lit(True)


def domain_filter(text: Column, terms: list[str]) -> Column | None:
    """Any of the terms as a word of its own; None (no filter) without terms."""
    own = [t if t.startswith(("word:", "stem:")) else f"word:{t.strip()}" for t in terms if t.strip()]
    return reduce(Column.__or__, [keyword(text, t) for t in own]) if own else None


def workplace(value: Column) -> Column:
    """remote, hybrid or onsite of a field of its own; null for anything else."""
    text = F.lower(F.trim(value))
    return F.when(text.isin("remote", "hybrid"), text).when(text.isin("onsite", "on-site"), "onsite")


def posting_url(value: Column, longest: int = 2048) -> Column:
    """A usable posting URL, trimmed; null if it is too long, no web address, has credentials or control characters."""
    text = F.trim(value)
    bad = (F.length(text) > longest) | text.rlike(r"[\x00\r\n]") | text.rlike(r"^[A-Za-z]+://[^/?#]*@")
    return F.when(~bad & text.rlike(r"(?i)^https?://[^/?#\s:]"), text)


def search(terms: str, *cells: Column) -> Column:
    """The text stands in one of the cells, whatever its case; an empty text finds all."""
    want = terms.strip().lower()
    return reduce(Column.__or__, [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(want)) for c in cells]) if want else F.lit(True)


def in_company_scope(wanted: Column, company: Column, url: Column) -> Column:
    """A company's letters and digits stand in the noted company or in the URL."""
    plain = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")
    return (plain(wanted) != "") & (F.contains(plain(company), plain(wanted)) | F.contains(plain(url), plain(wanted)))


def title_conflicts(positive: list[str], negative: list[str]) -> Column:
    """(positive, negative) pairs, as an array: keywords whose own words a negative one vetoes."""
    pairs = []
    for p in positive:
        title = F.lit(" ".join(part.split(":", 1)[-1].strip() for part in p.split(" + ")))
        pairs += [F.when(keyword(title, n), F.struct(F.lit(p).alias("positive"), F.lit(n).alias("negative"))) for n in negative]
    return F.filter(F.array(*pairs), lambda x: x.isNotNull()) if pairs else F.array()
