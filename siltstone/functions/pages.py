"""Postings in pages: linked data, embedded descriptions; who asks, and how fresh evidence is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCRIPT = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"
_NODES = "array<map<string,string>>"
# Roles of interviewers by words of their titles, in order of precedence (fixed values).
PANEL_ROLES = {
    "recruiter": "recruit|talent|sourcer", "hr": "human resources|people|hr", "executive": "chief|ceo|cto|cfo|vp|vice president|founder",
    "hiring-manager": "manager|head|director|lead", "engineer": "engineer|developer|architect", "product": "product|program",
}


def job_posting(html: Column) -> Column:
    """(title, company, description, posted, closes, employment) of the one JobPosting in a page's linked data, at the top, in a list or in a @graph; null for none or several."""
    blocks = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_SCRIPT), F.lit(1))

    def nodes(block: Column) -> Column:
        top = F.when(F.trim(block).startswith("["), F.from_json(block, _NODES)).otherwise(F.array(F.from_json(block, "map<string,string>")))
        inner = F.flatten(F.transform(F.filter(top, lambda m: m["@graph"].isNotNull()), lambda m: F.coalesce(F.from_json(m["@graph"], _NODES), F.array().cast(_NODES))))
        return F.concat(F.coalesce(top, F.array().cast(_NODES)), F.coalesce(inner, F.array().cast(_NODES)))

    found = F.filter(F.flatten(F.transform(blocks, nodes)), lambda m: m["@type"] == "JobPosting")
    one = found[0]
    company = F.coalesce(F.get_json_object(one["hiringOrganization"], "$.name"), one["hiringOrganization"])
    fields = {"title": one["title"], "company": company, "description": one["description"], "posted": one["datePosted"], "closes": one["validThrough"], "employment": one["employmentType"]}
    return F.when(F.size(found) == 1, F.struct(*[v.alias(k) for k, v in fields.items()]))


def embedded_description(html: Column) -> Column:
    """The longest \"description\" string of a page's embedded JSON, unescaped; null for none."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'"description"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1))
    sized = F.array_max(F.transform(found, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    return F.get_json_object(F.concat(F.lit('{"d":"'), sized, F.lit('"}')), "$.d")


def panel_role(title: Column) -> Column:
    """(role, also): the first role that a title's words name, and the others; null for none."""
    text = F.lower(F.coalesce(title, F.lit("")))
    hits = F.filter(F.array(*[F.when(text.rlike(rf"\b({words})"), F.lit(role)) for role, words in PANEL_ROLES.items()]), lambda r: r.isNotNull())
    return F.when(F.size(hits) > 0, F.struct(hits[0].alias("role"), F.slice(hits, 2, len(PANEL_ROLES)).alias("also")))


def evidence_freshness(days: Column, changes: Column, truncated: Column, oldest: int = 30) -> Column:
    """unknown without a date, stale after `oldest` days or with changes since, partial if the source was cut, else fresh."""
    return F.when(days.isNull(), "unknown").when((days > oldest) | (F.coalesce(changes, F.lit(0)) > 0), "stale").when(F.coalesce(truncated, F.lit(False)), "partial").otherwise("fresh")


def blocker_group(skill: Column, theme: Column, literal: Column) -> Column:
    """What a blocker counts under: its skill, else its theme, else its own words."""
    plain = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    return F.coalesce(plain(skill), plain(theme), plain(literal))
