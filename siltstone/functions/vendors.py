"""Posting URLs of hiring systems: vendor, board coordinates, board URLs, one key for all spellings of a job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import host, let, normalized_url

# Domains of each hiring system (fixed values).
VENDOR_DOMAINS = {
    "greenhouse": ("greenhouse.io",), "lever": ("lever.co",), "ashby": ("ashbyhq.com",), "workday": ("myworkdayjobs.com", "myworkdaysite.com"),
    "icims": ("icims.com",), "successfactors": ("successfactors.com", "successfactors.eu", "jobs2web.com"), "dayforce": ("dayforcehcm.com",),
    "ultipro": ("ultipro.com", "ultipro.ca"), "taleo": ("taleo.net",), "bamboohr": ("bamboohr.com",), "hibob": ("careers.hibob.com",),
    "smartrecruiters": ("smartrecruiters.com",), "csod": ("csod.com",), "hirehive": ("hirehive.com",), "talentlink": ("recruitmentplatform.com",),
}
# Query parameters that name a page's language, and those that name where a visitor came from on job pages (fixed values).
LANGUAGE_PARAMS = "lang|language|locale"
SOURCE_PARAMS = "ref|src|source|lever-origin|lever-source|rltr"
_UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
_WEB = r"(?i)^https?://[^/?#]"


def path(url: Column) -> Column:
    return F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)


def param(url: Column, name: str) -> Column:
    """A query parameter, '' where it is not given."""
    return F.when(url.contains(f"{name}="), F.regexp_extract(url, rf"[?&]{name}=([^&#\s]*)", 1)).otherwise("")


def segment(url: Column, k: int) -> Column:
    """The k-th path segment from 0, null beyond the last."""
    return F.get(F.filter(F.split(path(url), "/"), lambda s: s != ""), k)


def on_domains(name: Column, domains: tuple[str, ...]) -> Column:
    some = F.lit(False)
    for d in domains:
        some = some | name.contains(d)
    return some & name.rlike(r"(^|\.)(" + "|".join(d.replace(".", r"\.") for d in domains) + ")$")


def ats_vendor(url: Column) -> Column:
    """The hiring system that a host belongs to, else the host; null for other than http(s)."""
    name = host(url)
    out = F.when(name.rlike(r"(^|\.)oraclecloud([1-9][0-9]?)?\.com$"), F.lit("oraclecloud")).otherwise(name)
    for vendor, domains in reversed(VENDOR_DOMAINS.items()):
        out = F.when(on_domains(name, domains), F.lit(vendor)).otherwise(out)
    return F.when(F.trim(url).rlike(_WEB) & (name != ""), out)


def ats_coordinates(url: Column) -> Column:
    """(vendor, slug) of the board a posting stands on; null where the URL names none."""
    name, first, second = host(url), F.lower(segment(url, 0)), F.lower(segment(url, 1))
    tenant = F.regexp_extract(name, r"^([^.]+)\.(wd[0-9]+)\.myworkdayjobs\.com$", 1)
    site = F.when(first.rlike("^[a-z]{2}-[a-z]{2}$") & second.isNotNull(), second).otherwise(first)
    workday = F.concat_ws("|", tenant, F.regexp_extract(name, r"\.(wd[0-9]+)\.", 1), site)
    board = F.struct(
        F.when(on_domains(name, ("greenhouse.io",)), "greenhouse").when(on_domains(name, ("lever.co",)), "lever").when(name == "jobs.ashbyhq.com", "ashby")
        .when(tenant != "", "workday").when(on_domains(name, ("icims.com",)), "icims").alias("vendor"),
        F.when(on_domains(name, ("greenhouse.io",)) & first.isin("embed", "v1"), F.nullif(F.lower(param(url, "for")), F.lit("")))
        .when(tenant != "", F.when(site.isNotNull(), workday))
        .when(on_domains(name, ("icims.com",)), F.regexp_extract(name, r"^(?:careers-)?([^.]+)\.icims\.com$", 1)).otherwise(first).alias("slug"),
    )
    return F.when(board["vendor"].isNotNull() & board["slug"].isNotNull(), board)


def board_url(vendor: Column, slug: Column) -> Column:
    """The public page of a board; null for vendors that have none."""
    part = lambda i: F.get(F.split(slug, r"\|"), i)
    return (
        F.when(vendor == "greenhouse", F.concat(F.lit("https://job-boards.greenhouse.io/"), slug))
        .when(vendor == "lever", F.concat(F.lit("https://jobs.lever.co/"), slug))
        .when(vendor == "ashby", F.concat(F.lit("https://jobs.ashbyhq.com/"), slug))
        .when(vendor == "icims", F.concat(F.lit("https://careers-"), slug, F.lit(".icims.com/")))
        .when(vendor == "workday", F.concat(F.lit("https://"), part(0), F.lit("."), part(1), F.lit(".myworkdayjobs.com/"), part(2)))
    )


def posting_language(url: Column) -> Column:
    """The primary language subtag that a URL asks for, '' for none: by a parameter, or by a locale as the first path segment."""
    asked = F.concat_ws("", *[param(url, p) for p in LANGUAGE_PARAMS.split("|")])
    locale = F.when(segment(url, 0).rlike("(?i)^[a-z]{2}-[a-z]{2}$"), segment(url, 0)).otherwise("")
    return F.lower(F.regexp_extract(F.when(asked != "", asked).otherwise(locale), "^([A-Za-z]{2,3})(?:[-_]|$)", 1))


def job_key(url: Column) -> Column:
    """One key for all spellings of a job's URL: the vendor's id where it shows, else the plain URL with its path in lower case; '' for none.

    Language and visitor parameters, a locale before a path, and the last step of an application form don't count.
    """
    # Host and path are found once; a vendor's patterns see only URLs that name the vendor.
    parts = F.struct(url.alias("url"), host(url).alias("name"), path(url).alias("way"))
    key = F.when(F.trim(url).rlike(_WEB), let(parts, lambda u: _job_key(u["url"], u["name"], u["way"])))
    return F.coalesce(key, F.lit(""))


def _job_key(url: Column, name: Column, way: Column) -> Column:
    digits = lambda c: F.when(c.rlike("^[0-9]+$"), c)
    found = lambda c: F.nullif(c, F.lit(""))
    board = on_domains(name, ("greenhouse.io",)) & name.rlike(r"^(job-boards|boards|boards-api)\.")
    in_path = F.when(board, F.coalesce(found(F.regexp_extract(way, r"/jobs/([0-9]+)/?$", 1)), F.when(way.rlike("^/embed/job_app/?$"), digits(param(url, "token")))))
    ids = F.struct(in_path.alias("path"), digits(param(url, "gh_jid")).alias("query"))
    greenhouse = let(ids, lambda x: F.when(x["path"].isNull() | x["query"].isNull() | (x["path"] == x["query"]), F.coalesce(x["path"], x["query"])))
    linked = F.when(
        on_domains(name, ("linkedin.com",)), F.coalesce(found(F.regexp_extract(way, r"^/(?:comm/)?jobs/view/(?:[^/]*-)?([0-9]{7,})/?$", 1)), digits(param(url, "currentJobId")))
    )
    indeed = F.when(on_domains(name, ("indeed.com",)), F.coalesce(found(param(url, "jk")), found(param(url, "vjk"))))
    recruiters = r"(?i)^/([^/]+)/(" + _UUID + r"|[0-9]+)(?:-[^/]*)?/?$"
    smart = F.when((name == "jobs.smartrecruiters.com") & way.rlike(recruiters), F.lower(F.concat_ws("/", F.regexp_extract(way, recruiters, 1), F.regexp_extract(way, recruiters, 2))))
    asked = F.when(url.contains("="), F.regexp_replace(url, rf"(?i)([?&])(?:{LANGUAGE_PARAMS}|{SOURCE_PARAMS})=[^&#]*", "$1")).otherwise(url)
    form = rf"^(https://jobs\.(?:lever\.co|ashbyhq\.com)/[^/]+/(?:{_UUID}|[0-9]+))/(?:apply|application)$"

    def folded(key: Column) -> Column:
        # Ids in parameters may differ in case only; paths don't.
        lower = F.lower(F.substring_index(key, "?", 1))
        cased = F.when(key.contains("?"), F.concat(lower, F.regexp_extract(key, r"\?.*$", 0))).otherwise(lower)
        unlocal = lambda c: F.when(c.contains(".myworkdayjobs.com/"), F.regexp_replace(c, r"^(https://[^/]+\.myworkdayjobs\.com)/[a-z]{2}-[a-z]{2}(?=/)", "$1")).otherwise(c)
        return let(cased, lambda c: F.when(c.startswith("https://jobs.lever.co/") | c.startswith("https://jobs.ashbyhq.com/"), F.regexp_replace(c, form, "$1")).otherwise(unlocal(c)))

    keyed = lambda label, c: F.concat(F.lit(label + ":"), c)
    return F.coalesce(keyed("linkedin.com", linked), keyed("indeed.com", indeed), keyed("greenhouse", greenhouse), keyed("smartrecruiters", smart), let(normalized_url(asked), folded))


def url_relation(left: Column, right: Column) -> Column:
    """same, distinct, one-sided-language (one of two equal keys asks for a language) or no-key."""

    def languages(l: Column) -> Column:
        x, y = l["x"], l["y"]
        return F.when(x == y, "same").when((x != "") & (y != ""), "distinct").otherwise("one-sided-language")

    def relation(u: Column) -> Column:
        a, b = u["a"], u["b"]
        asked = F.struct(posting_language(u["left"]).alias("x"), posting_language(u["right"]).alias("y"))
        return F.when((a == "") | (b == ""), "no-key").when(a != b, "distinct").otherwise(let(asked, languages))

    return let(F.struct(left.alias("left"), right.alias("right"), job_key(left).alias("a"), job_key(right).alias("b")), relation)
