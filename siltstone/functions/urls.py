"""URL keys, listing keys and trust as Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track where a visitor came from (fixed values).
TRACKING = r"^(utm_.*|gh_src|fbclid|gclid|mc_cid|mc_eid|igshid|_hsenc|_hsmi|trk|trackingid)$"


def host(url: Column) -> Column:
    found = F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.regexp_replace(F.lower(found), r"\.+$", "")


def let(value: Column, function: Callable[[Column], Column]) -> Column:
    """The function of a value that is evaluated once, however often the function names it."""
    return F.get(F.transform(F.array(value), function), 0)


def _port(value: Column) -> Column:
    """':8443', '' for none or the scheme's own."""
    found = F.regexp_extract(value, r"^[A-Za-z]+://[^/?#]*?:([0-9]+)(?:[/?#]|$)", 1)
    named = let(found, lambda p: F.when((p == "") | (p == "443") | (value.rlike("(?i)^http:") & (p == "80")), "").otherwise(F.concat(F.lit(":"), p)))
    # The colon of http: and https: stands before.
    return F.when(F.locate(":", value, 7) > 0, named).otherwise("")


def _pairs(query: Column) -> Column:
    """Parameters as (name, rest): the rest begins with '=' or is empty."""
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("name"), F.regexp_replace(p, "^[^=]*", "").alias("rest")))


# A job's page within a page (fixed value), and the parameters that name a language.
_JOB_FRAGMENT = r"(?i)#!?/jobs?/([^/?#]+)/?(?:\?([^#]*))?$"
_LANGUAGE = "^(language|lang|locale)$"


def _fragment_pairs(value: Column, name: Column, given: Column) -> Column:
    """Parameters that a fragment stands for: the id of a job, and its language where the query has none; other fragments mean nothing."""
    job = F.try_url_decode(F.regexp_replace(F.regexp_extract(value, _JOB_FRAGMENT, 1), r"\+", "%2B"))
    asked = F.filter(_pairs(F.regexp_extract(value, _JOB_FRAGMENT, 2)), lambda p: p["name"].rlike(_LANGUAGE) & (F.length(p["rest"]) > 1) & ~F.exists(given, lambda g: g["name"] == p["name"]))
    label = F.when(name == "app.mokahr.com", "mokahr_job_id").otherwise("fragment_job_id")
    none = F.array().cast("array<struct<name:string,rest:string>>")
    return F.when(F.coalesce(job, F.lit("")) != "", F.concat(F.array(F.struct(label.alias("name"), F.concat(F.lit("="), job).alias("rest"))), asked)).otherwise(none)


def normalized_url(url: Column, tracking: str = TRACKING) -> Column:
    """A stable key: https, lower host, its port, no tracking parameters, the rest sorted, no trailing slash; '' for others than http(s).

    A fragment is dropped, but for the job's id in ``#/job/{id}`` and ``#/jobs/{id}``, which becomes a parameter.
    One vendor's jobs have one shape, whether the id stands in the path or in the query.
    """
    value = F.trim(F.coalesce(url, F.lit("")))
    # Each part is found once, and only where its mark shows: one URL in a table of many asks for few of the patterns.
    query = F.when(value.contains("?"), F.regexp_extract(value, r"^[^?#]*\?([^#]*)", 1)).otherwise("")
    parts = F.struct(value.alias("value"), host(value).alias("name"), F.regexp_extract(value, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1).alias("path"), _pairs(query).alias("given"))

    def key(u: Column) -> Column:
        value, name, given = u["value"], u["name"], u["given"]
        path = F.when(u["path"] == "", "/").when(F.length(u["path"]) > 1, F.regexp_replace(u["path"], "/$", "")).otherwise(u["path"])
        named = F.when(value.contains("#"), F.concat(given, _fragment_pairs(value, name, given))).otherwise(given)
        pairs = F.filter(named, lambda p: ~p["name"].rlike("(?i)" + tracking))
        kept = F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(p["name"], p["rest"])), "&")
        asked = F.when(value.contains("?") | value.contains("#"), let(kept, lambda k: F.when(k == "", "").otherwise(F.concat(F.lit("?"), k)))).otherwise("")
        plain = F.concat(F.lit("https://"), name, _port(value), path, asked)
        job = F.coalesce(F.nullif(F.regexp_extract(path, "(?i)^/careers/job/([0-9]+)$", 1), F.lit("")), F.when(path.rlike("(?i)^/careers$"), F.regexp_extract(value, r"[?&]pid=([0-9]+)(?:[&#]|$)", 1)))
        one_shape = let(F.coalesce(job, F.lit("")), lambda j: F.when(j != "", F.concat(F.lit("https://apply.careers.microsoft.com/careers?domain=microsoft.com&pid="), j)))
        return F.coalesce(F.when(name == "apply.careers.microsoft.com", one_shape), plain)

    return F.when(value.rlike(r"(?i)^https?://[^/?#]"), let(parts, key)).otherwise("")


def listing_key(provider: Column, board: Column, posting: Column) -> Column:
    """listing_v1_ and the SHA-256 of a compact JSON array of the identity; null if a part is missing."""
    whole = F.concat(
        F.lit('["listing-fingerprint",1,"'), F.lower(F.trim(provider)), F.lit('","'), F.lower(F.trim(board)), F.lit('","'), F.trim(posting), F.lit('"]')
    )
    missing = F.coalesce(F.trim(provider) == "", F.lit(True)) | F.coalesce(F.trim(board) == "", F.lit(True)) | F.coalesce(F.trim(posting) == "", F.lit(True))
    return F.when(~missing, F.concat(F.lit("listing_v1_"), F.sha2(whole, 256)))


def on_domain_list(name: Column, domains: list[str]) -> Column:
    """A host is a listed domain or below it."""
    out = F.lit(False)
    for d in domains:
        out = out | (name == d) | name.endswith("." + d)
    return out


def trust(title: Column, company: Column, url: Column, suspicious: list[str]) -> Column:
    """(score, level, flags): 100 less the faults of a posting; an invalid URL ends the test."""
    invalid = ~F.coalesce(url, F.lit("")).rlike(r"(?i)^https?://[^/?#@\s]+\.[a-z]{2,}")
    missing = (F.trim(F.coalesce(title, F.lit(""))) == "") | (F.trim(F.coalesce(company, F.lit(""))) == "")
    name = host(url)
    flags = {
        "missing_fields": (missing, 40),
        "suspicious_domain": (on_domain_list(name, suspicious), 25),
        "company_domain_mismatch": (~company_matches_host(company, name), 15),
    }
    penalty, names = F.lit(0), []
    for flag, (test, points) in flags.items():
        penalty = penalty + F.when(test, points).otherwise(0)
        names.append(F.when(test, F.lit(flag)))
    score = F.when(invalid, 50).otherwise(F.greatest(F.lit(0), 100 - penalty))
    level = F.when(score >= 90, "high").when(score >= 60, "medium").otherwise("low")
    return F.struct(
        score.cast("int").alias("score"), level.alias("level"), F.when(invalid, F.lit("invalid_url")).otherwise(F.concat_ws(",", *names)).alias("flags")
    )


def company_matches_host(company: Column, name: Column) -> Column:
    """The company's letters, or one of its words of three or more, stand in the host."""
    value = F.lower(F.coalesce(company, F.lit("")))
    slug = F.regexp_replace(value, r"[^a-z0-9]+", "")
    words = F.filter(F.split(value, r"[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    return (slug != "") & (F.contains(name, slug) | F.exists(words, lambda w: F.contains(name, w)))
