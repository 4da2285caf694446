"""Queries over diagnoses, reply evidence and links in mails."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vendors
from ..operators import diagnosis, mail_links
from ..operators.lineage import settled
from . import tables as t
from . import vendor_queries as v

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


_STATUS = "CASE n % 7 WHEN 0 THEN 'added' WHEN 1 THEN 'skipped_title' WHEN 2 THEN 'skipped_location' ELSE 'skipped_dup' END"


@query(f"""WITH {v.LISTINGS_SQL}, {v._BOARDS}, post AS (SELECT n, url, 'c' || CAST(company % 400 AS varchar) AS company, CASE WHEN slug IS NULL THEN NULL ELSE vendor END AS vendor, slug, title, {v._key("url")} AS key,
  CASE WHEN n % 5 = 0 THEN '' ELSE state END AS location FROM slugs),
hist AS (SELECT key, min_by(status, CAST(day AS varchar) || status) AS status FROM (SELECT {v._key("url")} AS key, {_STATUS} AS status, day FROM listings WHERE n % 11 = 0) WHERE key <> '' GROUP BY key),
entries AS (SELECT 'c' || CAST(company % 400 AS varchar) AS company, CASE WHEN slug IS NULL THEN NULL ELSE vendor END AS vendor, slug, n AS entry, n % 3 <> 0 AS enabled, CASE WHEN n % 4 = 0 THEN NULL ELSE vendor END AS provider FROM slugs WHERE n % 97 = 0),
b AS (SELECT vendor, slug, min(entry) AS entry FROM entries WHERE slug IS NOT NULL GROUP BY vendor, slug), c AS (SELECT company, min(entry) AS entry FROM entries GROUP BY company),
scanned AS (SELECT DISTINCT 'c' || CAST(company % 400 AS varchar) AS company FROM listings WHERE n % 53 = 0),
j AS (SELECT p.*, h.status, coalesce(b.entry, c.entry) AS entry, s.company IS NOT NULL AS scanned FROM post p LEFT JOIN hist h ON h.key = p.key LEFT JOIN b ON b.vendor = p.vendor AND b.slug = p.slug
  LEFT JOIN c ON c.company = p.company LEFT JOIN scanned s ON s.company = p.company),
k AS (SELECT j.*, e.enabled, e.provider, j.entry IS NOT NULL AND j.slug IS NOT NULL AND NOT (e.vendor IS NOT DISTINCT FROM j.vendor AND e.slug IS NOT DISTINCT FROM j.slug) AS other, title <> '5-LOW' AS title_ok FROM j LEFT JOIN entries e ON e.entry = j.entry),
d AS (SELECT *, CASE WHEN status = 'added' THEN 'surfaced' WHEN status IS NOT NULL THEN 'filtered' WHEN entry IS NOT NULL THEN CASE WHEN NOT enabled THEN 'tracked-disabled' WHEN provider IS NULL AND NOT scanned THEN 'tracked-no-provider'
  WHEN NOT title_ok THEN 'tracked-title-filter' WHEN location = 'P' THEN 'tracked-location-filter' ELSE 'tracked-not-seen' END WHEN slug IS NULL THEN 'untracked-unsupported-ats' ELSE 'untracked' END AS code FROM k)
SELECT n, code, CASE code WHEN 'filtered' THEN CASE WHEN status IN ('skipped_title', 'skipped_location') THEN substr(status, 9) ELSE 'none' END WHEN 'tracked-disabled' THEN 'enable'
  WHEN 'tracked-no-provider' THEN CASE WHEN slug IS NULL THEN 'search only' ELSE 'point at ' || vendor || ':' || slug END WHEN 'tracked-title-filter' THEN 'title' WHEN 'tracked-location-filter' THEN 'location'
  WHEN 'tracked-not-seen' THEN CASE WHEN other THEN 'point at ' || vendor || ':' || slug ELSE 'none' END WHEN 'untracked-unsupported-ats' THEN 'add by careers page'
  WHEN 'untracked' THEN CASE WHEN title_ok THEN 'add ' || vendor || ':' || slug ELSE 'add with a title keyword' END ELSE 'none' END AS advice, entry, other AS other_board FROM d""")
def coverage_diagnosis(spark, sf_dir):
    """Why no scanner brought each listing, by nine codes."""
    rows = v.listings(spark, sf_dir)
    named = F.concat(F.lit("c"), (F.col("company") % 400).cast("string")).alias("company")
    key, board = vendors.job_key(F.col("url")).alias("key"), vendors.ats_coordinates(F.col("url")).alias("b")
    posted = settled(rows, "n", "url", named, board, "title", key, F.when(F.col("n") % 5 == 0, "").otherwise(F.col("state")).alias("location"))
    posted = posted.select("n", "url", "company", F.col("b.vendor").alias("vendor"), F.col("b.slug").alias("slug"), "title", "key", "location")
    history = settled(rows.where("n % 11 = 0"), key, F.col("day").alias("seen_on"), F.expr(_STATUS).alias("status"))
    vendor = F.when(F.col("n") % 4 != 0, vendors.ats_vendor(F.col("url")))
    entries = settled(rows.where("n % 97 = 0"), F.col("n").alias("entry"), named, board, (F.col("n") % 3 != 0).alias("enabled"), vendor.alias("provider"))
    entries = entries.select("entry", "company", F.col("b.vendor").alias("vendor"), F.col("b.slug").alias("slug"), "enabled", "provider")
    scanned = rows.where("n % 53 = 0").select(named)
    return diagnosis.coverage(posted, history, entries, scanned, F.col("title") != "5-LOW", F.col("location") != "P")


#: Signs in the turns of a conversation, for a score that both engines can sum.
_SIGNS = {"question": (3, "%?%", True, True, False), "that": (2, "% that %", False, False, False), "thanks": (1, "% the %", False, False, False), "ending": (-3, "%.", False, False, True), "of": (2, "% of %", False, True, False)}


def _sign_sql() -> str:
    inviting = " OR ".join(f"coalesce(text LIKE '{p}', false)" for _, p, _, i, _ in _SIGNS.values() if i)
    shown = {n: f"(coalesce(text LIKE '{p}', false)" + (f" AND NOT ({inviting}))" if veto else ")") for n, (_, p, _, _, veto) in _SIGNS.items()}
    score = " + ".join(f"CASE WHEN {shown[n]} THEN {w} ELSE 0 END" for n, (w, *_) in _SIGNS.items())
    reasons = ", ".join(f"CASE WHEN {shown[n]} THEN '{w:+d} {n}' END" for n, (w, *_) in _SIGNS.items())
    strong = " + ".join(f"CASE WHEN {shown[n]} THEN 1 ELSE 0 END" for n, (_, _, s, _, _) in _SIGNS.items() if s)
    vetoed = " OR ".join(shown[n] for n, (*_, veto) in _SIGNS.items() if veto)
    return f"SELECT conv_id, turn, {score} AS score, concat_ws('; ', {reasons}) AS reasons, {vetoed} AS vetoed, ({score}) >= 4 AND (({strong}) > 0 OR ({inviting})) AS accepted FROM conversations"


@query(_sign_sql())
def turn_evidence(spark, sf_dir):
    """Weighted signs of every turn; what speaks against counts only where nothing speaks for it."""
    signs = {n: diagnosis.Sign(w, F.col("text").like(p), strong, inviting, veto) for n, (w, p, strong, inviting, veto) in _SIGNS.items()}
    rows = t.read(spark, sf_dir, "conversations").select("conv_id", "turn", diagnosis.evidence(signs).alias("e"))
    return rows.select("conv_id", "turn", "e.score", F.array_join("e.reasons", "; ").alias("reasons"), "e.vetoed", "e.accepted")


@query("""WITH p AS (SELECT conv_id AS num, role AS old_status, CASE WHEN text LIKE '%?%' THEN 'asked' WHEN length(text) > 600 THEN 'long' ELSE 'short' END AS new_status FROM conversations),
e AS (SELECT num, old_status, new_status, count(*) AS n FROM p GROUP BY ALL)
SELECT num, CASE WHEN count(*) = 1 THEN 'update' ELSE 'conflict' END AS verdict, CASE WHEN count(*) = 1 THEN min(old_status) END AS old_status, CASE WHEN count(*) = 1 THEN min(new_status) END AS new_status,
CAST(sum(n) AS bigint) AS proposals, CASE WHEN count(*) = 1 THEN '' ELSE string_agg(old_status || ' -> ' || new_status, '; ' ORDER BY old_status || ' -> ' || new_status) END AS choices FROM e GROUP BY num""")
def reply_transitions(spark, sf_dir):
    """For each conversation the one transition that its turns propose, or the conflict."""
    kind = F.when(F.col("text").contains("?"), "asked").when(F.length("text") > 600, "long").otherwise("short")
    rows = t.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("num"), F.col("role").alias("old_status"), kind.alias("new_status"))
    return diagnosis.transitions(rows).withColumn("choices", F.array_join("choices", "; "))


#: Mails around the pages' addresses: plain, one redirect, and three; folded as mail servers fold them.
@query("""SELECT page_id AS id, depth, url FROM (SELECT page_id, url FROM pages WHERE regexp_matches(url, '(?i)^https?://[^/?#]') AND NOT regexp_matches(url, '[\\s"''<>]')), (VALUES (0, 'https://a.example/r?to='), (1, '')) v(depth, front_)
WHERE front_ = '' UNION ALL SELECT page_id, 0, 'https://a.example/r?to=' || url_encode(url) FROM pages WHERE regexp_matches(url, '(?i)^https?://[^/?#]') AND NOT regexp_matches(url, '[\\s"''<>]')""")
def redirected_links(spark, sf_dir):
    """The links of mails that lead to every page by a redirect, and the pages that they lead to."""
    pages = t.read(spark, sf_dir, "pages").where("url RLIKE '(?i)^https?://[^/?#]' AND NOT url RLIKE '[\\\\s\"\\'<>]'")
    whole = F.concat(F.lit("See https://a.example/r?to="), F.replace(F.url_encode("url"), F.lit("+"), F.lit("%20")), F.lit(" now."))
    # Folded after 40 characters, where no escape is cut.
    folded = F.regexp_replace(whole, r"^(.{40})(.)", "$1=\n$2")
    found = mail_links.links(pages.select("page_id", folded.alias("text")), "page_id", "text")
    return found.where("depth < 2 AND (depth = 0 OR url != '')").select("id", "depth", "url")
