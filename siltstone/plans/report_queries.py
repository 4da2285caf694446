"""Queries over filters, reports and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import filters, text
from ..operators import reports
from . import tables as t
from .metric_queries import TC, T

QUERIES: dict = {}
SQL: dict = {}
ACTIVE = ("APPLIED", "RESPONDED", "ASSESSMENT", "INTERVIEW", "OFFER")


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


_HISTORY = """history AS (SELECT 'p' || CAST(user_id % 12 AS varchar) AS portal, CASE WHEN event_type IN ('view', 'click') THEN 'added' WHEN event_type = 'error' THEN 'failed' ELSE 'skipped' END AS status,
  'c' || CAST(user_id AS varchar) AS company, CAST(ts AS date) AS first_seen FROM events)"""


def _history(spark, sf_dir):
    return t.read(spark, sf_dir, "events").select(
        F.concat(F.lit("p"), (F.col("user_id") % 12).cast("string")).alias("portal"),
        F.when(F.col("event_type").isin("view", "click"), "added").when(F.col("event_type") == "error", "failed").otherwise("skipped").alias("status"),
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("company"), F.to_date("ts").alias("first_seen"),
    )


@query(f"""WITH {_HISTORY} SELECT count(*) AS total, count(*) FILTER (status = 'added') AS added, count(DISTINCT company) AS companies, count(DISTINCT portal) AS portals,
CAST(min(first_seen) AS varchar) AS first, CAST(max(first_seen) AS varchar) AS last FROM history""")
def scan_stats(spark, sf_dir):
    return reports.scan_stats(_history(spark, sf_dir)).withColumns({c: F.col(c).cast("string") for c in ("first", "last")})


@query(f"""WITH {_HISTORY}, c AS (SELECT DISTINCT 'p' || CAST(n_nationkey AS varchar) AS portal FROM nation), s AS (SELECT portal, max(CASE WHEN status = 'added' THEN 1 ELSE 0 END) AS producing FROM history GROUP BY portal)
SELECT count(*) AS configured, count(producing) AS active, CAST(coalesce(sum(producing), 0) AS bigint) AS producing, sum(producing) / count(*) * 100 AS producing_pct FROM c LEFT JOIN s USING (portal)""")
def portal_coverage(spark, sf_dir):
    configured = t.read(spark, sf_dir, "nation").select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("portal"))
    return reports.portal_coverage(configured, _history(spark, sf_dir))


_FOLLOW = "follow AS (SELECT user_id AS n FROM events WHERE event_type = 'click')"


@query(f"""{TC}, {_FOLLOW}, per AS (SELECT n, count(*) AS k FROM follow GROUP BY n), a AS (SELECT DISTINCT n FROM canon WHERE stage IN {ACTIVE})
SELECT CAST(coalesce(sum(k), 0) AS bigint) AS total, count(k) AS with_followup, count(*) FILTER (k IS NULL) AS without, round(avg(k), 2) AS average FROM a FULL JOIN per USING (n)""")
def followup_stats(spark, sf_dir):
    applied = t.tracker(spark, sf_dir, roles=False).where(text.canonical_status(F.col("status")).isin(*ACTIVE))
    return reports.followup_stats(applied, t.read(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("user_id").alias("n")))


@query(f"""{TC}, {_FOLLOW} SELECT n FROM canon WHERE stage = 'APPLIED' AND n IN (SELECT n FROM follow GROUP BY n HAVING count(*) >= 12)""")
def cold_applications(spark, sf_dir):
    status = text.canonical_status(F.col("status"))
    active = t.tracker(spark, sf_dir, roles=False).where(status.isin(*ACTIVE)).select("n", (status != "APPLIED").alias("responded"))
    return reports.cold(active, t.read(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("user_id").alias("n")), 12)


@query("""WITH s AS (SELECT o_orderkey AS id, o_orderdate AS day FROM orders WHERE o_orderstatus = 'F' ORDER BY day DESC, id DESC LIMIT 20),
n AS (SELECT l_orderkey AS id, 'Skill ' || CAST(l_partkey % 9 AS varchar) AS requirement, l_returnflag, l_linestatus FROM lineitem),
o AS (SELECT id, lower(trim(requirement)) AS requirement, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS missing FROM n JOIN s USING (id) WHERE l_linestatus IN ('O', 'F') AND l_returnflag IN ('R', 'A') GROUP BY 1, 2)
SELECT requirement, count(*) AS reports, CAST(sum(missing) AS bigint) AS missing FROM o GROUP BY requirement HAVING count(*) >= 2 ORDER BY reports DESC, missing DESC, requirement LIMIT 5""")
def skip_blockers(spark, sf_dir):
    skipped = t.read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("day"))
    needs = t.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.concat(F.lit("Skill "), (F.col("l_partkey") % 9).cast("string")).alias("requirement"),
        F.when(F.col("l_linestatus") == "O", "critical").otherwise("high").alias("importance"), F.expr("CASE l_returnflag WHEN 'R' THEN 'missing' WHEN 'A' THEN 'partial' ELSE 'full' END").alias("match"),
    )
    return reports.skip_blockers(skipped, needs)


@query("""SELECT role AS step, CAST(sum(length(text)) AS bigint) AS input, CAST(sum(CASE WHEN turn > 1 THEN 100 ELSE 0 END) AS bigint) AS cached, CAST(sum(turn) AS bigint) AS output,
round(sum((length(text) - CASE WHEN turn > 1 THEN 100 ELSE 0 END) * 3.0 + CASE WHEN turn > 1 THEN 100 ELSE 0 END * 0.3 + turn * 15.0) / 1e6, 6) AS cost FROM conversations GROUP BY role""")
def token_cost(spark, sf_dir):
    steps = t.read(spark, sf_dir, "conversations").select(
        F.col("role").alias("step"), F.length("text").cast("long").alias("input"), F.when(F.col("turn") > 1, 100).otherwise(0).cast("long").alias("cached"), F.col("turn").alias("output")
    )
    return reports.token_cost(steps, 3.0, 0.3, 15.0)


@query("""SELECT CAST(sum(value) AS double) AS amount, CAST(sum(CASE WHEN event_type = 'nothing' THEN 1 END) AS bigint) AS absent, bool_or(event_type = 'error') AS failed FROM events""")
def scan_merge(spark, sf_dir):
    scans = t.read(spark, sf_dir, "events").select(
        F.col("value").alias("amount"), F.when(F.col("event_type") == "nothing", 1).cast("long").alias("absent"), (F.col("event_type") == "error").alias("failed")
    )
    merged = reports.merged_scans(scans, ["amount", "absent"], ["failed"])
    return merged


_PROFILE = """p AS (SELECT doc_id AS id, trim(text) AS v, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '') AS w,
  greatest(len(list_filter(regexp_split_to_array(trim(text), '[.!?]+(?:\\s+|$)'), lambda s: trim(s) <> '')), 1) AS sentences FROM documents),
q AS (SELECT id, len(w) AS words, sentences, round(len(w) / sentences, 4) AS words_per_sentence, round(len(list_filter(w, lambda x: length(x) >= 7)) / len(w), 4) AS long_share,
  round((length(v) - length(replace(v, ',', ''))) * 100 / len(w), 4) AS commas_per_100 FROM p WHERE len(w) >= 300)"""


@query(f"WITH {_PROFILE} SELECT * FROM q")
def writing_profile(spark, sf_dir):
    return reports.writing_profile(t.read(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""WITH {_PROFILE} SELECT count(*) AS samples, min(words_per_sentence) AS min_words_per_sentence, max(words_per_sentence) AS max_words_per_sentence, min(long_share) AS min_long_share,
max(long_share) AS max_long_share, min(commas_per_100) AS min_commas_per_100, max(commas_per_100) AS max_commas_per_100 FROM q""")
def writing_ranges(spark, sf_dir):
    return reports.profile_ranges(reports.writing_profile(t.read(spark, sf_dir, "documents"), "doc_id", "text"))


@query(f"""{TC} SELECT role_group AS label, count(*) FILTER (stage NOT IN ('EVALUATED', 'SKIP', 'DISCARDED')) AS submitted, count(*) FILTER (stage IN ('REJECTED', 'INTERVIEW', 'OFFER', 'HIRED')) AS decided,
count(*) FILTER (stage IN ('INTERVIEW', 'OFFER', 'HIRED')) AS advanced,
CASE WHEN count(*) FILTER (stage IN ('REJECTED', 'INTERVIEW', 'OFFER', 'HIRED')) >= 5 THEN round(count(*) FILTER (stage IN ('INTERVIEW', 'OFFER', 'HIRED')) / count(*) FILTER (stage IN ('REJECTED', 'INTERVIEW', 'OFFER', 'HIRED')) * 100, 4) END AS rate
FROM (SELECT *, company[-1:] AS role_group FROM canon) GROUP BY 1""")
def advance_rates(spark, sf_dir):
    status = text.canonical_status(F.col("status"))
    rows = t.tracker(spark, sf_dir).select(
        "company", (~status.isin("EVALUATED", "SKIP", "DISCARDED")).alias("submitted"), status.isin("REJECTED", "INTERVIEW", "OFFER", "HIRED").alias("decided"),
        status.isin("INTERVIEW", "OFFER", "HIRED").alias("advanced"),
    )
    return reports.advance_rates(rows, F.substring("company", -1, 1))


@query(f"""{T}, r AS (SELECT n AS id, day, score AS fit FROM tracker) SELECT id, CAST(day AS varchar) AS day, fit FROM r WHERE day > date '2000-06-01' ORDER BY fit DESC NULLS LAST, r.day DESC, id LIMIT 12""")
def whats_new(spark, sf_dir):
    rows = t.tracker(spark, sf_dir, roles=False).select(F.col("n").alias("id"), "day", F.col("score").alias("fit"))
    return reports.whats_new(rows, F.expr("date '2000-06-01'"), 12).select("id", F.col("day").cast("string").alias("day"), "fit")


@query("""WITH w AS (SELECT DISTINCT lower(p_name) AS term FROM (SELECT unnest(string_split(p_name, ' ')) AS p_name FROM part) UNION SELECT 'the'),
f AS (SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}+#]+')) AS term FROM documents) GROUP BY term)
SELECT term, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) >= 2 THEN 'covered' WHEN n = 1 THEN 'thin' ELSE 'missing' END AS state FROM w LEFT JOIN f USING (term)""")
def keyword_coverage(spark, sf_dir):
    terms = t.read(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("term")).union(spark.range(1).select(F.lit("the")))
    return reports.coverage(terms, t.read(spark, sf_dir, "documents"))


@query(f"""{T} SELECT company, date_diff('day', max(day), date '2002-01-01') AS days FROM tracker GROUP BY company ORDER BY days DESC, company LIMIT 10""")
def quiet_companies(spark, sf_dir):
    return reports.quiet(t.tracker(spark, sf_dir, roles=False), F.expr("date '2002-01-01'")).withColumn("days", F.col("days").cast("long"))


@query(f"""{T} SELECT n, CASE WHEN trim(place) = '' THEN true WHEN contains(lower(place), 'falls') THEN false WHEN contains(lower(place), 'paris') THEN true WHEN contains(lower(place), 'lumpur') THEN false
ELSE contains(lower(place), 'wien') OR contains(lower(place), 'remote') END AS passes FROM tracker""")
def location_filter(spark, sf_dir):
    test = filters.location_filter(F.col("place"), F.col("role"), ["wien", "remote"], ["lumpur"], ["paris"], ["falls"])
    return t.tracker(spark, sf_dir).select("n", test.alias("passes"))


@query(f"""{T} SELECT n, pay_source IS NULL OR n % 5 = 0 OR pay >= 150000 AS passes FROM tracker""")
def salary_filter(spark, sf_dir):
    low = F.when(F.col("pay_source").isNotNull(), F.col("pay"))
    currency = F.expr("CASE WHEN n % 5 = 0 THEN 'EUR' ELSE 'usd' END")
    return t.tracker(spark, sf_dir, roles=False).select("n", filters.salary_filter(low, F.lit(None).cast("double"), currency, 150000.0, "USD").alias("passes"))


_KINDS = ("Full-time", "part time", "Internship", "not a contract", "Contractor, full-time", "", "seasonal")
_FOUND = {0: "full-time", 1: "part-time", 2: "internship", 4: "contract", 6: "temporary"}


@query(f"""SELECT o_orderkey AS n, CASE o_orderkey % 7 {" ".join(f"WHEN {k} THEN '{v}'" for k, v in _FOUND.items())} END AS kind FROM orders""")
def employment_types(spark, sf_dir):
    return t.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"), filters.employment_type(F.expr(t._pick(_KINDS, "o_orderkey"))).alias("kind"))


@query(f"""{T} SELECT n, {"CASE " + " ".join(f"WHEN regexp_matches(lower(role), '{p}') THEN '{label}'" for p, label in filters.FACETS) + " END"} AS facet FROM tracker""")
def facet_seniority(spark, sf_dir):
    return t.tracker(spark, sf_dir).select("n", filters.facet_seniority(F.col("role")).alias("facet"))


@query(f"""{T}, w AS (SELECT n, pay, place, list_distinct(list_filter(regexp_split_to_array(lower(role), '[^\\p{{L}}\\p{{N}}+#]+'), lambda x: x <> '')) AS have FROM tracker),
s AS (SELECT *, len(list_intersect(have, ['senior', 'red', 'widget'])) / 3 AS share FROM w)
SELECT n, CAST(least(5, CASE WHEN share >= 1 THEN 3 WHEN share >= 0.6 THEN 2 WHEN share >= 0.34 THEN 1 ELSE 0 END + CASE WHEN place = 'Remote' THEN 1 ELSE 0 END + CASE WHEN place = 'paris' THEN 1 ELSE 0 END
+ CASE WHEN pay >= 200000 THEN 1 ELSE 0 END) AS int) AS fit FROM s""")
def posting_fit(spark, sf_dir):
    score = filters.fit_score(F.col("role"), F.lit("senior red widget"), F.col("place") == "Remote", F.col("place") == "paris", F.col("pay") >= 200000)
    return t.tracker(spark, sf_dir).select("n", score.cast("int").alias("fit"))


@query(f"""{T} SELECT n, CASE WHEN n % 13 = 0 THEN 'Skip' WHEN score IS NULL THEN NULL WHEN n % 3 = 0 AND score >= 4 THEN 'Check first' WHEN score >= 4 THEN 'Apply' WHEN score >= 3 THEN 'Consider' ELSE 'Skip' END AS advice,
CASE WHEN score >= 3.5 THEN 'PASS' WHEN score >= 3 THEN 'MARGINAL' WHEN score IS NOT NULL THEN 'FAIL' END AS triage FROM tracker""")
def recommendations(spark, sf_dir):
    score = F.col("score")
    return t.tracker(spark, sf_dir, roles=False).select("n", filters.recommendation(score, F.col("n") % 13 == 0, F.col("n") % 3 == 0).alias("advice"), filters.triage(score).alias("triage"))


@query("""SELECT page_id, page_id % 3 = 0 AS safe FROM pages""")
def public_urls(spark, sf_dir):
    url = F.expr("CASE page_id % 3 WHEN 1 THEN 'http://127.0.0.1/x' WHEN 2 THEN 'https://u:p@x.org/' ELSE url END")
    return t.read(spark, sf_dir, "pages").select("page_id", filters.public_url(url).alias("safe"))
