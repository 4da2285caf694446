"""Queries over posting URLs, pay statements and dates: listings are orders with a URL of one of nine hiring systems."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import days, pay, vendors
from ..operators import postings
from ..operators.lineage import settled
from . import tables as t

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


#: URLs that listings get by key; § is the company, N the job.
URLS = (
    "https://boards.greenhouse.io/Acme§/jobs/N?gh_jid=N", "https://job-boards.greenhouse.io/acme§/jobs/N", "https://jobs.lever.co/acme§/N/apply?lever-source=x",
    "https://jobs.ashbyhq.com/Acme§/N", "https://acme§.wd5.myworkdayjobs.com/en-US/Careers/job/Wien/Role_N", "https://careers-acme§.icims.com/jobs/N/job?lang=de",
    "https://www.example.com/Jobs/N?utm_source=a&lang=fr-CA&b=2", "https://jobs.smartrecruiters.com/Acme§/N-role", "ftp://example.com/N", "https://acme§.wd5.myworkdayjobs.com/Careers/job/Wien/Role_N",
)
#: Pay statements that listings get by key; A is a small amount.
PAY = (
    "€80,000 - €95,500 per year", "$8A.5k/yr", "USD 45/hour", "1A.500 EUR monthly", "competitive pay", "£4A0 per day", "salary 80-1A0k GBP annually", "from 1A,000.50 CHF or 12 000 EUR per annum", "",
)
#: Close times and source dates that listings get by key.
CLOSES = ("2024-01-1A", "2024-01-1AT23:30:00-05:00", "2024-01-1AT00:15Z", "2024-01-1A 10:00:00.123+09:30", "2024-02-31", "soon", "2024-01-1AT25:00Z", "2024-01-1AT02:00:00+15:00", "")
DATES = ("2024-03-0B", "2024/03/0B", "B.3.2024", "1B/3/2024", "3/1B/2024", "0B/04/2024", "March B", "")
TODAY = "2024-01-14"


def _pick(values: tuple[str, ...], key: str, changes: dict[str, str]) -> str:
    """SQL, for both engines, that takes one of a list by a key and fills in its letters."""
    out = t._pick(values, key)
    for letter, value in changes.items():
        out = f"replace({out}, '{letter}', CAST({value} AS varchar(20)))"
    return out


_URL = lambda shift: _pick(URLS, f"(o_orderkey + {shift})", {"§": "(o_custkey % 50)", "N": "(o_orderkey % 1000)"})
LISTINGS_SQL = f"""listings AS (SELECT o_orderkey AS n, o_custkey AS company, {_URL(0)} AS url, {_URL("o_orderkey % 3")} AS report_url,
  {_pick(PAY, "o_orderkey", {"A": "(o_orderkey % 10)"})} AS pay, {_pick(CLOSES, "o_orderkey", {"A": "(o_orderkey % 10)"})} AS closes,
  {_pick(DATES, "o_orderkey", {"B": "(o_orderkey % 9 + 1)"})} AS stamp, o_orderstatus AS state, CAST(o_orderdate AS date) AS day, o_orderpriority AS title FROM orders)"""


def listings(spark, sf_dir):
    """(n, company, url, report_url, pay, closes, stamp, state, day, title) out of orders."""
    given = {
        "n": "o_orderkey", "company": "o_custkey", "url": _URL(0), "report_url": _URL("o_orderkey % 3"), "pay": _pick(PAY, "o_orderkey", {"A": "(o_orderkey % 10)"}),
        "closes": _pick(CLOSES, "o_orderkey", {"A": "(o_orderkey % 10)"}), "stamp": _pick(DATES, "o_orderkey", {"B": "(o_orderkey % 9 + 1)"}),
        "state": "o_orderstatus", "day": "CAST(o_orderdate AS date)", "title": "o_orderpriority",
    }
    return t.spread(t.read(spark, sf_dir, "orders"), "o_orderkey", 4).select([F.expr(v).alias(k) for k, v in given.items()])


# The same facts by other means: each system's URLs are taken apart by one pattern each.
def _host(c: str) -> str:
    return f"lower(regexp_extract({c}, '^[A-Za-z]+://([^/?#:]+)', 1))"


def _key(c: str) -> str:
    """The job key of one of the ten spellings."""
    return f"""CASE WHEN {c} LIKE '%greenhouse.io/%' THEN 'greenhouse:' || regexp_extract({c}, '/jobs/([0-9]+)', 1)
  WHEN {c} LIKE 'https://jobs.lever.co/%' THEN lower(regexp_extract({c}, '^(https://jobs.lever.co/[^/]+/[0-9]+)', 1))
  WHEN {c} LIKE '%ashbyhq.com%' THEN lower({c}) WHEN {c} LIKE '%myworkdayjobs.com%' THEN lower(replace({c}, '/en-US/', '/'))
  WHEN {c} LIKE '%icims.com%' THEN string_split({c}, '?')[1] WHEN {c} LIKE '%www.example.com%' THEN lower(string_split({c}, '?')[1]) || '?b=2'
  WHEN {c} LIKE '%smartrecruiters%' THEN 'smartrecruiters:' || lower(regexp_extract({c}, '[.]com/(Acme[0-9]+/[0-9]+)', 1)) ELSE '' END"""


def _language(c: str) -> str:
    return f"CASE WHEN {c} LIKE '%lang=de%' THEN 'de' WHEN {c} LIKE '%lang=fr%' THEN 'fr' WHEN {c} LIKE '%/en-US/%' THEN 'en' ELSE '' END"


_KEYED = f"""WITH {LISTINGS_SQL}, keyed AS (SELECT *, {_key("url")} AS key, {_key("report_url")} AS report_key, {_language("url")} AS language, {_language("report_url")} AS report_language FROM listings)"""
_VENDOR = """CASE WHEN url LIKE 'ftp%' THEN NULL WHEN url LIKE '%greenhouse%' THEN 'greenhouse' WHEN url LIKE '%lever.co%' THEN 'lever' WHEN url LIKE '%ashbyhq%' THEN 'ashby' WHEN url LIKE '%myworkday%' THEN 'workday'
  WHEN url LIKE '%icims%' THEN 'icims' WHEN url LIKE '%smartrec%' THEN 'smartrecruiters' ELSE 'www.example.com' END"""
_BOARDS = f"""boards AS (SELECT *, {_VENDOR} AS vendor, lower(regexp_extract(url, '([Aa]cme[0-9]+)', 1)) AS acme FROM listings),
slugs AS (SELECT *, CASE WHEN vendor = 'workday' THEN acme || '|wd5|careers' WHEN vendor IN ('greenhouse', 'lever', 'ashby', 'icims') THEN acme END AS slug FROM boards),
pages AS (SELECT *, CASE vendor WHEN 'greenhouse' THEN 'https://job-boards.greenhouse.io/' || slug WHEN 'lever' THEN 'https://jobs.lever.co/' || slug WHEN 'ashby' THEN 'https://jobs.ashbyhq.com/' || slug
  WHEN 'icims' THEN 'https://careers-' || slug || '.icims.com/' WHEN 'workday' THEN 'https://' || acme || '.wd5.myworkdayjobs.com/careers' END AS board FROM slugs)"""


@query(f"WITH {LISTINGS_SQL} SELECT {_VENDOR} AS vendor, count(*) AS postings FROM listings GROUP BY 1")
def ats_vendors(spark, sf_dir):
    return listings(spark, sf_dir).groupBy(vendors.ats_vendor(F.col("url")).alias("vendor")).agg(F.count("*").alias("postings"))


@query(f"WITH {LISTINGS_SQL}, {_BOARDS} SELECT n, vendor, slug FROM slugs WHERE slug IS NOT NULL")
def ats_coordinates(spark, sf_dir):
    return listings(spark, sf_dir).select("n", vendors.ats_coordinates(F.col("url")).alias("b")).where("b IS NOT NULL").select("n", "b.vendor", "b.slug")


@query(f"WITH {LISTINGS_SQL}, {_BOARDS} SELECT board, count(*) AS postings, true AS round_trip FROM pages WHERE slug IS NOT NULL GROUP BY board")
def posting_boards(spark, sf_dir):
    """Board pages of postings, and whether a page's own coordinates are those it was made of."""
    rows = listings(spark, sf_dir).select(vendors.ats_coordinates(F.col("url")).alias("b")).where("b IS NOT NULL")
    rows = rows.withColumn("board", vendors.board_url(F.col("b.vendor"), F.col("b.slug")))
    return rows.groupBy("board").agg(F.count("*").alias("postings"), F.every(vendors.ats_coordinates(F.col("board")) == F.col("b")).alias("round_trip"))


@query(f"{_KEYED} SELECT n, key, language FROM keyed")
def job_keys(spark, sf_dir):
    return listings(spark, sf_dir).select("n", vendors.job_key(F.col("url")).alias("key"), vendors.posting_language(F.col("url")).alias("language"))


@query(f"""{_KEYED} SELECT n, CASE WHEN key = '' OR report_key = '' THEN 'no-key' WHEN key <> report_key THEN 'distinct' WHEN language = report_language THEN 'same'
WHEN language <> '' AND report_language <> '' THEN 'distinct' ELSE 'one-sided-language' END AS relation FROM keyed""")
def url_relations(spark, sf_dir):
    return listings(spark, sf_dir).select("n", vendors.url_relation(F.col("url"), F.col("report_url")).alias("relation"))


@query(f"""{_KEYED}, tracked AS (SELECT DISTINCT report_key AS key FROM keyed WHERE state = 'P' AND report_key <> '')
SELECT key, min(n) AS n, arg_min(url, n) AS url FROM keyed WHERE state <> 'P' AND key <> '' AND key NOT IN (SELECT key FROM tracked) GROUP BY key""")
def inbox_pending(spark, sf_dir):
    """Inbox rows (all but the tracked ones) whose job is not tracked under any spelling, one for each job."""
    rows = listings(spark, sf_dir)
    tracked = settled(rows.where("state = 'P'"), vendors.job_key(F.col("report_url")).alias("key"))
    inbox = settled(rows.where("state != 'P'"), vendors.job_key(F.col("url")).alias("key"), "n", "url")
    return postings.pending(inbox, tracked)


@query(f"""{_KEYED}, known AS (SELECT report_key AS key, max(n) AS known FROM keyed WHERE state = 'F' AND report_key <> '' GROUP BY 1),
named AS (SELECT company, title, max(n) AS known FROM keyed WHERE state = 'F' AND report_key = '' GROUP BY 1, 2)
SELECT k.n, coalesce(a.known, b.known) AS evaluated, CASE WHEN a.known IS NOT NULL THEN 'url' WHEN b.known IS NOT NULL THEN 'name' END AS by_what FROM keyed k
LEFT JOIN known a ON a.key = k.key LEFT JOIN named b ON b.company = k.company AND b.title = k.title WHERE k.state = 'O'""")
def evaluated_match(spark, sf_dir):
    keyed = lambda state, url: settled(listings(spark, sf_dir).where(F.col("state") == state), "n", "company", "title", vendors.job_key(F.col(url)).alias("key"))
    return postings.already_evaluated(keyed("O", "url"), keyed("F", "report_url"))


@query(f"""{_KEYED}, u AS (SELECT key, 'history' AS source FROM keyed WHERE state = 'F' UNION ALL SELECT key, 'pipeline' FROM keyed WHERE state = 'O' UNION ALL SELECT report_key, 'tracker' FROM keyed WHERE state = 'P')
SELECT key, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS rows FROM u WHERE key <> '' GROUP BY key""")
def known_postings(spark, sf_dir):
    rows = listings(spark, sf_dir)
    keyed = lambda state, url: settled(rows.where(F.col("state") == state), vendors.job_key(F.col(url)).alias("key"))
    return postings.known({"history": keyed("F", "url"), "pipeline": keyed("O", "url"), "tracker": keyed("P", "report_url")})


@query(f"""WITH {LISTINGS_SQL}, {_BOARDS}, seeds AS (SELECT board, 'tracker' AS source FROM pages WHERE state = 'P' UNION ALL SELECT board, 'history' FROM pages WHERE state <> 'P')
SELECT board, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM seeds WHERE board IS NOT NULL GROUP BY board""")
def board_seeds(spark, sf_dir):
    at = vendors.ats_coordinates(F.col("url"))
    rows = listings(spark, sf_dir).select(vendors.board_url(at["vendor"], at["slug"]).alias("board"), F.when(F.col("state") == "P", "tracker").otherwise("history").alias("source"))
    return rows.where("board IS NOT NULL").groupBy("board").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


_PAY_VALUES = f"""WITH {LISTINGS_SQL}, a AS (SELECT *, CAST(n % 10 AS double) AS a, n % 9 AS k FROM listings),
paid AS (SELECT n, CASE k WHEN 0 THEN 80000.0 WHEN 1 THEN (80 + a + 0.5) * 1000 WHEN 2 THEN 45.0 WHEN 3 THEN (10 + a) * 1000 + 500 WHEN 5 THEN 400 + 10 * a WHEN 6 THEN 80000.0 WHEN 7 THEN (10 + a) * 1000 + 0.5 END AS low,
  CASE k WHEN 0 THEN 95500.0 WHEN 1 THEN (80 + a + 0.5) * 1000 WHEN 2 THEN 45.0 WHEN 3 THEN (10 + a) * 1000 + 500 WHEN 5 THEN 400 + 10 * a WHEN 6 THEN (100 + 10 * a) * 1000 WHEN 7 THEN (10 + a) * 1000 + 0.5 END AS high,
  CASE k WHEN 0 THEN 'EUR' WHEN 2 THEN 'USD' WHEN 3 THEN 'EUR' WHEN 5 THEN 'GBP' WHEN 6 THEN 'GBP' WHEN 7 THEN '' END AS currency,
  CASE k WHEN 0 THEN 'annual' WHEN 1 THEN 'annual' WHEN 2 THEN 'hourly' WHEN 3 THEN 'monthly' WHEN 5 THEN 'daily' WHEN 6 THEN 'annual' WHEN 7 THEN 'annual' END AS period,
  CASE k WHEN 0 THEN 80000.0 WHEN 1 THEN (80 + a + 0.5) * 1000 WHEN 3 THEN (10 + a) * 1000 + 500 WHEN 6 THEN (100 + 10 * a) * 1000 WHEN 7 THEN least((10 + a) * 1000 + 0.5, 12000.0) END AS floor, k <> 4 AND k <> 8 AS states FROM a)"""


@query(f"{_PAY_VALUES} SELECT n, low, high, currency, period, low * CASE period WHEN 'annual' THEN 1 WHEN 'monthly' THEN 12 WHEN 'hourly' THEN 2080 END AS annual_low FROM paid")
def pay_statements(spark, sf_dir):
    """Range, currency and period of every pay statement (the SQL knows what each statement means)."""
    text = F.col("pay")
    rows = listings(spark, sf_dir).select("n", pay.pay_range(text).alias("r"), pay.currency(text).alias("currency"), pay.period(text).alias("period"))
    return rows.select("n", "r.low", "r.high", "currency", "period", pay.annual(F.col("r.low"), F.col("period")).alias("annual_low"))


@query(f"{_PAY_VALUES} SELECT n, floor, states FROM paid")
def pay_floors(spark, sf_dir):
    return listings(spark, sf_dir).select("n", pay.pay_floor(F.col("pay")).alias("floor"), pay.states_pay(F.col("pay")).alias("states"))


_CLOSE_DAYS = f"""WITH {LISTINGS_SQL}, d AS (SELECT *, CASE n % 9 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 0 END AS later FROM listings),
closing AS (SELECT *, CASE WHEN later IS NOT NULL THEN CAST(date '2024-01-10' + CAST(n % 10 AS int) + later AS date) END AS close FROM d)"""


@query(f"{_CLOSE_DAYS} SELECT n, CAST(close AS varchar) AS close, CASE WHEN close < date '{TODAY}' THEN 'overdue' WHEN close <= date '{TODAY}' + 7 THEN 'soon' WHEN close IS NOT NULL THEN 'later' END AS state FROM closing")
def closing_states(spark, sf_dir):
    close = days.close_day(F.col("closes"))
    return listings(spark, sf_dir).select("n", close.cast("string").alias("close"), days.closing_state(close, F.lit(TODAY).cast("date")).alias("state"))


@query(f"""{_CLOSE_DAYS}, keyed AS (SELECT *, {_key("url")} AS key FROM closing WHERE close IS NOT NULL)
SELECT key, CAST(coalesce(arg_max(close, n) FILTER (state = 'P'), arg_max(close, n)) AS varchar) AS close FROM keyed WHERE key <> '' GROUP BY key""")
def close_by_url(spark, sf_dir):
    """The close day of each job: that of a tracked row, which later sightings don't override, else the last seen."""
    rows = settled(listings(spark, sf_dir), vendors.job_key(F.col("url")).alias("key"), days.close_day(F.col("closes")).alias("close"), "n", (F.col("state") == "P").alias("pinned"))
    return postings.close_days(rows.where("key != ''")).withColumn("close", F.col("close").cast("string"))


@query(f"""WITH {LISTINGS_SQL}, d AS (SELECT n, company % 7 AS source, CASE n % 8 WHEN 6 THEN NULL WHEN 7 THEN NULL ELSE 1 END AS has, n % 8 AS k, n % 9 + 1 AS b FROM listings),
habit AS (SELECT source, count(*) FILTER (k = 3) AS days, count(*) FILTER (k = 4 AND b > 2) AS months FROM d GROUP BY source),
h AS (SELECT d.*, days, months, CASE WHEN days > 0 AND months > 0 THEN 'mixed' WHEN days > 0 THEN 'day' WHEN months > 0 THEN 'month' END AS habit FROM d JOIN habit USING (source))
SELECT source, habit, count(*) AS rows, count(*) FILTER (k < 6 AND NOT (habit = 'mixed' AND k IN (3, 4, 5))) AS dated FROM h GROUP BY source, habit""")
def source_dates(spark, sf_dir):
    """Each source's habit of writing dates with slashes, and how many of its dates can be read; slashes of a mixed source are not read."""
    rows = listings(spark, sf_dir).select((F.col("company") % 7).alias("source"), "stamp")
    shown = days.shows_day_first(F.col("stamp"))
    habit = rows.groupBy("source").agg(F.count_if(shown).alias("d"), F.count_if(~shown).alias("m"))
    named = F.when((F.col("d") > 0) & (F.col("m") > 0), "mixed").when(F.col("d") > 0, "day").when(F.col("m") > 0, "month")
    read = rows.join(habit.select("source", named.alias("habit")), "source")
    unread = F.contains("stamp", F.lit("/")) & ~F.col("stamp").rlike("^[0-9]{4}/") & (F.col("habit") == "mixed")
    dated = F.when(~unread, days.source_date(F.col("stamp"), F.col("habit") == "day"))
    return read.groupBy("source", "habit").agg(F.count("*").alias("rows"), F.count(dated).alias("dated"))
