"""Queries over notes of applications, their reports, and what people look for."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import notes
from ..operators import enrichment
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


#: Notes out of an order's price, date, status and priority: a range or an amount, a posting day, a contact, a place.
_LOW, _HIGH = "CAST(CAST(floor(o_totalprice / 5000) AS int) + 1 AS varchar(9))", "CAST(CAST(floor(o_totalprice / 5000) AS int) + 21 AS varchar(9))"
_DAY = lambda n: f"CAST({n} AS varchar(10))"
#: Notes are of this century.
_ON = "add_months(CAST(o_orderdate AS date), 360)"
_NOTES = f"""concat('Raised $', {_HIGH}, 'M series B; ', CASE o_orderstatus WHEN 'P' THEN concat('$', {_LOW}, '-', {_HIGH}, 'K (POSTED)') WHEN 'O' THEN concat({_LOW}, 'K EUR (est)') ELSE '' END,
  '; posted: ', {_DAY(_ON)}, '; ', CASE WHEN o_orderpriority = '1-URGENT' THEN concat('called ', {_DAY(f"date_add({_ON}, 30)")}) ELSE o_orderpriority END, CASE WHEN o_custkey % 3 = 0 THEN '; hybrid in Austin, TX' WHEN o_custkey % 3 = 1 THEN '; remote' ELSE '' END)"""


_REPORT = """concat('**Score:** ', CAST(o_orderkey % 6 AS varchar(1)), '/5', chr(10), 'archetype: ', o_orderpriority, chr(10), CASE WHEN o_orderstatus = 'F' THEN 'hard_stops: [a]' ELSE 'hard_stops: []' END, CASE WHEN o_orderpriority = '5-LOW' THEN concat(chr(10), 'LEGITIMACY: Suspicious') ELSE '' END)"""


@query("""WITH f AS (SELECT o_orderkey AS num, CASE WHEN o_custkey % 3 = 0 THEN 'Austin, TX' ELSE '' END AS place, CASE o_custkey % 3 WHEN 0 THEN 'Hybrid' WHEN 1 THEN 'Remote' ELSE '' END AS mode,
CAST(floor(o_totalprice / 5000) AS int) + 1 AS low, CAST(floor(o_totalprice / 5000) AS int) + 21 AS high, o_orderstatus AS s, o_orderpriority AS p, CAST(CAST(o_orderdate AS date) + INTERVAL 30 YEAR AS date) AS day FROM orders)
SELECT num, place, mode, CASE s WHEN 'P' THEN '$' || low || '-' || high || 'K' WHEN 'O' THEN low || 'K EUR' ELSE '' END AS pay, CAST(CASE s WHEN 'P' THEN high * 1000 WHEN 'O' THEN low * 1000 ELSE 0 END AS double) AS pay_max,
CASE s WHEN 'P' THEN 'POSTED' WHEN 'O' THEN 'est' END AS pay_source, CAST(day AS varchar) AS posted_on, CAST(CASE WHEN p = '1-URGENT' THEN CAST(day + 30 AS date) ELSE day END AS varchar) AS last_contact,
p AS archetype, CAST(num % 6 AS double) AS report_score, s = 'F' AS hard_stop, p = '5-LOW' AS suspicious FROM f""")
def application_enrichment(spark, sf_dir):
    """What every application's notes and report say."""
    orders = t.spread(t.read(spark, sf_dir, "orders"), "o_orderkey", 4)
    apps = orders.select(F.col("o_orderkey").alias("num"), F.lit("Engineer").alias("role"), F.expr(_NOTES).alias("notes"), F.lit("").alias("place"), F.expr(_ON).alias("day"), F.col("o_orderkey").alias("report"))
    reports = orders.select(F.col("o_orderkey").alias("report"), F.expr(_REPORT).alias("text"))
    found = enrichment.enriched(apps, reports)
    return found.select("num", F.col("place"), "mode", "pay", "pay_max", "pay_source", "posted_on", "last_contact", "archetype", "report_score", "hard_stop", "suspicious")


@query("""WITH q AS (SELECT lpad(CAST(n_nationkey + 100 AS varchar), 6, '0') AS query, n_nationkey + 100 AS k, '' AS words FROM nation UNION ALL SELECT p, NULL, p FROM (SELECT DISTINCT p_name AS p FROM part WHERE p_size <= 3)),
r AS (SELECT p_partkey AS num, p_partkey + 7 AS report, p_name AS role, p_brand AS company FROM part)
SELECT query, num, CASE WHEN k IS NULL THEN 'part' WHEN k = num THEN 'row' ELSE 'report' END AS by_what FROM r JOIN q ON k = num OR k = report OR (k IS NULL AND contains(lower(role), lower(words)))""")
def tracker_find(spark, sf_dir):
    """Rows found by number, by report, and by a part of a name, for many queries at once."""
    numbers = t.read(spark, sf_dir, "nation").select(F.lpad((F.col("n_nationkey") + 100).cast("string"), 6, "0").alias("query"))
    part = t.read(spark, sf_dir, "part")
    names = part.where("p_size <= 3").select(F.col("p_name").alias("query")).distinct()
    rows = part.select(F.col("p_partkey").alias("num"), (F.col("p_partkey") + 7).alias("report"), F.col("p_brand").alias("company"), F.col("p_name").alias("role"))
    return enrichment.found(rows, numbers.unionByName(names)).where("by_what != 'role'")


@query("""WITH s AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS x, lower(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '')) AS y FROM conversations),
w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(x, '[^a-z]+'), lambda v: v <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(y, '[^a-z]+'), lambda v: v <> '')) AS b FROM s),
j AS (SELECT conv_id, turn, len(list_intersect(a, b)) / greatest(1, len(a) + len(b) - len(list_intersect(a, b))) AS similarity FROM w)
SELECT conv_id, turn, CASE WHEN similarity >= 0.2 THEN 'reuse' WHEN similarity >= 0.05 THEN 'reuse-with-edits' ELSE 'regenerate' END AS decision FROM j""")
def turn_reuse(spark, sf_dir):
    """Whether a turn could be made of the one before it, by the words that both have."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = t.read(spark, sf_dir, "conversations").select("conv_id", "turn", "text", before.alias("last"))
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^a-z]+"), lambda w: w != ""))
    rows = rows.withColumns({"a": words("text"), "b": words("last")})
    both = F.size(F.array_intersect("a", "b"))
    similarity = both / F.greatest(F.lit(1), F.size("a") + F.size("b") - both)
    return rows.select("conv_id", "turn", notes.reuse_decision(F.col("text"), F.col("last"), similarity, 0.2, 0.05)["decision"].alias("decision"))
