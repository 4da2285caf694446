"""Queries over employers, registry folds and dates as they were known."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, employers
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


#: Suppliers' names written as a customer's: in capitals, with a legal form, with a letter missing, with more words, unknown.
_WRITTEN = """CASE s_suppkey % 5 WHEN 0 THEN upper(replace(s_name, 'Supplier', 'The Customer')) WHEN 1 THEN concat(replace(s_name, 'Supplier#', 'Customer '), ' Corporation')
WHEN 2 THEN replace(s_name, 'Supplier', 'Custmer') WHEN 3 THEN concat(replace(s_name, 'Supplier', 'Customer'), ' Unit 7') ELSE concat('Unknown ', s_name) END"""
_REGISTERED = """SELECT o_custkey AS key, count(*) AS evidence FROM orders GROUP BY o_custkey"""
_BARE = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"


def _words(c: str) -> str:
    plain = f"list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
    return f"list_transform(CASE WHEN ({plain})[1] = 'the' THEN ({plain})[2:] ELSE {plain} END, lambda w, i: w)"


@query(f"""WITH q AS (SELECT s_suppkey AS id, {_WRITTEN} AS name FROM suppliers_ ), ev AS ({_REGISTERED}),
reg AS (SELECT c_custkey AS key, c_name AS match, coalesce(evidence, 0) AS evidence FROM customer LEFT JOIN ev ON key = c_custkey
  UNION ALL SELECT c_custkey + 1000000000, c_name || ' Corp', 1 FROM customer WHERE c_custkey % 3 = 0),
qq AS (SELECT id, {_BARE.format("name")} AS own, regexp_replace(array_to_string({_words("name")}, ' '), ' corporation$', ' corp') AS words FROM q),
rr AS (SELECT *, {_BARE.format("match")} AS bare, array_to_string({_words("match")}, ' ') AS words FROM reg),
met AS (SELECT id, key, match, evidence, CASE WHEN own = bare THEN 3 WHEN starts_with(qq.words || ' ', rr.words || ' ') OR starts_with(rr.words || ' ', qq.words || ' ') THEN 2
  WHEN length(own) BETWEEN 6 AND 40 AND length(bare) BETWEEN 6 AND 40 AND abs(length(own) - length(bare)) <= 1 AND levenshtein(own, bare) = 1 THEN 1 ELSE 0 END AS strength FROM qq, rr),
top AS (SELECT *, rank() OVER (PARTITION BY id ORDER BY strength DESC, evidence DESC) AS place FROM met WHERE strength > 0),
one AS (SELECT id, count(*) AS n, min(key) AS key, min(match) AS match, min(strength) AS strength FROM top WHERE place = 1 GROUP BY id)
SELECT q.id, CASE WHEN n = 1 THEN key END AS key, CASE WHEN n = 1 THEN match END AS match,
CASE WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'ambiguous' ELSE ['misspelt', 'plausible', 'exact'][strength] END AS reason FROM q LEFT JOIN one USING (id)""".replace("suppliers_ ", "supplier"))
def employer_matches(spark, sf_dir):
    """The registered customer that each supplier's written name means."""
    customers = t.read(spark, sf_dir, "customer")
    evidence = t.read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("evidence"))
    plain = customers.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")).join(evidence, "key", "left")
    corps = customers.where("c_custkey % 3 = 0").select((F.col("c_custkey") + 1000000000).alias("key"), F.concat("c_name", F.lit(" Corp")).alias("name"), F.lit(1).cast("long").alias("evidence"))
    names = t.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.expr(_WRITTEN).alias("name"))
    return employers.resolve_employers(names, plain.unionByName(corps))


_CONTRIBUTED = """rows AS (SELECT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]+/([^/?#]*)', 1) AS board, url,
  'c' || lpad(CAST(page_id % 37 AS varchar), 2, '0') AS contribution, page_id AS seq, page_id % 37 < 11 AS registered FROM pages WHERE url IS NOT NULL)"""


def _contributed(spark, sf_dir):
    pages = t.read(spark, sf_dir, "pages").where("url IS NOT NULL")
    rows = pages.select(
        F.lower(F.regexp_extract("url", "^[A-Za-z]+://([^/?#:]+)", 1)).alias("host"), F.regexp_extract("url", "^[A-Za-z]+://[^/?#]+/([^/?#]*)", 1).alias("board"), "url",
        F.concat(F.lit("c"), F.lpad((F.col("page_id") % 37).cast("string"), 2, "0")).alias("contribution"), F.col("page_id").alias("seq"), (F.col("page_id") % 37 < 11).alias("registered"),
    )
    return rows.where("registered").drop("registered"), rows.where("NOT registered").drop("registered")


@query(f"""WITH {_CONTRIBUTED} SELECT host, board, min_by(url, contribution || lpad(CAST(seq AS varchar), 19, '0')) AS url, min(contribution) AS contribution,
min_by(seq, contribution || lpad(CAST(seq AS varchar), 19, '0')) AS seq FROM rows GROUP BY host, board""")
def identity_fold(spark, sf_dir):
    """The registry of boards after an inbox of contributions was folded in."""
    registry, inbox = _contributed(spark, sf_dir)
    return employers.fold_identities(registry, inbox, ("host", "board"))


@query(f"""WITH {_CONTRIBUTED}, f AS (SELECT *, row_number() OVER (PARTITION BY host, board ORDER BY contribution, seq) AS nth FROM rows WHERE NOT registered),
k AS (SELECT DISTINCT host AS h, board AS b FROM rows WHERE registered)
SELECT contribution, count(*) FILTER (h IS NULL AND nth = 1) AS added, count(*) FILTER (h IS NOT NULL OR nth > 1) AS skipped FROM f LEFT JOIN k ON h = host AND b = board GROUP BY contribution""")
def identity_fold_report(spark, sf_dir):
    registry, inbox = _contributed(spark, sf_dir)
    return employers.fold_report(registry, inbox, ("host", "board"))


_SOURCES = ("ordered", "shipped-A", "shipped-N", "shipped-R")


@query("""WITH r AS (SELECT o_orderkey AS n, o_custkey AS customer, CAST(o_orderdate AS date) AS evaluated, CAST(o_orderdate AS date) + 120 AS day FROM orders),
c AS (SELECT o_custkey AS customer, 'ordered' AS source, CAST(o_orderdate AS date) AS day FROM orders UNION ALL SELECT o_custkey, 'shipped-' || l_returnflag, CAST(l_shipdate AS date) FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
k AS (SELECT n, evaluated, source, max(c.day) AS changed FROM r JOIN c ON c.customer = r.customer AND c.day <= r.day GROUP BY n, evaluated, source)
SELECT n, evaluated, max(changed) AS latest, string_agg(source || '@' || CAST(changed AS varchar), ' ' ORDER BY changed DESC, source) AS changed_since FROM k WHERE changed > evaluated GROUP BY n, evaluated""")
def reevaluation_candidates(spark, sf_dir):
    """Orders of which the customer's dates, as known 120 days later, have changed since."""
    orders = t.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"), F.col("o_custkey").alias("customer"), F.to_date("o_orderdate").alias("evaluated"))
    shipped = t.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("n"), F.concat(F.lit("shipped-"), "l_returnflag").alias("source"), F.to_date("l_shipdate").alias("day"))
    changes = orders.select("customer", F.lit("ordered").alias("source"), F.col("evaluated").alias("day")).unionByName(shipped.join(orders, "n").select("customer", "source", "day"))
    rows = orders.withColumn("day", F.date_add("evaluated", 120))
    found = asof.reevaluation_candidates(rows, changes, "customer", "day", "evaluated", _SOURCES)
    listed = F.array_join(F.transform("changed_since", lambda x: F.concat_ws("@", x["source"], x["changed"].cast("string"))), " ")
    return found.select("n", "evaluated", "latest", listed.alias("changed_since"))
