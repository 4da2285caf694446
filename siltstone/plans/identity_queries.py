"""Queries over identities: relations, imports, reconciliation, contacts, stories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values
from ..operators import identity
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


_FORMS = "(" + ", ".join(f"'{w}'" for w in identity.FORMS) + ")"
_UNITS = "(" + ", ".join(f"'{w}'" for w in identity.UNITS) + ")"


def _tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' AND w NOT IN {_FORMS})"


@query(f"""WITH names AS (SELECT p_name AS name FROM part UNION SELECT p_name || ' Inc' FROM part UNION SELECT p_name || ' ' || p_type FROM part UNION SELECT p_type FROM part UNION SELECT p_type || ' Labs' FROM part),
k AS (SELECT name, {_tokens("name")} AS tok FROM names),
p AS (SELECT a.name AS left_name, b.name AS right_name, CASE WHEN len(a.tok) <= len(b.tok) THEN a.tok ELSE b.tok END AS s, CASE WHEN len(a.tok) <= len(b.tok) THEN b.tok ELSE a.tok END AS l, a.tok = b.tok AS eq
  FROM k a JOIN k b ON a.tok[1] = b.tok[1] AND a.name < b.name),
r AS (SELECT left_name, right_name, CASE WHEN len(s) > 0 AND eq THEN 'same' WHEN len(s) > 0 AND l[1 : len(s)] = s AND (len(s) >= 2 OR coalesce(l[len(s) + 1], '') IN {_UNITS}) THEN 'parent' END AS relation FROM p)
SELECT * FROM r WHERE relation IS NOT NULL""")
def company_relations(spark, sf_dir):
    """Related names among all names of parts and of their kinds."""
    part = t.read(spark, sf_dir, "part")
    forms = ("p_name", "concat(p_name, ' Inc')", "concat(p_name, ' ', p_type)", "p_type", "concat(p_type, ' Labs')")
    return identity.company_relations(part.select(F.explode(F.array(*[F.expr(f) for f in forms])).alias("name")))


_IMPORT = """r AS (SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'k' || CAST(event_id % 700 AS varchar) END AS url_key, 'c' || CAST(user_id AS varchar) || ' Inc' AS company, event_type AS role FROM events),
known AS (SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'k' || CAST(user_id AS varchar) END AS url_key, 'c' || CAST(user_id AS varchar) AS company, 'view' AS role FROM events WHERE event_type = 'purchase'),
i AS (SELECT *, replace(company, ' Inc', '') || '|' || role AS identity, CASE WHEN url_key IS NOT NULL THEN 'u:' || url_key ELSE 'i:' || replace(company, ' Inc', '') || '|' || role END AS own FROM r),
f AS (SELECT own, min(seq) AS first FROM i GROUP BY own), n AS (SELECT company || '|' || role AS identity, bool_or(url_key IS NULL) AS bare FROM known GROUP BY 1)"""


@query(f"""WITH {_IMPORT} SELECT seq, CASE WHEN url_key IN (SELECT url_key FROM known WHERE url_key IS NOT NULL) OR (n.identity IS NOT NULL AND (bare OR url_key IS NULL)) THEN 'known'
WHEN seq <> first THEN 'repeated' ELSE 'new' END AS verdict FROM i JOIN f USING (own) LEFT JOIN n USING (identity)""")
def import_plan(spark, sf_dir):
    events = t.read(spark, sf_dir, "events")
    user = F.concat(F.lit("c"), F.col("user_id").cast("string"))
    rows = events.select(
        F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("k"), (F.col("event_id") % 700).cast("string"))).alias("url_key"),
        F.concat(user, F.lit(" Inc")).alias("company"), F.col("event_type").alias("role"),
    )
    known = events.where("event_type = 'purchase'").select(F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("k"), F.col("user_id").cast("string"))).alias("url_key"), user.alias("company"), F.lit("view").alias("role"))
    return identity.import_plan(rows, known.distinct())


@query("""WITH p AS (SELECT DISTINCT 'k' || CAST(l_orderkey % 5000 AS varchar) AS key FROM lineitem),
b AS (SELECT 'k' || CAST(o_orderkey % 4000 AS varchar) AS key, o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'dealbreaker' ELSE 'queued' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'r' END AS report FROM orders),
l AS (SELECT key, max_by(status, id) AS status, max_by(coalesce(report, ''), id) AS report FROM b GROUP BY key), d AS (SELECT DISTINCT 'k' || CAST(c_custkey % 300 AS varchar) AS key FROM customer)
SELECT key, CASE WHEN key IN (SELECT key FROM d) THEN 'already' WHEN status = 'dealbreaker' THEN 'dealbreaker' WHEN status = 'completed' AND report <> '' THEN 'moved' WHEN status = 'completed' THEN 'no-report' ELSE 'keep' END AS bucket
FROM p LEFT JOIN l USING (key)""")
def reconcile_pending(spark, sf_dir):
    key = lambda c, n: F.concat(F.lit("k"), (F.col(c) % n).cast("string")).alias("key")
    batch = t.read(spark, sf_dir, "orders").select(
        key("o_orderkey", 4000), F.col("o_orderkey").alias("id"), F.expr("CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'dealbreaker' ELSE 'queued' END").alias("status"),
        F.when(F.col("o_orderkey") % 2 == 0, "r").alias("report"),
    )
    return identity.reconcile(t.read(spark, sf_dir, "lineitem").select(key("l_orderkey", 5000)), batch, t.read(spark, sf_dir, "customer").select(key("c_custkey", 300)))


@query("""SELECT 'person ' || CAST(user_id % 50 AS varchar) AS name_key, 'acme' AS company_key, count(*) AS rows, max_by(event_type, event_id) FILTER (event_id % 4 <> 0) AS title, max_by('m' || CAST(event_id AS varchar), event_id) AS email
FROM events GROUP BY 1""")
def contact_upsert(spark, sf_dir):
    rows = t.read(spark, sf_dir, "events").select(
        F.concat(F.lit(" Person "), (F.col("user_id") % 50).cast("string")).alias("name"), F.when(F.col("event_id") % 2 == 0, "ACME, Inc.").otherwise("Acme").alias("company"),
        F.when(F.col("event_id") % 4 != 0, F.col("event_type")).otherwise(" ").alias("title"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("email"), F.col("event_id").alias("seq"),
    )
    return identity.upserted_contacts(rows, ("title", "email"))


@query("""WITH s AS (SELECT doc_id AS id, source AS tag, regexp_split_to_array(lower(text[1:60]), '[^\\p{L}\\p{N}+#]+') AS title, regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}+#]+') AS body FROM documents)
SELECT id, CAST(CASE WHEN tag = 'src1' THEN 3 WHEN list_contains(title, 'src1') THEN 2 WHEN list_contains(body, 'src1') THEN 1 ELSE 0 END + CASE WHEN tag = 'the' THEN 3 WHEN list_contains(title, 'the') THEN 2 WHEN list_contains(body, 'the') THEN 1 ELSE 0 END AS int) AS score FROM s""")
def story_match(spark, sf_dir):
    stories = t.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array("source").alias("tags"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("body"))
    return identity.story_scores(stories, ["src1", "the"])


@query("""SELECT o_orderkey AS n, CASE WHEN o_orderkey % 5 < 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS closes FROM orders""")
def closing_dates(spark, sf_dir):
    day = F.col("o_orderdate")
    said = (
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("Apply by "), F.date_format(day, "yyyy-MM-dd"), F.lit(".")))
        .when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit("Deadline: "), F.date_format(day, "d MMMM yyyy")))
        .when(F.col("o_orderkey") % 5 == 2, F.concat(F.lit("Closing date: "), F.date_format(day, "MMMM d, yyyy")))
        .when(F.col("o_orderkey") % 5 == 3, F.concat(F.lit("Closes on "), F.date_format(day, "dd.MM.yyyy"))).otherwise("Deadline: soon, 2026-02-30")
    )
    return t.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"), values.closing_date(said).cast("string").alias("closes"))
