"""Queries over markup, privacy, roles and keyed state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup, privacy
from ..operators import roles, state
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


def _html_sql(column: str) -> str:
    out = f"coalesce({column}, '')"
    for pattern, flags in ((r"<!--.*?-->", "gs"), (r"<script\b[^>]*>.*?</script\s*>", "gis"), (r"<style\b[^>]*>.*?</style\s*>", "gis")):
        out = f"regexp_replace({out}, '{pattern}', ' ', '{flags}')"
    for _ in range(2):
        out = f"regexp_replace({out}, '<[^>]*>', ' ', 'g')"
        # The references of these pages; &amp; comes last, so that one pass decodes one level.
        for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&middot;", "·"), ("&amp;", "&")):
            out = "replace({}, '{}', '{}')".format(out, name, char.replace("'", "''"))
    return f"substr(trim(regexp_replace({out}, '\\s+', ' ', 'g')), 1, 4000)"


@query(f"SELECT page_id, {_html_sql('html')} AS text FROM pages")
def html_to_text(spark, sf_dir):
    return t.read(spark, sf_dir, "pages").select("page_id", markup.html_to_text(F.col("html")).alias("text"))


@query(f"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '{privacy.EMAIL}', '[EMAIL]', 'g'), '{privacy.PROFILE}', '[PROFILE]', 'g'), '{privacy.PHONE}', '[PHONE]', 'g') AS text FROM documents""")
def pii_redact(spark, sf_dir):
    return t.read(spark, sf_dir, "documents").select("doc_id", privacy.redacted(F.col("text")).alias("text"))


@query(f"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '{privacy.SECRET}', '[SECRET]', 'g'), '{privacy.KEYED}', '\\1\\2[SECRET]', 'g'), '{privacy.HOME}', '~', 'g') AS text FROM documents""")
def secret_scrub(spark, sf_dir):
    return t.read(spark, sf_dir, "documents").select("doc_id", privacy.scrubbed(F.col("text")).alias("text"))


_ROLE_STOP = "(" + ", ".join(f"'{w}'" for w in roles.ROLE_STOP) + ")"
_SHORT = "(" + ", ".join(f"'{w}'" for w in roles.SHORT) + ")"
_TIER = "CASE " + " ".join(f"WHEN regexp_matches(lower(title), '{p}') THEN '{label}'" for p, label in roles.TIERS) + " ELSE 'mid' END"


@query(f"""WITH {t.TRACKER_SQL}, titles AS (SELECT DISTINCT role AS title FROM tracker),
k AS (SELECT title, {_TIER} AS tier, list_distinct(list_filter(regexp_split_to_array(lower(title), '[^\\p{{L}}\\p{{N}}+#]+'), lambda w: w <> '' AND (length(w) > 3 OR w IN {_SHORT}) AND w NOT IN {_ROLE_STOP})) AS tok FROM titles),
p AS (SELECT a.title AS left_title, b.title AS right_title, a.tier = b.tier AS tier, len(list_intersect(a.tok, b.tok)) AS s, len(list_distinct(a.tok || b.tok)) AS u FROM k a, k b WHERE a.title < b.title)
SELECT left_title, right_title FROM p WHERE lower(trim(left_title)) = lower(trim(right_title)) OR (tier AND (s >= 2 OR (s >= 1 AND s = u)) AND s / greatest(u, 1) >= 0.6)""")
def role_match(spark, sf_dir):
    titles = t.tracker(spark, sf_dir).select(F.col("role").alias("title")).distinct()
    return roles.role_matches(titles, titles).where("left_title < right_title")


@query("""WITH p AS (SELECT 'b' || CAST(user_id AS varchar) AS board, event_id AS seq, event_type IN ('error', 'click') AS missing FROM events),
l AS (SELECT board, max(seq) FILTER (NOT missing) AS alive FROM p GROUP BY board)
SELECT board, least(count(*), 3) AS misses FROM p JOIN l USING (board) WHERE missing AND (alive IS NULL OR seq > alive) GROUP BY board""")
def dead_boards(spark, sf_dir):
    rows = t.read(spark, sf_dir, "events").select(
        F.concat(F.lit("b"), F.col("user_id").cast("string")).alias("board"), F.col("event_id").alias("seq"), F.col("event_type").isin("error", "click").alias("missing")
    )
    return state.dead_boards(rows)


@query(f"""WITH {t.TRACKER_SQL}, r AS (SELECT n, n % 3 AS sent, day + CASE WHEN n % 3 = 0 THEN 7 ELSE 14 END AS due FROM tracker)
SELECT n, CASE WHEN sent >= 2 THEN 'cold' WHEN due < date '1999-01-01' THEN 'overdue' WHEN due = date '1999-01-01' THEN 'urgent' ELSE 'waiting' END AS urgency FROM r""")
def followup_cadence(spark, sf_dir):
    rows = t.tracker(spark, sf_dir, roles=False).select("n", F.col("day").alias("last_contact"), (F.col("n") % 3).alias("sent"))
    return state.cadence(rows, F.expr("date '1999-01-01'")).select("n", "urgency")


@query("""WITH f AS (SELECT user_id AS key, ts AS stamped, value FROM events WHERE ts <= timestamp '2024-01-15 12:00:00' AND ts >= timestamp '2024-01-14 12:00:00')
SELECT key, max_by(value, stamped) AS value FROM f GROUP BY key""")
def fresh_facts(spark, sf_dir):
    facts = t.read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("stamped"), F.col("event_id").alias("seq"), "value")
    return state.fresh_facts(facts, F.expr("timestamp '2024-01-15 12:00:00'"), 86400, seq="seq").select("key", "value")
