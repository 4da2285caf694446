"""Queries over labels, filters, queues and lookups: cells are made of keys, so that the SQL knows what each of them means."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import captures, labels, matchers
from ..operators import lookups, queues
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


def _cells(key: str, meanings: dict[str, tuple | str | int | None], column: str, *outputs: str) -> tuple[str, list[tuple[str, str]]]:
    """SQL of a cell taken from a list by a key, and of what the cells mean, for each output column."""
    texts = tuple(meanings)
    quoted = lambda v: "NULL" if v is None else f"CAST({v} AS double)" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    means = []
    for i, name in enumerate(outputs):
        values = [m[i] if isinstance(m, tuple) else m for m in meanings.values()]
        means.append((name, f"CASE {key} % {len(texts)} " + " ".join(f"WHEN {k} THEN {quoted(v)}" for k, v in enumerate(values)) + " END"))
    del column
    return t._pick(texts, key), means


def _labelled(name: str, table: str, key: str, meanings: dict, function, *outputs: str, row: str | None = None) -> None:
    """Register a query that labels every row of a table by a cell made of its key."""
    row = row or key
    cell, means = _cells(key, meanings, "cell", *outputs)

    def run(spark, sf_dir):
        found = t.read(spark, sf_dir, table).select(F.expr(row).alias("n"), F.expr(cell).alias("cell")).withColumn("found", function(F.col("cell")))
        if len(outputs) == 1:
            return found.select("n", F.col("found").alias(outputs[0]))
        return found.select("n", *[F.col(f"found.{o}").alias(o) for o in outputs])

    run.__name__, run.__doc__ = name, f"{', '.join(outputs)} of a cell for every row of {table}."
    QUERIES[name] = run
    SQL[name] = f"SELECT {row} AS n, " + ", ".join(f"{sql} AS {o}" for o, sql in means) + f" FROM {table}"


_labelled("outcome_canonical", "orders", "o_orderkey", {
    "Interview": "interview_progress", "offer-received": "offer_received", " hired ": "hired", "ghosted": "no_response", "declined": "offer_declined", "REJECTION": "rejected",
    "interview-only": "interview_only", "maybe": None, "": None,
}, labels.outcome, "outcome")
_labelled("import_stages", "orders", "o_orderkey", {
    "": "APPLIED", "aplicado": "APPLIED", "Bookmarked": "", "phone screen": "RESPONDED", "final round": "INTERVIEW", "Negotiating": "OFFER", "not selected": "REJECTED",
    "withdrawn": "DISCARDED", "something else": None, "**Hired**": "HIRED", "Geo Blocker": "SKIP",
}, labels.import_stage, "stage")
_labelled("contact_types", "orders", "o_orderkey", {
    "I am the hiring manager": "hiring-manager", "the interview panel meets": "interviewer", "Your panelist": "interviewer", "hello": "recruiter", "": "recruiter",
    "the hiring manager and interviewer": "hiring-manager",
}, labels.contact_type, "type")
_labelled("placeholder_cells", "orders", "o_orderkey", {"Acme": 0, "—": 1, " N/A ": 1, "": 1, "None of us": 0, "Confidential": 1}, lambda c: labels.placeholder(c).cast("int"), "placeholder")
_labelled("fit_tones", "orders", "o_orderkey", {
    "**Strong** match": "good", "Gap in years": "bad", "partial": "warn", "Adjacent field": "warn", "strongly": None, "Exceeds": "good", "missing": "bad", "": None, "failing": "bad",
    "ok but this cell goes on for so long that it is no verdict any more": None,
}, labels.fit_tone, "tone")
_labelled("workplace_types", "orders", "o_orderkey", {" Remote ": "remote", "HYBRID": "hybrid", "on-site": "onsite", "onsite": "onsite", "office": None, "": None}, matchers.workplace, "workplace")

def _read_off(name: str, table: str, row: str, cell: str, function, where: str = "true", /, **means: str) -> None:
    """Register a query that labels every row of a table by a cell of its own columns; the SQL of each output says what the columns mean."""
    outputs = list(means)

    def run(spark, sf_dir):
        found = t.read(spark, sf_dir, table).where(where).select(F.expr(row).alias("n"), function(F.expr(cell)).alias("found"))
        if len(outputs) == 1:
            return found.select("n", F.col("found").alias(outputs[0]))
        return found.select("n", *[F.col(f"found.{o}").alias(o) for o in outputs])

    run.__name__, run.__doc__ = name, f"{', '.join(outputs)} of {cell} for every row of {table}."
    QUERIES[name] = run
    SQL[name] = f"SELECT {row} AS n, " + ", ".join(f"{sql} AS {o}" for o, sql in means.items()) + f" FROM {table} WHERE {where}"


_DAY = "CAST(CAST(o_orderdate AS date) AS varchar(10))"
_read_off(
    "rank_stamps", "orders", "o_orderkey", "concat('rank: ', CAST(CAST(floor(o_totalprice / 100000) AS int) AS varchar(9)), ' /5 - ', o_orderpriority)", labels.rank_stamp,
    score="CAST(floor(o_totalprice / 100000) AS double)", reason="trim(o_orderpriority)",
)
_read_off(
    "role_levels", "part", "p_partkey", "concat(p_name, ' Level ', CAST(p_size AS varchar(9)), '/', substr(p_brand, 7))", lambda c: F.array_join(labels.levels(c), ","),
    levels="array_to_string(list_sort(list_distinct(list_filter([p_size, TRY_CAST(substr(p_brand, 7) AS int)], lambda x: x BETWEEN 1 AND 6))), ',')",
)
_read_off(
    "role_acronyms", "documents", "doc_id", "text", lambda c: F.array_join(labels.acronyms(c), ","),
    acronyms=f"""CASE WHEN regexp_matches(coalesce(text, ''), '[\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]') THEN
  array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(text, '[^A-Za-z0-9]+'), lambda w: regexp_full_match(w, '[A-Z]{{2,3}}') AND w NOT IN {labels.NO_ACRONYMS}))), ',') ELSE '' END""",
)
_MAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]*[A-Za-z0-9]"
_read_off(
    "from_headers", "documents", "doc_id", f"concat('\"', source, '\" <', upper(regexp_extract(text, '{_MAIL}', 0)), '>')", labels.from_header, f"text RLIKE '{_MAIL}'",
    name="source", email=f"CASE WHEN contains(regexp_extract(regexp_extract(text, '{_MAIL}'), '@(.*)$', 1), '.') THEN lower(regexp_extract(text, '{_MAIL}')) END",
)
SQL["from_headers"] = SQL["from_headers"].replace(f"WHERE text RLIKE '{_MAIL}'", f"WHERE regexp_matches(text, '{_MAIL}')")
_PLAIN = "translate(lower(split_part(coalesce(text, ''), chr(10), 1)), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"
_read_off(
    "company_slugs", "documents", "doc_id", "split_part(text, chr(10), 1)", labels.slug,
    slug=f"nullif(array_to_string(list_filter(regexp_split_to_array({_PLAIN}, '[^a-z0-9]+'), lambda w: w <> ''), '-'), '')",
)
_read_off(
    "token_values", "documents", "doc_id", "CASE WHEN doc_id % 2 = 0 THEN concat(' ', CAST(CAST(n_chars AS decimal(9,1)) AS varchar(12)), 'K') ELSE concat(CAST(n_chars AS varchar(12)), ' tokens') END", labels.token_value,
    tokens="CASE WHEN doc_id % 2 = 0 THEN n_chars * 1000 ELSE n_chars END",
)
_read_off(
    "posting_hrefs", "pages", "page_id", "CASE WHEN page_id % 2 = 0 THEN concat('see [', html, '](mailto:x) or [', 'job](', url, ')') ELSE concat(' ', url) END", labels.href, "html NOT LIKE '%](http%'",
    href="CASE WHEN regexp_full_match(url, 'https?://[^\\s<>\")]+') THEN url END",
)
_read_off(
    "status_cleanups", "orders", "o_orderkey", f"CASE WHEN o_orderstatus = 'P' THEN concat('Duplicado #', CAST(o_custkey AS varchar(12))) ELSE concat('**Applied** ', {_DAY}, ' (', o_orderpriority, ')') END", labels.status_cleanup,
    status="CASE WHEN o_orderstatus = 'P' THEN 'DISCARDED' ELSE 'APPLIED' END",
    note=f"CASE WHEN o_orderstatus = 'P' THEN 'Duplicado #' || CAST(o_custkey AS varchar) ELSE {_DAY} || ' (' || o_orderpriority || ')' END",
)
_read_off(
    "posting_urls", "pages", "page_id", "CASE WHEN page_id % 5 = 0 THEN replace(url, '://', '://user@') ELSE concat(url, ' ') END", matchers.posting_url,
    url="CASE WHEN page_id % 5 <> 0 AND (starts_with(lower(url), 'http://') OR starts_with(lower(url), 'https://')) AND NOT contains(split_part(split_part(url, '://', 2), '/', 1), '@') THEN trim(url) END",
)
_read_off(
    "coverage_bands", "lineitem", "l_orderkey * 10 + l_linenumber", "l_discount * 1000", labels.coverage_band,
    band="CASE WHEN l_discount * 1000 >= 75 THEN 'strong' WHEN l_discount * 1000 >= 50 THEN 'partial' WHEN l_discount IS NOT NULL THEN 'weak' END",
)


_WORD = lambda w: f"regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_]){w}($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])')"


@query(f"SELECT doc_id FROM documents WHERE {_WORD('was')} OR {_WORD('que')}")
def domain_filter(spark, sf_dir):
    rows = t.read(spark, sf_dir, "documents")
    return rows.where(matchers.domain_filter(F.col("text"), ["was", "word:que"])).select("doc_id")


@query(f"""SELECT doc_id FROM documents WHERE CAST(contains(lower(text), 'tion') AS int) + CAST(contains(lower(text), 'ed') OR {_WORD('que')} AS int) + CAST({_WORD('the')} AS int) >= 2""")
def content_traits(spark, sf_dir):
    rows = t.read(spark, sf_dir, "documents")
    return rows.where(matchers.content_traits(F.col("text"), ["tion", "ed | word:que", "word:the", "TION"], 2)).select("doc_id")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ar') OR contains(lower(p_brand), 'ar') OR contains(lower(p_type), 'ar')")
def row_search(spark, sf_dir):
    return t.read(spark, sf_dir, "part").where(matchers.search(" AR ", *[F.col(c) for c in ("p_name", "p_brand", "p_type")])).select("p_partkey")


@query("""SELECT page_id FROM pages WHERE contains(regexp_replace(lower(url), '[^a-z0-9]+', '', 'g'), 'exampleorg') OR contains('c' || CAST(page_id % 23 AS varchar), 'exampleorg')""")
def company_scope(spark, sf_dir):
    company = F.concat(F.lit("c"), (F.col("page_id") % 23).cast("string"))
    return t.read(spark, sf_dir, "pages").where(matchers.in_company_scope(F.lit("Example.Org"), company, F.col("url"))).select("page_id")


@query("SELECT o_custkey AS board, count(*) AS postings, count(*) <= 5 AS small FROM orders GROUP BY o_custkey")
def small_boards(spark, sf_dir):
    return t.read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("board")).agg(F.count("*").alias("postings"), (F.count("*") <= 5).alias("small"))


@query("""SELECT event_id, sha256('["' || CAST(user_id AS varchar) || '","m' || CAST(event_id AS varchar) || '","' || event_type || '"]') AS receipt FROM events""")
def reply_receipts(spark, sf_dir):
    message = F.concat(F.lit("m"), F.col("event_id").cast("string"))
    return t.read(spark, sf_dir, "events").select("event_id", labels.receipt(F.col("user_id"), message, F.col("event_type")).alias("receipt"))


# ---- queues over evaluated rows: orders with a score, a stored call, a legitimacy and a close day
_ROWS_SQL = """evaluated AS (SELECT o_orderkey AS n, o_custkey AS company, o_orderpriority AS title, CAST(o_orderdate AS date) AS day,
  CASE WHEN o_orderkey % 17 <> 0 THEN floor(least(o_totalprice / 100000.0, 5.0) * 10) / 10 END AS score, CASE WHEN o_orderkey % 3 = 0 THEN 'EVALUATED' ELSE 'APPLIED' END AS stage,
  CASE o_orderkey % 4 WHEN 0 THEN 'Apply' WHEN 1 THEN 'Skip' WHEN 2 THEN 'Consider' ELSE '' END AS decision, CASE o_orderkey % 5 WHEN 0 THEN 'Proceed with caution' WHEN 1 THEN '' ELSE 'high confidence' END AS legitimacy,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(date '1998-01-01' + CAST(o_orderkey % 1000 AS int) AS date) END AS close FROM orders)"""
_FLAG = "regexp_matches(lower(legitimacy), 'caut')"
_LABEL = f"CASE WHEN score IS NULL THEN 'Not scored yet' WHEN score < 4 THEN 'Below the apply line' WHEN {_FLAG} THEN 'Check the posting first' ELSE 'Recommended' END"


def _evaluated(spark, sf_dir):
    return t.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("n"), F.col("o_custkey").alias("company"), F.col("o_orderpriority").alias("title"), F.to_date("o_orderdate").alias("day"),
        F.expr("CASE WHEN o_orderkey % 17 <> 0 THEN floor(least(o_totalprice / 100000.0D, 5.0D) * 10) / 10 END").alias("score"),
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'EVALUATED' ELSE 'APPLIED' END").alias("stage"),
        F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'Apply' WHEN 1 THEN 'Skip' WHEN 2 THEN 'Consider' ELSE '' END").alias("decision"),
        F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'Proceed with caution' WHEN 1 THEN '' ELSE 'high confidence' END").alias("legitimacy"),
        F.expr("CASE WHEN o_orderkey % 2 = 0 THEN date_add(date '1998-01-01', CAST(o_orderkey % 1000 AS int)) END").alias("close"),
    )


@query(f"WITH {_ROWS_SQL} SELECT n, {_LABEL} AS label FROM evaluated")
def apply_labels(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("n", labels.apply_label(F.col("score"), F.col("legitimacy")).alias("label"))


@query(f"""WITH {_ROWS_SQL} SELECT n, CAST(close AS varchar) AS close FROM evaluated WHERE stage = 'EVALUATED' AND decision = 'Apply' AND NOT {_FLAG} AND (close IS NULL OR close >= date '1999-06-01')
ORDER BY score DESC NULLS LAST, day DESC NULLS LAST, n DESC LIMIT 1""")
def apply_next(spark, sf_dir):
    return queues.apply_next(_evaluated(spark, sf_dir), F.lit("1999-06-01").cast("date")).select("n", F.col("close").cast("string").alias("close"))


@query(f"WITH {_ROWS_SQL} SELECT list_position(['Recommended', 'Check the posting first', 'Below the apply line', 'Not scored yet'], {_LABEL}) AS position, {_LABEL} AS label, count(*) AS rows FROM evaluated WHERE stage = 'EVALUATED' GROUP BY ALL")
def awaiting_groups(spark, sf_dir):
    return queues.awaiting_groups(_evaluated(spark, sf_dir))


@query(f"""WITH {_ROWS_SQL} SELECT n, company, row_number() OVER (PARTITION BY company ORDER BY nullif(decision, '') IS NULL, decision, score IS NULL, score DESC, n) AS place FROM evaluated""")
def results_sorted(spark, sf_dir):
    """Places by decision upwards and score downwards, empty ones last, within each company."""
    return queues.placed(_evaluated(spark, sf_dir), "company", [("decision", True), ("score", False)], "n").select("n", "company", "place")


@query(f"WITH {_ROWS_SQL} SELECT n, row_number() OVER (PARTITION BY company ORDER BY close IS NULL, close, score IS NULL, score DESC, n) AS place FROM evaluated WHERE decision <> 'Skip'")
def pending_sorted(spark, sf_dir):
    rows = _evaluated(spark, sf_dir).where("decision != 'Skip'")
    return queues.placed(rows, "company", [("close", True), ("score", False)], "n").select("n", "place")


@query(f"WITH {_ROWS_SQL} SELECT n, company, row_number() OVER (PARTITION BY company ORDER BY score DESC NULLS LAST, n) AS place FROM evaluated")
def tracker_sorted(spark, sf_dir):
    """Places by score, the highest first and none last, equal ones by number, within each company."""
    order = Window.partitionBy("company").orderBy(F.col("score").desc_nulls_last(), "n")
    return _evaluated(spark, sf_dir).select("n", "company", F.row_number().over(order).alias("place"))


@query(f"WITH {_ROWS_SQL} SELECT n, row_number() OVER (ORDER BY nullif(decision, '') IS NULL, decision, score IS NULL, score DESC, n) AS place FROM evaluated")
def results_order(spark, sf_dir):
    """Places among all rows by decision upwards and score downwards, empty ones last."""
    return queues.placed_overall(_evaluated(spark, sf_dir), [("decision", True), ("score", False)], "n").select("n", "place")


@query(f"WITH {_ROWS_SQL} SELECT n, row_number() OVER (ORDER BY close IS NULL, close, score IS NULL, score DESC, n) AS place FROM evaluated WHERE decision <> 'Skip'")
def pending_order(spark, sf_dir):
    """Places among all pending rows by close day, then score."""
    return queues.placed_overall(_evaluated(spark, sf_dir).where("decision != 'Skip'"), [("close", True), ("score", False)], "n").select("n", "place")


@query(f"WITH {_ROWS_SQL} SELECT n, row_number() OVER (ORDER BY score DESC NULLS LAST, n) AS place FROM evaluated")
def tracker_order(spark, sf_dir):
    """Places among all rows by score, the highest first and none last, equal ones by number."""
    return queues.placed_overall(_evaluated(spark, sf_dir), [("score", False)], "n").select("n", "place")


_BAND = "CASE WHEN score >= 4 THEN 'high' WHEN score >= 2 THEN 'medium' WHEN score IS NOT NULL THEN 'low' END"


@query(f"""WITH {_ROWS_SQL}, v AS (SELECT *, {_BAND} AS band FROM evaluated)
SELECT n, band, row_number() OVER (ORDER BY score IS NULL, score DESC, n) AS place FROM v WHERE (contains(lower(title), 'high') OR contains(CAST(company AS varchar), 'high')) AND coalesce(band, '') <> 'low'""")
def results_view(spark, sf_dir):
    """The results that a view shows: a text in title or company, no low band, the best first."""
    rows = _evaluated(spark, sf_dir).withColumn("band", F.expr(_BAND))
    return queues.results_view(rows, " High ", ("low",)).select("n", "band", "place")


_SLUG = "list_filter(regexp_split_to_array(regexp_replace(lower(split_part(coalesce(text, ''), chr(10), 1)), '[^A-Za-z0-9_\\s-]', '', 'g'), '[\\s_]+'), lambda w: w <> '')"
_read_off(
    "capture_slugs", "documents", "doc_id", "split_part(text, chr(10), 1)", captures.capture_slug, "text RLIKE '^[A-Za-z]'",
    slug=f"substr(regexp_replace(array_to_string({_SLUG}, '-'), '^-+|-+$', '', 'g'), 1, {captures.SLUG_BYTES})",
)
SQL["capture_slugs"] = SQL["capture_slugs"].replace("WHERE text RLIKE '^[A-Za-z]'", "WHERE regexp_matches(text, '^[A-Za-z]')")


_KINDS = {"view": "follow-up", "click": "decision", "signup": "match", "purchase": "follow-up", "error": "other"}


@query(f"""WITH i AS (SELECT event_id AS seq, {t._case(_KINDS, "event_type")} AS kind, event_type = 'view' AS due FROM events)
SELECT seq, kind FROM i ORDER BY CASE WHEN kind = 'follow-up' AND due THEN 0 WHEN kind = 'decision' THEN 1 WHEN kind = 'match' THEN 2 WHEN kind = 'follow-up' THEN 3 ELSE 4 END, seq LIMIT 12""")
def today_queue(spark, sf_dir):
    items = t.read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.expr(t._case(_KINDS, "event_type")).alias("kind"), (F.col("event_type") == "view").alias("due"))
    return queues.today_queue(items, 12).select("seq", "kind")


@query("""WITH f AS (SELECT o_orderkey AS n, CASE o_orderkey % 4 WHEN 0 THEN 'urgent' WHEN 1 THEN 'overdue' ELSE 'waiting' END AS urgency, CAST(o_orderdate AS date) AS next FROM orders)
SELECT n, urgency FROM f WHERE urgency IN ('urgent', 'overdue') ORDER BY urgency <> 'urgent', next, n LIMIT 8""")
def followups_due(spark, sf_dir):
    urgency = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'urgent' WHEN 1 THEN 'overdue' ELSE 'waiting' END").alias("urgency")
    rows = t.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"), urgency, F.to_date("o_orderdate").alias("next"))
    return queues.followups_due(rows).select("n", "urgency")


_IMPORTANCE = "CASE l_linenumber % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'high' WHEN 2 THEN 'critical' ELSE 'medium' END"


@query(f"""WITH q AS (SELECT l_orderkey AS grp, 'r' || CAST(l_partkey % 5 AS varchar) AS requirement, {_IMPORTANCE} AS importance, l_linenumber AS seq FROM lineitem),
r AS (SELECT *, CASE importance WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS rank FROM q),
f AS (SELECT *, row_number() OVER (PARTITION BY grp, requirement ORDER BY rank, seq) AS k FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY rank, seq, requirement) AS place FROM f WHERE k = 1)
SELECT grp AS "group", requirement, place FROM p WHERE place <= 6""")
def prep_questions(spark, sf_dir):
    requirement = F.concat(F.lit("r"), (F.col("l_partkey") % 5).cast("string")).alias("requirement")
    rows = t.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group"), requirement, F.expr(_IMPORTANCE).alias("importance"), F.col("l_linenumber").alias("seq"))
    return queues.prep_questions(rows).select("group", "requirement", "place")


@query("""WITH c AS (SELECT doc_id, coalesce(text, '') AS text, array_to_string(string_split(coalesce(text, ''), ' ')[1:30], ' ') AS head, coalesce(lang, '') AS lang FROM documents),
w AS (SELECT *, len(regexp_extract_all(text, '[^ \\t\\r\\n\\f]+')) AS nt, len(regexp_extract_all(head, '[^ \\t\\r\\n\\f]+')) AS nh, len(regexp_extract_all(lang, '[^ \\t\\r\\n\\f]+')) AS nl FROM c)
SELECT doc_id, md5(CASE WHEN nl >= 40 AND (nh < 40 OR nl > nh) THEN lang WHEN nt >= 40 AND (nh < 40 OR nt > nh) THEN text WHEN nh >= nl AND nh >= nt THEN head WHEN nl >= nt THEN lang ELSE text END) AS chosen FROM w""")
def first_acceptable(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    head = F.array_join(F.slice(F.split(text, " "), 1, 30), " ")
    rows = t.read(spark, sf_dir, "documents")
    return rows.select("doc_id", F.md5(queues.first_acceptable(head, [F.coalesce("lang", F.lit("")), text], 40)).alias("chosen"))


@query("""WITH m AS (SELECT n_nationkey AS nation, count(*) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT nation, v, greatest(2, round(100.0 * v / max(v) OVER ())) AS bar FROM m""")
def relative_bars(spark, sf_dir):
    """Bars as a share of the largest, two at least; one row for each nation."""
    counts = t.read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("v"))
    most = counts.agg(F.max("v").alias("most"))
    return counts.crossJoin(F.broadcast(most)).select("nation", "v", F.greatest(F.lit(2.0), F.round(F.lit(100.0) * F.col("v") / F.col("most"))).alias("bar"))


# ---- lookups
@query("""WITH r AS (SELECT 'u' || CAST(o_custkey AS varchar) AS url, max_by(o_totalprice, o_orderkey) AS score FROM orders GROUP BY 1)
SELECT c_custkey AS customer, score FROM customer LEFT JOIN r ON url = 'u' || CAST(c_custkey AS varchar)""")
def score_lookup(spark, sf_dir):
    url = lambda c: F.concat(F.lit("u"), F.col(c).cast("string")).alias("url")
    reports = t.read(spark, sf_dir, "orders").select(url("o_custkey"), F.col("o_orderkey").alias("report"), F.col("o_totalprice").alias("score"))
    history = t.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), url("c_custkey"))
    return lookups.with_scores(history, reports).select("customer", "score")


_PATH = "(CASE WHEN l_linenumber % 3 = 0 THEN 'Cover-' ELSE 'cv-' END) || CAST(l_partkey AS varchar(20)) || '.pdf'"


@query(f"""WITH i AS (SELECT l_orderkey AS report, max({_PATH}) AS path, l_linenumber AS seq FROM lineitem GROUP BY l_orderkey, l_linenumber), f AS (SELECT report, max_by(path, seq) AS path FROM i WHERE NOT contains(lower(path), 'cover') GROUP BY report)
SELECT o_orderkey AS n, path FROM orders LEFT JOIN f ON report = o_orderkey""")
def pdf_paths(spark, sf_dir):
    index = t.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("report"), F.col("l_linenumber").alias("seq")).agg(F.max(F.expr(_PATH)).alias("path"))
    rows = t.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"), F.col("o_orderkey").alias("report"))
    return rows.join(lookups.latest_files(index), "report", "left").select("n", "path")


@query("""WITH c AS (SELECT DISTINCT 'Firm ' || CAST(c_custkey % 40 AS varchar) || CASE WHEN c_custkey % 2 = 0 THEN ' Inc' ELSE '' END AS company FROM customer),
s AS (SELECT s_name AS name, s_suppkey AS seq, 'firm ' || CAST(s_suppkey % 60 AS varchar) || CASE s_suppkey % 3 WHEN 0 THEN ' GmbH' WHEN 1 THEN ', Inc.' ELSE '' END AS company FROM supplier),
k AS (SELECT *, trim(regexp_replace(lower(company), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS exact FROM c), j AS (SELECT *, trim(regexp_replace(lower(company), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS exact FROM s)
SELECT k.company, j.name, CASE WHEN k.exact = j.exact THEN 'exact' ELSE 'form' END AS by_what FROM k JOIN j ON regexp_replace(k.exact, ' (inc|gmbh)$', '') = regexp_replace(j.exact, ' (inc|gmbh)$', '')""")
def contacts_by_company(spark, sf_dir):
    inc = F.when(F.col("c_custkey") % 2 == 0, " Inc").otherwise("")
    companies = t.read(spark, sf_dir, "customer").select(F.concat(F.lit("Firm "), (F.col("c_custkey") % 40).cast("string"), inc).alias("company"))
    form = F.expr("CASE s_suppkey % 3 WHEN 0 THEN ' GmbH' WHEN 1 THEN ', Inc.' ELSE '' END")
    contacts = t.read(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"), F.col("s_suppkey").alias("seq"), F.concat(F.lit("firm "), (F.col("s_suppkey") % 60).cast("string"), form).alias("company")
    )
    return lookups.contacts_of(companies, contacts).select("company", "name", "by_what")


_DUP = """r AS (SELECT o_orderkey AS n, CASE WHEN o_orderkey % 3 = 0 THEN 'k' || CAST(o_orderkey % 97 AS varchar) ELSE '' END AS key, CASE WHEN o_orderkey % 5 = 0 THEN 'q' || CAST(o_orderkey % 11 AS varchar) ELSE '' END AS requisition,
  o_custkey % 90 AS company, CASE o_orderkey % 4 WHEN 0 THEN 'Senior Clerk' WHEN 1 THEN 'clerk' WHEN 2 THEN 'Clerk 2' ELSE 'Pilot' END AS title, CAST(o_orderdate AS date) AS day, o_orderstatus AS state FROM orders),
a AS (SELECT *, lower(title) AS t, CASE WHEN title = 'Pilot' THEN 'pilot' ELSE 'clerk' END AS core FROM r), new AS (SELECT * FROM a WHERE state = 'P'), old AS (SELECT * FROM a WHERE state <> 'P'),
met AS (SELECT new.n, old.n AS known, CASE WHEN new.key <> '' AND new.key = old.key THEN 1 WHEN new.requisition <> '' AND new.requisition = old.requisition AND new.company = old.company THEN 1 WHEN new.t = old.t THEN 2 ELSE 3 END AS tier,
  CASE WHEN new.key <> '' AND new.key = old.key THEN 'url' WHEN new.requisition <> '' AND new.requisition = old.requisition AND new.company = old.company THEN 'req' WHEN new.t = old.t THEN 'same-title' ELSE 'similar-title' END AS reason, old.day
  FROM new JOIN old ON (new.key <> '' AND new.key = old.key) OR (new.company = old.company AND new.core = old.core) OR (new.company = old.company AND new.requisition <> '' AND new.requisition = old.requisition))"""


@query(f"WITH {_DUP} SELECT n, known, tier, reason FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY tier, day DESC, known DESC, reason = 'url' DESC) AS k FROM met) WHERE k = 1")
def duplicate_precheck(spark, sf_dir):
    """New rows (state P) against all others."""
    rows = t.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("n"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN concat('k', o_orderkey % 97) ELSE '' END").alias("key"),
        F.expr("CASE WHEN o_orderkey % 5 = 0 THEN concat('q', o_orderkey % 11) ELSE '' END").alias("requisition"), F.expr("concat('Firm ', o_custkey % 90, ' Ltd')").alias("company"),
        F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'Senior Clerk' WHEN 1 THEN 'clerk' WHEN 2 THEN 'Clerk 2' ELSE 'Pilot' END").alias("title"), F.to_date("o_orderdate").alias("day"), "o_orderstatus",
    )
    return lookups.duplicates(rows.where("o_orderstatus = 'P'"), rows.where("o_orderstatus != 'P'"))


@query("""WITH f AS (SELECT DISTINCT regexp_extract(props, '([0-9]+)', 1) AS id FROM events WHERE regexp_matches(props, '[0-9]')), s AS (SELECT DISTINCT CAST(user_id AS varchar) AS id FROM events)
SELECT id, CASE WHEN id IN (SELECT id FROM s) THEN 'seen' ELSE 'added' END AS verdict FROM f""")
def import_split(spark, sf_dir):
    """Numbers found in texts, split by whether an id of theirs is known."""
    events = t.read(spark, sf_dir, "events")
    found = events.select(F.regexp_extract("props", "([0-9]+)", 1).alias("id")).where("id != ''")
    return lookups.split_imported(found, events.select(F.col("user_id").cast("string").alias("id")))


@query(f"""WITH {t.TRACKER_SQL}, c AS (SELECT company, count(*) AS n, count(*) FILTER (status IN ('Respondido', 'Screening', 'Interview', 'Oferta', 'Rejected', '**Hired**')) AS answered,
  count(*) FILTER (status IN ('Applied', 'aplicado')) AS silent FROM tracker GROUP BY company)
SELECT company, CASE WHEN answered > 0 AND silent > 0 THEN 'mixed' WHEN answered > 0 THEN 'responded-before' WHEN silent > 0 THEN 'silent' ELSE 'no-history' END AS verdict FROM c""")
def company_cards(spark, sf_dir):
    from ..functions.text import canonical_status

    stage = canonical_status(F.col("status"))
    answered = F.count_if(stage.isin("RESPONDED", "ASSESSMENT", "INTERVIEW", "OFFER", "REJECTED", "HIRED"))
    silent = F.count_if(stage == "APPLIED")
    verdict = F.when((answered > 0) & (silent > 0), "mixed").when(answered > 0, "responded-before").when(silent > 0, "silent").otherwise("no-history")
    return t.tracker(spark, sf_dir, roles=False).groupBy("company").agg(verdict.alias("verdict"))


@query(f"""WITH {t.TRACKER_SQL}, a AS (SELECT split_part(role, ' ', 1) AS archetype, count(score) AS n, avg(score) AS mean FROM tracker WHERE split_part(role, ' ', 1) <> '' GROUP BY 1 HAVING count(score) >= 3)
SELECT archetype || ' leads with ' || printf('%.2f', mean) || ' over ' || CAST(n AS varchar) AS insight FROM a ORDER BY mean DESC, archetype LIMIT 1""")
def best_archetype(spark, sf_dir):
    """The archetype (first word of a title) of the highest mean score, of those with three scores or more, as a sentence."""
    first = F.split("role", " ")[0]
    rows = t.tracker(spark, sf_dir).where(first != "").groupBy(first.alias("archetype")).agg(F.count("score").alias("n"), F.avg("score").alias("mean")).where("n >= 3")
    text = F.format_string("%s leads with %.2f over %d", "archetype", "mean", "n")
    return rows.orderBy(F.desc("mean"), "archetype").limit(1).select(text.alias("insight"))
