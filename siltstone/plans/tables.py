"""The model's tables as projections of the star schema, each with the same projection in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Raw statuses that orders get by key.
RAW_STATUSES = ("Applied", "aplicado", "Respondido", "Screening", "Interview", "Oferta", "Rejected", "Discarded", "SKIP", "Evaluated", "**Hired**", "—", "Geo Blocker")
#: Titles that orders get by key, before the part's name.
TITLES = ("Senior", "Junior", "Lead", "Staff", "Director of", "", "Data", "AI Product Manager", "MLOps", "Support", "Research")
CITIES = ("Wien, AT", "singapore", "Remote", "new york, ny", "münchen", "", "Kuala Lumpur, Malaysia", "Idaho Falls, ID", "req 12", "paris")
#: Stages that events stand for; '-' retracts.
STAGES = {"view": "Applied", "click": "Responded", "signup": "Interview", "purchase": "Offer", "error": "-"}
REASONS = {"view": "salary", "click": "location", "signup": "stale", "purchase": "seniority", "error": "other"}


#: Tables of texts, by the column that spreads their rows.
TEXTS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def spread(rows: DataFrame, key: str, tasks: int = 1) -> DataFrame:
    """Rows of a scan that has fewer splits than `tasks` for each core of the session, dealt over so many; a larger one stays as its files are.

    Tables of short rows, of which a split holds millions, take several tasks a core.
    """
    wanted = rows.sparkSession.sparkContext.defaultParallelism * tasks
    return rows.repartition(wanted, key) if rows.rdd.getNumPartitions() < wanted else rows


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; a table of texts is spread."""
    found = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(found, TEXTS[name]) if name in TEXTS else found


def _pick(values: tuple[str, ...], key: str) -> str:
    """SQL, for both engines, that takes one of a list by a key."""
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {cases} END"


def _case(values: dict[str, str], column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


TRACKER_SQL = f"""
tracker AS (
  SELECT o_orderkey AS n, CAST(o_orderdate AS date) AS day, c_name AS company,
    {_pick(TITLES, "o_orderkey")} || ' ' || coalesce(p_name, 'role') AS role, {_pick(RAW_STATUSES, "o_orderkey")} AS status,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE floor(least(o_totalprice / 100000.0, 5.0) * 10) / 10 END AS score,
    o_totalprice AS pay, CASE o_orderkey % 3 WHEN 0 THEN 'POSTED' WHEN 1 THEN 'est' ELSE NULL END AS pay_source,
    {_pick(CITIES, "o_orderkey")} AS place
  FROM orders JOIN customer ON o_custkey = c_custkey
  LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS partkey FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey
  LEFT JOIN part ON p_partkey = partkey)
"""


def tracker(spark: SparkSession, sf_dir: str, roles: bool = True) -> DataFrame:
    """Applications (n, day, company, role, status, score, pay, pay_source, place) out of orders; without roles, parts and line items are not read."""
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    role = []
    if roles:
        first = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("partkey"))
        parts = read(spark, sf_dir, "part").select("p_partkey", "p_name")
        rows = rows.join(first, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(parts, F.col("p_partkey") == F.col("partkey"), "left")
        role = [F.concat(F.expr(_pick(TITLES, "o_orderkey")), F.lit(" "), F.coalesce("p_name", F.lit("role"))).alias("role")]
    return rows.select(
        F.col("o_orderkey").alias("n"), F.to_date("o_orderdate").alias("day"), F.col("c_name").alias("company"), *role,
        F.expr(_pick(RAW_STATUSES, "o_orderkey")).alias("status"),
        F.when(F.col("o_orderkey") % 17 != 0, F.floor(F.least(F.col("o_totalprice") / 100000.0, F.lit(5.0)) * 10) / 10).alias("score"),
        F.col("o_totalprice").alias("pay"), F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'POSTED' WHEN 1 THEN 'est' END").alias("pay_source"),
        F.expr(_pick(CITIES, "o_orderkey")).alias("place"),
    )


LOG_SQL = f"""
log AS (
  SELECT user_id AS num, CAST(ts AS date) AS date, event_id AS seq, {_case(STAGES, "event_type")} AS target,
    CASE WHEN event_id % 5 = 0 THEN 'Evaluated' ELSE 'Applied' END AS origin, CASE WHEN event_id % 11 = 0 THEN 'correction' ELSE 'web' END AS source
  FROM events)
"""


def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions (num, date, seq, target, origin, source) out of events."""
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("num"), F.to_date("ts").alias("date"), F.col("event_id").alias("seq"), F.expr(_case(STAGES, "event_type")).alias("target"),
        F.expr("CASE WHEN event_id % 5 = 0 THEN 'Evaluated' ELSE 'Applied' END").alias("origin"),
        F.expr("CASE WHEN event_id % 11 = 0 THEN 'correction' ELSE 'web' END").alias("source"),
    )


DISCARD_SQL = f"""
discards AS (
  SELECT ts AS stamp, event_id AS seq, 'https://jobs.example.com/' || CAST(user_id AS varchar) AS url, {_case(REASONS, "event_type")} AS reason FROM events)
"""


def discards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("ts").alias("stamp"), F.col("event_id").alias("seq"), F.concat(F.lit("https://jobs.example.com/"), F.col("user_id").cast("string")).alias("url"),
        F.expr(_case(REASONS, "event_type")).alias("reason"),
    )
