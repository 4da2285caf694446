"""URL filters: temporal list join, in DataFrame functions only.

Dated list entries (add or remove a host, a domain or a URL prefix) become
validity intervals, and an as-of join evaluates every capture against the
entries active at its fetch time.

Cases: a null URL, a URL without a host and a null fetch time match nothing and
are kept; several entries of one key, list and instant are folded into one (a
removal wins); repeated adds keep the first add's interval going; an empty list
keeps every capture; repeated capture rows match each on their own; hosts and
paths of any depth and length are looked up as deep as the list's deepest entry.  Other
columns of the captures do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Entries beyond this many intervals are joined by shuffle over salted keys.
BROADCAST_INTERVALS = 200_000
#: Copies of each interval, and parts of each hot key, in the shuffled join.
SALTS = 16
#: Labels and path segments of the deepest keys of a URL, where no list says how deep its entries are.
MAX_LABELS, MAX_SEGMENTS = 5, 3


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals [valid_from, valid_to) from (list, key, action, effective_at).

    valid_to is null while an entry is active.  Only changes of state open or
    close an interval.
    """
    folded = (
        entries.where("key IS NOT NULL AND effective_at IS NOT NULL AND list IS NOT NULL")
        .groupBy("list", F.lower("key").alias("key"), "effective_at")
        .agg(F.min(F.when(F.col("action") == "remove", 0).otherwise(1)).alias("active"))
    )
    order = Window.partitionBy("list", "key").orderBy("effective_at")
    changes = folded.withColumn("was", F.coalesce(F.lag("active").over(order), F.lit(0))).where("active != was")
    return (
        changes.withColumn("valid_to", F.lead("effective_at").over(order))
        .where("active = 1")
        .select("list", "key", F.col("effective_at").alias("valid_from"), "valid_to")
    )


def url_host(url: Column) -> Column:
    """Lower-case host without user, port or trailing dot; null where there is none."""
    host = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(host), r"\.+$", ""), F.lit(""))


def lookup_keys(url: Column, most_labels: int = MAX_LABELS, most_segments: int = MAX_SEGMENTS) -> Column:
    """The keys under which a URL can be listed: host suffixes of one label or more, and host/path prefixes."""
    host = url_host(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.greatest(n, F.lit(1)), F.lit(max(1, most_labels)))),
        lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), "."),
    )
    path = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^?#]*)", 1)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    prefixes = F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(max(1, most_segments))), lambda k: k <= F.size(segments)),
        lambda k: F.concat(host, F.lit("/"), F.lower(F.array_join(F.slice(segments, 1, k), "/"))),
    )
    return F.when(host.isNotNull(), F.array_distinct(F.concat(suffixes, F.array(host), prefixes)))


def temporal_list_join(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, time_col: str) -> DataFrame:
    """Matches (id, list, key, valid_from, valid_to) of captures with the intervals active at fetch time.

    Intervals of one list and key are disjoint, so a capture matches an interval
    per list and key at most.  A list whose size is checked to be small is
    broadcast; a larger one is joined by key and salt, so no hot host meets in
    one task.
    """
    spans = intervals(entries)
    # Keys go as deep as the deepest entry.
    deepest = entries.agg(F.max(F.size(F.split(F.substring_index("key", "/", 1), r"\."))).alias("labels"), F.max(F.size(F.split("key", "/")) - 1).alias("segments")).first()
    keys = lookup_keys(F.col(url_col), deepest["labels"] or 0, deepest["segments"] or 0)
    probes = captures.select(
        F.col(id_col).alias("id"), F.col(time_col).alias("at"), F.explode(keys).alias("key")
    )
    active = (F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    if entries.limit(BROADCAST_INTERVALS + 1).count() <= BROADCAST_INTERVALS:
        joined = probes.join(F.broadcast(spans), "key").where(active)
    else:
        salted = spans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        probes = probes.withColumn("salt", F.pmod(F.xxhash64("id", "at"), F.lit(SALTS)).cast("int"))
        joined = probes.join(salted, ["key", "salt"]).where(active).drop("salt")
    return joined.select("id", "list", "key", "valid_from", "valid_to")


#: The dated list of the registered query: (list, key, action, day).
LIST_ENTRIES = (
    ("block", "spam-farm.example.org", "add", "2024-01-20"),
    ("block", "spam-farm.example.org", "remove", "2024-06-15"),
    ("block", "spam-farm.example.org", "add", "2024-09-01"),
    ("block", "cheap-pills.example.com", "add", "2024-02-10"),
    ("block", "cheap-pills.example.net", "add", "2024-02-10"),
    ("block", "casino-win.example.net", "add", "2024-03-05"),
    ("block", "casino-win.example.net", "remove", "2024-11-11"),
    ("adult", "adult-x.example.com", "add", "2024-01-01"),
    ("block", "free-bets.example.net", "add", "2024-04-01"),
    ("review", "tionsh.example.net", "add", "2024-05-01"),
    ("review", "tionsh.example.net", "remove", "2024-05-08"),
    ("review", "ththre.example.com/fr", "add", "2024-01-01"),
    ("review", "example.org", "add", "2024-07-01"),
    ("review", "example.org", "remove", "2024-07-03"),
    ("review", "net", "add", "2024-12-24"),
)
#: The captures have no fetch time of their own: page n counts as fetched on day n mod 366 of 2024.
FIRST_DAY, DAYS = "2024-01-01", 366


def _values() -> str:
    return ", ".join(f"('{a}', '{b}', '{c}', date '{d}')" for a, b, c, d in LIST_ENTRIES)


def op3_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the lists it was on when fetched, and whether it is kept (on no blocking list)."""
    entries = spark.sql(f"SELECT * FROM VALUES {_values()} AS t(list, key, action, effective_at)")
    pages = table(spark, sf_dir, "pages").select(
        "page_id",
        "url",
        F.expr(f"date_add(date '{FIRST_DAY}', CAST(pmod(page_id, {DAYS}) AS int))").alias("fetched_on"),
    )
    hits = temporal_list_join(pages, entries, "page_id", "url", "fetched_on")
    by_page = hits.groupBy("id").agg(
        F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"),
        F.array_join(F.array_sort(F.collect_set("key")), ",").alias("matched_keys"),
        F.max(F.col("list").isin("block", "adult").cast("int")).alias("blocked"),
    )
    return pages.join(by_page, pages["page_id"] == by_page["id"], "left").select(
        "page_id",
        F.date_format("fetched_on", "yyyy-MM-dd").alias("fetched_on"),
        F.coalesce("lists", F.lit("")).alias("lists"),
        F.coalesce("matched_keys", F.lit("")).alias("matched_keys"),
        (F.coalesce("blocked", F.lit(0)) == 0).alias("kept"),
    )


OP3_SQL = f"""
WITH entries(list, key, action, effective_at) AS (VALUES {_values()}),
folded AS (SELECT list, lower(key) AS key, effective_at, min(CASE WHEN action = 'remove' THEN 0 ELSE 1 END) AS active
  FROM entries GROUP BY ALL),
states AS (SELECT *, coalesce(lag(active) OVER (PARTITION BY list, key ORDER BY effective_at), 0) AS was FROM folded),
spans AS (SELECT list, key, active, effective_at AS valid_from,
  lead(effective_at) OVER (PARTITION BY list, key ORDER BY effective_at) AS valid_to FROM states WHERE active <> was),
pages_at AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS host,
  lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/+', '/', 'g')) AS path,
  CAST(date '{FIRST_DAY}' + CAST(page_id % {DAYS} AS int) AS date) AS fetched_on FROM pages),
hits AS (SELECT DISTINCT page_id, list, key FROM pages_at p JOIN spans s
  ON s.active = 1 AND fetched_on >= valid_from AND (valid_to IS NULL OR fetched_on < valid_to)
  AND (host = key OR ends_with(host, '.' || key) OR starts_with(host || path || '/', key || '/'))),
by_page AS (SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists,
  string_agg(DISTINCT key, ',' ORDER BY key) AS matched_keys, max(list IN ('block', 'adult')) AS blocked FROM hits GROUP BY page_id)
SELECT p.page_id, strftime(fetched_on, '%Y-%m-%d') AS fetched_on, coalesce(lists, '') AS lists,
  coalesce(matched_keys, '') AS matched_keys, NOT coalesce(blocked, false) AS kept
FROM pages_at p LEFT JOIN by_page b USING (page_id)
"""
