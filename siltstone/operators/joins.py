"""Deduplicating, anti- and as-of joins between postings, history and tracker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row of each key in an order; partial maxima, no window over a key's rows."""
    values = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in values])


def first_per_key(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    values = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in values])


def admission(offers: DataFrame, blacklisted: Column, title_ok: Column, place_ok: Column) -> DataFrame:
    """Each offer's admission reason: seen, blacklisted, title, location or admitted.

    Offers are (url, company, seq, ...).  The gate is stateful: an offer marks its
    URL as seen even if it is rejected, so all but a URL's first offer are seen.
    """
    first = offers.groupBy("url").agg(F.min("seq").alias("first_seq"))
    reason = (
        F.when(F.col("seq") != F.col("first_seq"), "seen").when(blacklisted, "blacklisted").when(~title_ok, "title").when(~place_ok, "location").otherwise("admitted")
    )
    return offers.join(first, "url").withColumn("reason", reason).drop("first_seq")


def discover_new(seen: DataFrame, tracked: DataFrame, board: Column) -> DataFrame:
    """Companies seen but not tracked; one tracked board removes the whole company."""
    boards = tracked.select(board.alias("board")).distinct()
    poisoned = seen.withColumn("board", board).join(boards, "board", "left_semi").select("company").distinct()
    new = seen.join(tracked.select("company").distinct(), "company", "left_anti").join(poisoned, "company", "left_anti")
    return new.groupBy("company").agg(F.count("*").alias("sightings"))


def plan_batch(pending: DataFrame, queued: DataFrame, last_id: int) -> DataFrame:
    """Pending keys that are not queued, distinct, with ids on from last_id in input order (seq)."""
    new = pending.join(queued.select("key"), "key", "left_anti").groupBy("key").agg(F.min("seq").alias("seq"))
    return numbered(new, "seq", last_id)


def numbered(rows: DataFrame, order: str, start: int) -> DataFrame:
    """Dense ids in the order of a numeric column: ranks within ranges of it, shifted by the sizes of earlier ranges.

    The ranges' bounds are approximate quantiles, so no range is a large share
    of the rows, and a row's range depends on its value alone.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(rows.approxQuantile(order, [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    place = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<double>"), lambda b: b < F.col(order).cast("double")))
    dealt = rows.withColumn("part", place)
    inside = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(order)))
    # One number for each range.
    sizes = dict(dealt.groupBy("part").agg(F.count("*").alias("n")).collect())
    before, total = [], start
    for part in range(len(bounds) + 1):
        before.append(total)
        total += sizes.get(part, 0)
    return inside.select(*rows.columns, (F.get(F.array(*[F.lit(n) for n in before]), F.col("part")) + F.col("rank")).cast("long").alias("id"))


def reevaluation_candidates(evaluated: DataFrame, changes: DataFrame) -> DataFrame:
    """Ids whose latest evidence is newer than their evaluation: (id, evaluated, changed)."""
    newest = changes.groupBy("id").agg(F.max("changed").alias("changed"))
    return evaluated.join(newest, "id").where("changed > evaluated").select("id", "evaluated", "changed")


def closing_clash(closings: DataFrame, interviews: DataFrame, least: int = 2) -> DataFrame:
    """Interview days that have `least` closings on the same or the previous day."""
    hits = interviews.select("day").distinct().join(closings, (F.col("closes") == F.col("day")) | (F.col("closes") == F.date_sub("day", 1)))
    return hits.groupBy("day").agg(F.count("*").alias("closings")).where(F.col("closings") >= least)


def same_host(rows: DataFrame, host: Column) -> DataFrame:
    """Per host: rows, distinct keys and companies, from sources of (url key, company, source)."""
    return rows.groupBy(host.alias("host")).agg(
        F.count("*").alias("rows"), F.countDistinct("key").alias("postings"), F.countDistinct("company").alias("companies"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")
    )


def retention(rows: DataFrame, today: Column, keep_days: int, protected: tuple[str, ...]) -> DataFrame:
    """Rows with keep: within the days (the limit included), undated, or of a protected status."""
    age = F.datediff(today, F.col("day"))
    return rows.withColumn("keep", F.col("day").isNull() | (age <= keep_days) | F.col("status").isin(*protected))
