"""Postings under one key each: pending, evaluated, known, closing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(inbox: DataFrame, tracked: DataFrame) -> DataFrame:
    """(key, n, url): inbox rows (key, n, url) whose key is not tracked, the first of each key; rows without a key are not pending."""
    firsts = inbox.where("key != ''").groupBy("key").agg(F.min("n").alias("n"), F.min_by("url", "n").alias("url"))
    return firsts.join(tracked.select("key").distinct(), "key", "left_anti")


def already_evaluated(rows: DataFrame, done: DataFrame) -> DataFrame:
    """(n, evaluated, by_what): the last evaluated row (n, company, title, key) of the same key, else, among those without a key, of the same name."""
    by_url = done.where("key != ''").groupBy("key").agg(F.max("n").alias("by_url"))
    by_name = done.where("key = ''").groupBy("company", "title").agg(F.max("n").alias("by_name"))
    met = rows.join(by_url, "key", "left").join(by_name, ["company", "title"], "left")
    how = F.when(F.col("by_url").isNotNull(), "url").when(F.col("by_name").isNotNull(), "name")
    return met.select("n", F.coalesce("by_url", "by_name").alias("evaluated"), how.alias("by_what"))


def known(sources: dict[str, DataFrame]) -> DataFrame:
    """(key, sources, rows) of all sources' rows (key)."""
    tagged = [df.select("key", F.lit(name).alias("source")) for name, df in sources.items()]
    both = reduce(DataFrame.unionByName, tagged).where("key != ''")
    return both.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count("*").alias("rows"))


def close_days(rows: DataFrame) -> DataFrame:
    """(key, close) of sightings (key, close, n, pinned): the last pinned day, else the last."""
    seen = rows.where("close IS NOT NULL")
    return seen.groupBy("key").agg(F.max_by("close", F.struct("pinned", "n")).alias("close"))
