"""Keyed state as batch folds: dead boards, cadence, TTL facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dead_boards(probes: DataFrame, cap: int = 3) -> DataFrame:
    """(board, misses) after probes (board, seq, missing): misses in a row since the last success, capped; boards without misses are gone."""
    alive = F.max(F.when(~F.col("missing"), F.col("seq")))
    last = probes.groupBy("board").agg(alive.alias("alive"))
    since = probes.where("missing").join(last, "board").where("alive IS NULL OR seq > alive")
    return since.groupBy("board").agg(F.least(F.count("*"), F.lit(cap)).alias("misses"))


def cadence(rows: DataFrame, today: Column, first: int = 7, again: int = 14, most: int = 2) -> DataFrame:
    """Urgency of follow-ups for (n, last_contact, sent): cold after `most`, else overdue, urgent on the day, or waiting."""
    due = F.date_add("last_contact", F.when(F.col("sent") == 0, first).otherwise(again))
    urgency = F.when(F.col("sent") >= most, "cold").when(due < today, "overdue").when(due == today, "urgent").otherwise("waiting")
    return rows.withColumn("due", due).withColumn("urgency", urgency)


def fresh_facts(facts: DataFrame, now: Column, ttl_seconds: int, floor: Column | None = None, seq: str | None = None) -> DataFrame:
    """Facts (key, stamped, ...) that still hold: the latest of each key, not from the future, within their time and not before the invalidation floor.

    Of several with one time, the first by `seq` counts where that is given.
    """
    # Whole seconds would let in a fact of the second that has just begun.
    age = F.unix_micros(now) - F.unix_micros(F.col("stamped"))
    held = facts.where((age >= 0) & (age <= ttl_seconds * 1_000_000) & (F.lit(True) if floor is None else F.col("stamped") >= floor))
    values = [c for c in facts.columns if c != "key"]
    latest = F.col("stamped") if seq is None else F.struct("stamped", (-F.col(seq)).alias("seq"))
    return held.groupBy("key").agg(F.max_by(F.struct(*values), latest).alias("r")).select("key", *[F.col(f"r.{c}").alias(c) for c in values])
