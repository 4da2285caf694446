"""The append-only transition ledger: corrections, retractions, stage recovery and velocity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_status, stage_rank

_FOLD = """
aggregate(
  entries,
  named_struct('seen', cast(array() as array<struct<date:date,origin:string,target:string>>), 'void', cast(null as string)),
  (acc, e) -> CASE
    WHEN e.target = '-' THEN named_struct(
      'seen', CASE WHEN size(acc.seen) > 0 THEN slice(acc.seen, 1, size(acc.seen) - 1) ELSE acc.seen END,
      'void', CASE WHEN size(acc.seen) > 0 THEN element_at(acc.seen, -1).target ELSE acc.void END)
    WHEN e.source = 'correction' AND exists(acc.seen, s -> s.target = e.target) THEN named_struct(
      'seen', transform(acc.seen, (s, i) -> CASE
        WHEN i = size(acc.seen) - array_position(transform(reverse(acc.seen), r -> r.target), e.target)
        THEN named_struct('date', e.date, 'origin', CASE WHEN upper(e.origin) = upper(acc.void) THEN '-' ELSE e.origin END, 'target', e.target)
        ELSE s END),
      'void', cast(null as string))
    ELSE named_struct(
      'seen', array_append(acc.seen, named_struct('date', e.date, 'origin', CASE WHEN upper(e.origin) = upper(acc.void) THEN '-' ELSE e.origin END, 'target', e.target)),
      'void', cast(null as string))
  END,
  acc -> acc.seen)
"""


def fold(log: DataFrame) -> DataFrame:
    """Surviving observations (num, position, date, origin, target) of (num, date, origin, target, source, seq).

    In order of seq: '-' retracts the latest observation, and the stage that it
    retracted proves nothing as the next origin; a correction replaces the latest
    observation of its own stage.  Rows without number, date, origin or target
    are torn and ignored.  An id's entries are one person's history and stay
    together as one array.
    """
    whole = log.where("num IS NOT NULL AND date IS NOT NULL AND origin != '' AND target != ''")
    entry = F.struct("seq", "date", "origin", "target", "source")
    folded = whole.groupBy("num").agg(F.array_sort(F.collect_list(entry)).alias("entries")).select("num", F.expr(_FOLD).alias("seen"))
    return folded.select("num", F.posexplode("seen").alias("position", "s")).select("num", "position", "s.date", "s.origin", "s.target")


def latest(folded: DataFrame) -> DataFrame:
    """The latest surviving date of each id."""
    return folded.groupBy("num").agg(F.max("date").alias("latest"))


def recovered_stages(tracker: DataFrame, folded: DataFrame) -> DataFrame:
    """(n, rank): the highest stage each tracked id ever reached; rows now SKIP stay out, ids not tracked are ignored."""
    status = canonical_status(F.col("status"))
    now = tracker.where(status != "SKIP").select("n", stage_rank(status).alias("rank"))
    past = folded.select(F.col("num").alias("n"), F.greatest(stage_rank(canonical_status(F.col("origin"))), stage_rank(canonical_status(F.col("target")))).alias("past"))
    past = past.groupBy("n").agg(F.max("past").alias("past"))
    return now.groupBy("n").agg(F.max("rank").alias("rank")).join(past, "n", "left").select("n", F.greatest("rank", F.coalesce("past", F.lit(0))).alias("rank"))


def stage_tiles(recovered: DataFrame) -> DataFrame:
    """One row: ids that reached applied, responded, interview and offer."""
    return recovered.agg(*[F.sum((F.col("rank") >= r).cast("long")).alias(k) for k, r in (("applied", 1), ("responded", 2), ("interview", 4), ("offer", 5))])


def velocity(folded: DataFrame, outcome: str) -> DataFrame:
    """One row: median days from each APPLIED to the next `outcome` of its episode, episodes with it, and episodes without (censored)."""
    target = canonical_status(F.col("target"))
    rows = folded.select("num", "position", "date", target.alias("stage"))
    episodes = rows.where("stage = 'APPLIED'").select("num", F.col("position").alias("from_position"), F.col("date").alias("applied"))
    ends = episodes.groupBy("num").agg(F.array_sort(F.collect_list("from_position")).alias("starts"))
    spans = episodes.join(ends, "num").withColumn("next", F.get(F.filter("starts", lambda p: p > F.col("from_position")), F.lit(0)))
    hits = rows.where(F.col("stage") == outcome).select("num", F.col("position").alias("at"), F.col("date").alias("answered"))
    inside = (hits["at"] > spans["from_position"]) & (F.col("next").isNull() | (hits["at"] < F.col("next")))
    joined = spans.join(hits, (spans["num"] == hits["num"]) & inside, "left")
    first = joined.groupBy(spans["num"], "from_position", "applied").agg(F.min("answered").alias("answered"))
    days = F.datediff("answered", "applied")
    return first.agg(F.median(days).alias("median_days"), F.count("answered").alias("n"), F.sum(F.col("answered").isNull().cast("long")).alias("censored"))
