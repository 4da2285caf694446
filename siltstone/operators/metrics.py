"""Funnels, histograms, breakdowns and coverage over a tracker of applications."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_status
from ..functions.values import iso_week, percentage, rate_or_null

#: Stages and the statuses that have reached them; Rejected counts as answered.
FUNNEL = {
    "Applied": ("APPLIED", "RESPONDED", "ASSESSMENT", "INTERVIEW", "OFFER", "HIRED", "REJECTED"),
    "Responded": ("RESPONDED", "ASSESSMENT", "INTERVIEW", "OFFER", "HIRED", "REJECTED"),
    "Interview": ("INTERVIEW", "OFFER", "HIRED"),
    "Offer": ("OFFER", "HIRED"),
}
ACTIVE = ("APPLIED", "RESPONDED", "ASSESSMENT", "INTERVIEW", "OFFER")
SCORE_BUCKETS = ((4.5, 5.1, "4.5-5.0"), (4.0, 4.5, "4.0-4.4"), (3.5, 4.0, "3.5-3.9"), (3.0, 3.5, "3.0-3.4"), (0.0, 3.0, "<3.0"))
QUALITY = ((4.5, "Elite (>=4.5)"), (4.0, "Strong (4.0-4.4)"), (3.5, "Viable (3.5-3.9)"), (3.0, "Moderate (3.0-3.4)"), (0.0, "Below Bar (<3.0)"))
PAY_BANDS = ((100000, "< $100K"), (140000, "$100K - $140K"), (180000, "$140K - $180K"), (220000, "$180K - $220K"))


def count_if(test: Column) -> Column:
    return F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).cast("long")


def _unpivot(one: DataFrame, rows: list[tuple]) -> DataFrame:
    """Rows (position, label, count, base) out of one row of totals."""
    made = [F.struct(F.lit(i).alias("position"), F.lit(label).alias("label"), F.col(n).alias("count"), F.col(base).alias("base")) for i, (label, n, base) in enumerate(rows)]
    return one.select(F.explode(F.array(*made)).alias("r")).select("r.*")


def funnel(tracker: DataFrame) -> DataFrame:
    """Cumulative funnel (position, label, count, pct): the first two stages over all rows, later ones over the applied."""
    status = canonical_status(F.col("status"))
    totals = tracker.agg(F.count("*").alias("Tracked"), *[count_if(status.isin(*s)).alias(k) for k, s in FUNNEL.items()])
    rows = [("Tracked", "Tracked", "Tracked"), ("Applied", "Applied", "Tracked"), *[(k, k, "Applied") for k in ("Responded", "Interview", "Offer")]]
    return _unpivot(totals, rows).select("position", "label", "count", percentage(F.col("count"), F.col("base")).alias("pct"))


def rates(tracker: DataFrame, small: int = 10) -> DataFrame:
    """One row: response, interview and offer rates over the applied, absent over nothing, and a small-sample mark."""
    status = canonical_status(F.col("status"))
    totals = tracker.agg(*[count_if(status.isin(*s)).alias(k) for k, s in FUNNEL.items()])
    return totals.select(
        F.col("Applied").alias("applied"),
        rate_or_null(F.col("Responded"), F.col("Applied")).alias("response_rate"),
        rate_or_null(F.col("Interview"), F.col("Applied")).alias("interview_rate"),
        rate_or_null(F.col("Offer"), F.col("Applied")).alias("offer_rate"),
        (F.col("Applied") < small).alias("small_sample"),
    )


def progress(tracker: DataFrame) -> DataFrame:
    """One row: rows, average and top of the positive scores, active and offered."""
    status, scored = canonical_status(F.col("status")), F.when(F.col("score") > 0, F.col("score"))
    return tracker.agg(
        F.count("*").alias("tracked"), F.coalesce(F.round(F.avg(scored), 6), F.lit(0.0)).alias("avg_score"), F.coalesce(F.max(scored), F.lit(0.0)).alias("top_score"),
        count_if(status.isin(*ACTIVE)).alias("active"), count_if(status.isin("OFFER", "HIRED")).alias("offers"),
    )


def score_histogram(tracker: DataFrame) -> DataFrame:
    """Half-open buckets of the positive scores, all of them listed."""
    score = F.col("score")
    names = [(label, f"n{i}", "all") for i, (_, _, label) in enumerate(SCORE_BUCKETS)]
    totals = tracker.where(score > 0).agg(
        F.count("*").alias("all"), *[count_if((score >= lo) & (score < hi)).alias(f"n{i}") for i, (lo, hi, _) in enumerate(SCORE_BUCKETS)]
    )
    return _unpivot(totals, names).select("position", "label", "count", percentage(F.col("count"), F.col("base")).alias("pct"))


def weekly_activity(rows: DataFrame, day_col: str, weeks: int = 8) -> DataFrame:
    """Counts of the last ISO weeks that have data."""
    counts = rows.where(F.col(day_col).isNotNull()).groupBy(iso_week(F.col(day_col)).alias("week")).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("week")).limit(weeks)


def breakdown(rows: DataFrame, label: Column, limit: int | None = None) -> DataFrame:
    """(label, count, pct) of the rows that have a label, the most frequent first."""
    counts = rows.where(label.isNotNull() & (label != "")).groupBy(label.alias("label")).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("all"))
    # The total is one row; the labels are already counts.
    out = counts.join(F.broadcast(total)).select("label", "count", percentage(F.col("count"), F.col("all")).alias("pct"))
    return out if limit is None else out.orderBy(F.desc("count"), "label").limit(limit)


def quality_tiers(tracker: DataFrame) -> DataFrame:
    score = F.col("score")
    label = F.lit(None).cast("string")
    for low, name in reversed(QUALITY):
        label = F.when(score >= low, name).otherwise(label)
    return breakdown(tracker.where(score > 0), label)


def pay_band(value: Column) -> Column:
    out = F.lit("$220K+")
    for most, label in reversed(PAY_BANDS):
        out = F.when(value < most if label.startswith("<") else value <= most, label).otherwise(out)
    return out


def pay_summary(tracker: DataFrame) -> DataFrame:
    """One row: count, sources, mean, exact median and maximum of stated pay."""
    paid = tracker.where(F.col("pay") > 0)
    return paid.agg(
        F.count("*").alias("count"), count_if(F.upper("pay_source") == "POSTED").alias("posted"), count_if(F.lower("pay_source") == "est").alias("estimated"),
        F.coalesce(F.round(F.avg("pay"), 4), F.lit(0.0)).alias("avg_pay"), F.coalesce(F.median("pay"), F.lit(0.0)).alias("median_pay"), F.coalesce(F.max("pay"), F.lit(0.0)).alias("max_pay"),
    )


def tab_counts(tracker: DataFrame, tabs: tuple[str, ...]) -> DataFrame:
    """Counts by stage tab; unknown stages are OTHER."""
    status = canonical_status(F.col("status"))
    return tracker.groupBy(F.when(status.isin(*tabs), status).otherwise("OTHER").alias("tab")).agg(F.count("*").alias("count"))


def discards_by_reason(discards: DataFrame) -> DataFrame:
    return discards.groupBy("reason").agg(F.count("*").alias("count"))


def discards_by_url(discards: DataFrame) -> DataFrame:
    """Per URL its discards and the latest reason; of equal times the later row's."""
    return discards.groupBy("url").agg(F.count("*").alias("count"), F.max_by("reason", F.struct("stamp", "seq")).alias("latest_reason"))


def filter_audit(titles: DataFrame, keywords: dict[str, Column], score: Column, noisy_hits: int = 5, noisy_score: float = 2.5) -> DataFrame:
    """Per keyword: hits, hits that no other keyword has, mean score, verdict (dead, redundant, noisy, ok)."""
    hits = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in keywords.items()]))
    rows = titles.select(hits.alias("hits"), score.alias("score")).select(F.explode("hits").alias("keyword"), F.size("hits").alias("n"), "score")
    counted = rows.groupBy("keyword").agg(
        F.count("*").alias("hits"), count_if(F.col("n") == 1).alias("unique_hits"), F.count("score").alias("scored"), F.round(F.avg("score"), 6).alias("avg_score")
    )
    names = titles.sparkSession.createDataFrame([(k,) for k in keywords], "keyword string")
    out = names.join(counted, "keyword", "left").fillna(0, ["hits", "unique_hits", "scored"])
    verdict = (
        F.when(F.col("hits") == 0, "dead").when((F.col("hits") >= noisy_hits) & (F.col("avg_score") < noisy_score), "noisy")
        .when(F.col("unique_hits") == 0, "redundant").otherwise("ok")
    )
    return out.withColumn("verdict", verdict)


def friction(rows: DataFrame, channel: Column, limit_share: int = 2) -> DataFrame:
    """Per company (undisclosed ones by channel): rows, rows with a friction reason, and their share."""
    name = F.when(F.trim(F.coalesce("company", F.lit(""))) == "", F.concat(F.lit("via "), channel)).otherwise(F.trim("company"))
    return rows.groupBy(name.alias("company")).agg(
        F.count("*").alias("total"), F.count("reason").alias("tagged"), F.round(F.count("reason") / F.count("*"), limit_share).alias("rate")
    )


def ranked(rows: DataFrame, *order: Column, by: tuple[str, ...] = (), keep: int | None = None) -> DataFrame:
    """Rows with their place in an order, within groups if given."""
    window = Window.partitionBy(*by).orderBy(*order)
    out = rows.withColumn("place", F.row_number().over(window))
    return out if keep is None else out.where(F.col("place") <= keep)


def sankey_leaf(status: Column, interviewed: Column, submitted: Column) -> Column:
    """The one leaf of the flow graph at which a row ends."""
    plain = {
        "SKIP": "skip", "EVALUATED": "evaluated", "SPECULATIVE": "speculative", "APPLIED": "waiting", "RESPONDED": "screening",
        "ASSESSMENT": "assessment", "INTERVIEW": "interview", "OFFER": "offer", "HIRED": "hired",
    }
    out = F.try_element_at(F.create_map(*[F.lit(x) for pair in plain.items() for x in pair]), status)
    out = F.when(status == "REJECTED", F.when(interviewed, "rejectedInterview").otherwise("rejectedApply")).otherwise(out)
    gone = F.when(interviewed, "discardedInterview").when(submitted, "discarded").otherwise("discardedEarly")
    return F.coalesce(F.when(status == "DISCARDED", gone).otherwise(out), F.lit("other"))


#: Parent of each node of the flow graph.
SANKEY_PARENT = {
    **dict.fromkeys(("skip", "evaluated", "speculative", "other", "discardedEarly", "submitted"), "tracked"),
    **dict.fromkeys(("waiting", "engaged", "rejectedApply", "discarded"), "submitted"),
    **dict.fromkeys(("screening", "assessment", "interview", "offer", "hired", "rejectedInterview", "discardedInterview"), "engaged"),
}


def sankey_nodes(tracker: DataFrame, ledger: DataFrame) -> DataFrame:
    """(node, value) of the flow graph's nodes that have rows; ledger is (num, stage): stages ever seen."""
    seen = ledger.groupBy("num").agg(
        F.max(F.col("stage").isin("INTERVIEW", "OFFER", "HIRED")).alias("interviewed"), F.max(F.col("stage").isin(*FUNNEL["Applied"])).alias("submitted")
    )
    rows = tracker.join(seen, tracker["n"] == seen["num"], "left")
    status = canonical_status(F.col("status"))
    interviewed = status.isin("INTERVIEW", "OFFER", "HIRED") | F.coalesce("interviewed", F.lit(False))
    leaf = sankey_leaf(status, interviewed, F.coalesce("submitted", F.lit(False)))
    leaves = rows.groupBy(leaf.alias("node")).agg(F.count("*").alias("value"))
    path = reduce(lambda out, item: F.when(F.col("node") == item[0], F.array(*[F.lit(x) for x in item[1]])).otherwise(out), _paths().items(), F.array(F.col("node")))
    return leaves.select(F.explode(path).alias("node"), "value").groupBy("node").agg(F.sum("value").alias("value"))


def _paths() -> dict[str, list[str]]:
    out = {}
    for node in SANKEY_PARENT:
        path = [node]
        while path[-1] in SANKEY_PARENT:
            path.append(SANKEY_PARENT[path[-1]])
        out[node] = path
    return out


def sankey_links(nodes: DataFrame) -> DataFrame:
    parent = F.try_element_at(F.create_map(*[F.lit(x) for pair in SANKEY_PARENT.items() for x in pair]), F.col("node"))
    return nodes.select(parent.alias("source"), F.col("node").alias("target"), "value").where("source IS NOT NULL")
