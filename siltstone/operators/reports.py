"""Reports over sightings, blockers, usage and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import count_if


def scan_stats(history: DataFrame) -> DataFrame:
    """One row over sightings (portal, status, company, first_seen): totals, added ones, companies and the span of days."""
    return history.agg(
        F.count("*").alias("total"), count_if(F.col("status") == "added").alias("added"), F.countDistinct("company").alias("companies"),
        F.countDistinct("portal").alias("portals"), F.min("first_seen").alias("first"), F.max("first_seen").alias("last"),
    )


def portal_coverage(configured: DataFrame, history: DataFrame) -> DataFrame:
    """One row: configured portals, those that were seen, those that added something, and their share."""
    seen = history.groupBy("portal").agg(F.max((F.col("status") == "added").cast("int")).alias("producing"))
    joined = configured.select("portal").distinct().join(seen, "portal", "left")
    counts = joined.agg(F.count("*").alias("configured"), F.count("producing").alias("active"), F.coalesce(F.sum("producing"), F.lit(0)).alias("producing"))
    return counts.withColumn("producing_pct", F.when(F.col("configured") > 0, F.col("producing") / F.col("configured") * 100))


def followup_stats(applied: DataFrame, followups: DataFrame) -> DataFrame:
    """One row: follow-ups, applications that have some, applied ones without, and the mean of those with."""
    per = followups.groupBy("n").agg(F.count("*").alias("k"))
    joined = applied.select("n").distinct().join(per, "n", "full")
    return joined.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("total"), F.count("k").alias("with_followup"), count_if(F.col("k").isNull()).alias("without"), F.round(F.avg("k"), 2).alias("average")
    )


def cold(active: DataFrame, followups: DataFrame, most: int) -> DataFrame:
    """Active applications that had `most` follow-ups or more and no answer."""
    per = followups.groupBy("n").agg(F.count("*").alias("k")).where(F.col("k") >= most)
    return active.where("NOT responded").join(per, "n", "left_semi").select("n")


def skip_blockers(skipped: DataFrame, needs: DataFrame, recent: int = 20, least: int = 2, top: int = 5) -> DataFrame:
    """Requirements that the last skipped reports lacked: (requirement, reports, missing), of two reports or more, the most frequent.

    A report counts once for a requirement, a missing match before a partial one.
    """
    last = skipped.orderBy(F.desc("day"), F.desc("id")).limit(recent)  # the report's window
    rows = needs.where(F.col("importance").isin("critical", "high") & F.col("match").isin("missing", "partial")).join(last.select("id"), "id")
    once = rows.groupBy("id", F.lower(F.trim("requirement")).alias("requirement")).agg(F.max((F.col("match") == "missing").cast("int")).alias("missing"))
    counted = once.groupBy("requirement").agg(F.count("*").alias("reports"), F.sum("missing").alias("missing")).where(F.col("reports") >= least)
    return counted.orderBy(F.desc("reports"), F.desc("missing"), "requirement").limit(top)


def token_cost(steps: DataFrame, per_input: float, per_cached: float, per_output: float) -> DataFrame:
    """Per step: tokens and their cost, cached input at its own price (prices are per million)."""
    cost = (F.col("input") - F.col("cached")) * per_input + F.col("cached") * per_cached + F.col("output") * per_output
    return steps.groupBy("step").agg(
        F.sum("input").alias("input"), F.sum("cached").alias("cached"), F.sum("output").alias("output"), F.round(F.sum(cost) / 1e6, 6).alias("cost")
    )


def merged_scans(scans: DataFrame, counters: list[str], flags: list[str]) -> DataFrame:
    """One row over sources: sums of counters (a counter that no source has stays missing) and any of the flags."""
    return scans.agg(*[F.sum(c).alias(c) for c in counters], *[F.coalesce(F.max(c), F.lit(False)).alias(c) for c in flags])


def writing_profile(samples: DataFrame, id_col: str, text_col: str, least: int = 300) -> DataFrame:
    """Per sample of enough words: words, sentences, words a sentence, share of long words, commas per 100 words."""
    value = F.trim(F.coalesce(F.col(text_col), F.lit("")))
    words = F.filter(F.split(value, r"\s+"), lambda w: w != "")
    sentences = F.greatest(F.size(F.filter(F.split(value, r"[.!?]+(\s+|$)"), lambda s: F.trim(s) != "")), F.lit(1))
    n = F.size(words)
    rows = samples.select(F.col(id_col).alias("id"), n.cast("long").alias("words"), sentences.cast("long").alias("sentences"), words.alias("w"), value.alias("v")).where(F.col("words") >= least)
    long_ = F.size(F.filter("w", lambda w: F.length(w) >= 7))
    commas = F.length("v") - F.length(F.replace("v", F.lit(","), F.lit("")))
    return rows.select(
        "id", "words", "sentences", F.round(F.col("words") / F.col("sentences"), 4).alias("words_per_sentence"), F.round(long_ / F.col("words"), 4).alias("long_share"),
        F.round(commas * 100 / F.col("words"), 4).alias("commas_per_100"),
    )


def profile_ranges(profiles: DataFrame) -> DataFrame:
    """One row: the least and the largest of each measure over the samples."""
    names = ["words_per_sentence", "long_share", "commas_per_100"]
    return profiles.agg(F.count("*").alias("samples"), *[f(n).alias(f"{p}_{n}") for n in names for p, f in (("min", F.min), ("max", F.max))])


def advance_rates(rows: DataFrame, label: Column, least: int = 5) -> DataFrame:
    """Per label: submitted, decided and advanced rows and the share that advanced of the decided, absent under the sample gate."""
    counts = rows.groupBy(label.alias("label")).agg(
        count_if(F.col("submitted")).alias("submitted"), count_if(F.col("decided")).alias("decided"), count_if(F.col("advanced")).alias("advanced")
    )
    return counts.withColumn("rate", F.when(F.col("decided") >= least, F.round(F.col("advanced") / F.col("decided") * 100, 4)))


def tier(volume: Column, recency: Column, share: Column) -> Column:
    """Sponsor tier by volume, recency in years and share; the first rule that holds."""
    return F.when((volume >= 50) & (recency <= 1) & (share >= 0.5), "strong").when((volume >= 10) & (recency <= 2), "active").when(volume >= 1, "rare").otherwise("none")


def whats_new(rows: DataFrame, cutoff: Column, top: int) -> DataFrame:
    """Rows dated after a cutoff (all rows if none is dated), the best fits first, `top` of them."""
    dated = rows.agg(F.max("day").isNotNull().alias("any"))
    kept = rows.join(F.broadcast(dated)).where(~F.col("any") | (F.col("day") > cutoff)).drop("any")
    return kept.orderBy(F.desc_nulls_last("fit"), F.desc_nulls_last("day"), "id").limit(top)


def coverage(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """Per wanted term: how often the texts have it, and covered (twice or more), thin (once) or missing."""
    found = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}+#]+)"), F.lit(1))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    out = terms.select(F.lower("term").alias("term")).distinct().join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))
    return out.withColumn("state", F.when(F.col("n") >= 2, "covered").when(F.col("n") == 1, "thin").otherwise("missing"))


def quiet(rows: DataFrame, today: Column, top: int = 10) -> DataFrame:
    """Companies by days since their last contact, the longest first."""
    last = rows.groupBy("company").agg(F.max("day").alias("last"))
    return last.select("company", F.datediff(today, "last").alias("days")).orderBy(F.desc("days"), "company").limit(top)


def previous(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Each row with the value before it in its key's order."""
    return rows.withColumn("previous", F.lag(value).over(Window.partitionBy(key).orderBy(order)))
