"""Lookups between logs: scores by URL, files by report, contacts by company, duplicates before an evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Legal forms that a company's key leaves out (fixed values).
FORMS = "inc|llc|ltd|gmbh|ag|corp|co|plc|sa|bv"


def company_key(name: Column, forms: bool = True) -> Column:
    """Letters and digits of a company's name in lower case, without its legal form if asked."""
    plain = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"[^\p{L}\p{N}]+", " ")
    return F.trim(F.regexp_replace(plain, rf" ({FORMS})\s*$", "")) if not forms else F.trim(plain)


def with_scores(history: DataFrame, reports: DataFrame) -> DataFrame:
    """History rows (url) with the score of their URL's latest report (url, report, score)."""
    last = reports.groupBy("url").agg(F.max_by("score", "report").alias("score"))
    return history.join(last, "url", "left")


def latest_files(index: DataFrame) -> DataFrame:
    """(report, path): the last file (report, path, seq) of each report, covers left out."""
    return index.where(~F.lower("path").contains("cover")).groupBy("report").agg(F.max_by("path", "seq").alias("path"))


def contacts_of(companies: DataFrame, contacts: DataFrame) -> DataFrame:
    """(company, name, by_what) of all contacts (name, company, seq) of each company, by its exact key or else without its legal form, newest first by seq."""
    both = lambda df: df.withColumn("exact", company_key(F.col("company"))).withColumn("loose", company_key(F.col("company"), forms=False))
    want = both(companies.select("company").distinct())
    have = both(contacts).select("name", "seq", F.col("exact").alias("their_exact"), "loose")
    met = want.join(have, "loose").where("loose != ''")
    return met.select("company", "name", "seq", F.when(F.col("exact") == F.col("their_exact"), "exact").otherwise("form").alias("by_what"))


def duplicates(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(n, known, tier, reason): the best earlier row for each new one: one URL, one requisition, one title, or one title but for its numbers, at one company.

    Rows have (n, key, requisition, company, title, day).  Candidates meet by key, by requisition or by company and
    core title, so no company's rows all meet; of equal tiers the latest by day and number is given.
    """
    core = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[0-9]+|\b(senior|junior|lead|staff)\b", " "), r"\s+", " "))
    new = rows.select("n", "key", "requisition", company_key(F.col("company"), False).alias("company"), F.lower(F.trim("title")).alias("title"), core(F.col("title")).alias("core"))
    old = known.select(F.col("n").alias("known"), "key", "requisition", company_key(F.col("company"), False).alias("company"), F.lower(F.trim("title")).alias("their_title"), core(F.col("title")).alias("core"), "day")
    url = new.join(old.where("key != ''").groupBy("key").agg(F.max(F.struct("day", "known")).alias("m")), "key").select("n", F.lit(1).alias("tier"), F.lit("url").alias("reason"), "m")
    req = old.where("requisition != ''").groupBy("company", "requisition").agg(F.max(F.struct("day", "known")).alias("m"))
    req = new.join(req, ["company", "requisition"]).select("n", F.lit(1).alias("tier"), F.lit("req").alias("reason"), "m")
    titles = old.where("core != ''").groupBy("company", "core", "their_title").agg(F.max(F.struct("day", "known")).alias("m"))
    met = new.join(titles, ["company", "core"])
    same = F.col("title") == F.col("their_title")
    named = met.select("n", F.when(same, 2).otherwise(3).alias("tier"), F.when(same, "same-title").otherwise("similar-title").alias("reason"), "m")
    best = url.unionByName(req).unionByName(named)
    order = F.struct(-F.col("tier"), F.col("m.day"), F.col("m.known"), F.when(F.col("reason") == "url", 1).otherwise(0))
    return best.groupBy("n").agg(F.max_by(F.struct("m.known", "tier", "reason"), order).alias("b")).select("n", "b.known", "b.tier", "b.reason")


def split_imported(found: DataFrame, seen: DataFrame) -> DataFrame:
    """(id, verdict): ids found in a text, as added or already seen."""
    known = seen.select("id").distinct().withColumn("known", F.lit(True))
    return found.select("id").distinct().join(known, "id", "left").select("id", F.when(F.col("known"), "seen").otherwise("added").alias("verdict"))
