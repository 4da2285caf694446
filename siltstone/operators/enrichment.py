"""Applications with what their reports and notes say, and how they are found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import notes
from .roles import same_role


def enriched(applications: DataFrame, reports: DataFrame) -> DataFrame:
    """Applications (num, role, notes, place, day, report) with their notes' fields and their report's facts (report, text).

    Reports are read once each: only what they state goes into the join, not their texts.  A
    report given twice counts by its longest text; an application without one keeps nulls.
    """
    kind = F.coalesce(
        F.nullif(F.trim(F.regexp_extract("text", r"(?m)^archetype_primary:\s*[\"']?([^\"'\n]+)", 1)), F.lit("")), F.nullif(F.trim(F.regexp_extract("text", r"(?m)^archetype:\s*[\"']?([^\"'\n]+)", 1)), F.lit("")),
        F.nullif(F.trim(F.regexp_replace(F.regexp_extract("text", r"(?i)\*\*(?:Archetype detected|Archetype)\*\*\s*\|\s*([^|\n]+)", 1), r"\*+", "")), F.lit("")),
    )
    facts = F.struct(F.length("text").alias("size"), kind.alias("archetype"), notes.report_score(F.col("text")).alias("report_score"), notes.has_hard_stop(F.col("text")).alias("hard_stop"), notes.is_suspicious(F.col("text")).alias("suspicious"))
    stated = reports.where("report IS NOT NULL").select("report", facts.alias("facts")).groupBy("report").agg(F.max("facts").alias("facts"))
    fields = notes.note_fields(F.col("notes"), F.col("role"), F.col("place"), F.col("day"))
    rows = applications.withColumn("fields", fields).drop("place")
    return rows.join(stated, "report", "left").select(*[c for c in rows.columns if c != "fields"], "fields.*", "facts.archetype", "facts.report_score", "facts.hard_stop", "facts.suspicious")


def found(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, num, by_what) of tracker rows (num, report, company, role): by number, by a part of a name, or by a role that is the same.

    A query of digits names a row or a report, whatever zeros it begins with.  Queries are what people
    type: few, and sent to the rows.
    """
    bare = lambda c: F.regexp_replace(c.cast("string"), "^0+(?=[0-9])", "")
    asked = queries.select(F.trim("query").alias("query")).where("query != ''").distinct()
    numbers = asked.where("query RLIKE '^[0-9]+$'").withColumn("number", bare(F.col("query")))
    by_row = rows.select("num", bare(F.col("num")).alias("number")).join(numbers, "number").select("query", "num", F.lit("row").alias("by_what"))
    by_report = rows.select("num", bare(F.col("report")).alias("number")).join(numbers, "number").select("query", "num", F.lit("report").alias("by_what"))
    words = asked.where("NOT query RLIKE '^[0-9]+$'")
    lower = lambda c: F.lower(F.coalesce(c, F.lit("")))

    def names(c: str) -> Column:
        return lower(F.col(c)).contains(lower(F.col("query")))

    part = names("company") | names("role")
    same = same_role(F.col("company"), F.col("query")) | same_role(F.col("role"), F.col("query"))
    # Each spelling meets the queries once, however many rows have it.
    named = rows.select("company", "role").distinct()
    met = named.join(F.broadcast(words), F.coalesce(part | same, F.lit(False))).select(F.struct("company", "role").alias("named"), "query", F.when(part, "part").otherwise("role").alias("by_what"))
    by_name = rows.select("num", F.struct("company", "role").alias("named")).join(met, "named").select("query", "num", "by_what")
    every = by_row.unionByName(by_report).unionByName(by_name)
    return every.groupBy("query", "num").agg(F.max("by_what").alias("by_what"))
