"""Orders and queues: sorts with missing values last, first picks, groups, bounded lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import APPLY_LABELS, apply_label, flagged
from .lineage import checkpointed


def _order(df: DataFrame, keys: list[tuple[str, bool]], tie: str) -> list[Column]:
    """Keys (name, ascending), missing, empty and not-a-number values alike and last in either direction, ties by a column of distinct values."""
    order = []
    for name, up in keys:
        missing = F.nullif(F.col(name).cast("string"), F.lit("")).isNull()
        if df.schema[name].dataType.typeName() in ("double", "float"):
            missing = missing | F.isnan(name)
        value = F.when(~missing, F.col(name))
        order += [missing.asc(), value.asc() if up else value.desc()]
    return [*order, F.col(tie)]


def placed(df: DataFrame, group: str, keys: list[tuple[str, bool]], tie: str) -> DataFrame:
    """Adds each row's place in its group, by keys (name, ascending); missing and empty values are last in either direction."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*_order(df, keys, tie))))


def placed_overall(df: DataFrame, keys: list[tuple[str, bool]], tie: str) -> DataFrame:
    """Adds each row's place among all rows, by keys (name, ascending).

    Rows are sorted by ranges, so every task has a stretch of the order; a row's place is its
    number in its stretch, and the sizes of the stretches before, one number each, are all that is gathered.
    """
    number = F.monotonically_increasing_id()
    rows = df.orderBy(*_order(df, keys, tie)).withColumns({"_part": F.spark_partition_id(), "_at": number.bitwiseAND(F.lit((1 << 33) - 1))})
    rows = checkpointed(rows)
    before, total = {}, 0
    for part, n in sorted(rows.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        before[part] = total
        total += n
    if not before:
        return rows.withColumn("place", F.col("_at")).drop("_part", "_at")
    sizes = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    return rows.withColumn("place", F.try_element_at(sizes, F.col("_part")).cast("long") + F.col("_at") + 1).drop("_part", "_at")


def results_view(offers: DataFrame, query: str = "", hidden: tuple[str, ...] = (), keys: list[tuple[str, bool]] | None = None, tie: str = "n") -> DataFrame:
    """Offers (title, company, band, ..) whose title or company has the query, without the hidden bands, with their places in the view's order."""
    wanted = query.strip().lower()
    rows = offers
    if wanted:
        has = lambda c: F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(wanted))
        rows = rows.where(has("title") | has("company"))
    if hidden:
        rows = rows.where(~F.coalesce(F.col("band"), F.lit("")).isin(*hidden))
    return placed_overall(rows, keys or [("score", False)], tie)


def awaiting(df: DataFrame) -> list[Column]:
    """The order of rows that await a decision: score, date and number, the largest first."""
    return [F.col("score").desc_nulls_last(), F.col("day").desc_nulls_last(), F.col("n").desc()]


def apply_next(rows: DataFrame, today: Column) -> DataFrame:
    """The first evaluated row whose stored call is Apply, that is not flagged and not closed."""
    open_ = F.col("close").isNull() | (F.col("close") >= today)
    return rows.where((F.col("stage") == "EVALUATED") & (F.col("decision") == "Apply") & ~flagged(F.col("legitimacy")) & open_).orderBy(*awaiting(rows)).limit(1)


def awaiting_groups(rows: DataFrame) -> DataFrame:
    """(position, label, rows) of the labels that evaluated rows have, in order of display."""
    label = apply_label(F.col("score"), F.col("legitimacy"))
    table = F.array(*[F.lit(x) for x in APPLY_LABELS])
    found = rows.where("stage = 'EVALUATED'").groupBy(label.alias("label")).agg(F.count("*").alias("rows"))
    return found.select(F.array_position(table, F.col("label")).alias("position"), "label", "rows")


def today_queue(items: DataFrame, most: int) -> DataFrame:
    """The first items (kind, due, seq) by rank: due follow-ups, decisions, matches, other follow-ups, the rest; then in input order."""
    rank = F.when((F.col("kind") == "follow-up") & F.col("due"), 0).when(F.col("kind") == "decision", 1).when(F.col("kind") == "match", 2).when(F.col("kind") == "follow-up", 3).otherwise(4)
    return items.withColumn("rank", rank).orderBy("rank", "seq").limit(most)


def followups_due(rows: DataFrame, most: int = 8) -> DataFrame:
    """Rows (n, urgency, next) that are due: urgent before overdue, then by date."""
    due = rows.where(F.col("urgency").isin("urgent", "overdue"))
    return due.orderBy(F.col("urgency") != "urgent", F.col("next").asc_nulls_last(), "n").limit(most)


def prep_questions(rows: DataFrame, most: int = 6) -> DataFrame:
    """Each requirement's first question (group, requirement, importance, seq), the most important first, at most `most` a group."""
    rank = F.when(F.col("importance") == "critical", 0).when(F.col("importance") == "high", 1).when(F.col("importance") == "medium", 2).otherwise(3)
    first = Window.partitionBy("group", F.lower(F.trim("requirement"))).orderBy("rank", "seq")
    ranked = rows.withColumn("rank", rank).withColumn("k", F.row_number().over(first)).where("k = 1")
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy("rank", "seq", "requirement"))).where(F.col("place") <= most).drop("k")


def first_acceptable(stripped: Column, candidates: list[Column], least: int) -> Column:
    """The first candidate text of `least` words that has more than the stripped text (any, if that is thin); else the longest of all."""
    words = lambda c: F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([^ \t\r\n\f]+)"), F.lit(1)))
    own = words(stripped)
    good = [F.when((words(c) >= least) & ((own < least) | (words(c) > own)), c) for c in candidates]
    every = [F.struct(words(c).alias("n"), F.lit(-i).alias("place"), F.coalesce(c, F.lit("")).alias("text")) for i, c in enumerate([stripped, *candidates])]
    longest = F.array_max(F.array(*every))["text"]  # of equal ones the first
    return F.coalesce(*good, longest)
