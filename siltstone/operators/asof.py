"""The last known dates at a date, without an inequality join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_known(rows: DataFrame, changes: DataFrame, key: str, at: str, sources: tuple[str, ...], width: int = 90) -> DataFrame:
    """Rows with a column for each source: the last of its changes (key, source, at) at the row's date or before.

    Rows and changes are put together and read in order within pieces of `width` days of a
    key; what earlier pieces leave behind comes from a running maximum over their
    summaries.  So no piece is longer than its days, however many dates a key has, and
    no pair of a row and a change is ever made.
    """
    piece = F.floor(F.datediff(F.col(at), F.lit("1970-01-01")) / width)
    own = [c for c in rows.columns if c not in (key, at)]
    left = rows.select(key, at, F.struct(*own).alias("_row"), *[F.lit(None).cast(rows.schema[at].dataType).alias(f"_{s}") for s in sources])
    dated = lambda s: F.when(F.col("source") == s, F.col(at)).cast(rows.schema[at].dataType).alias(f"_{s}")
    right = changes.where(F.col("source").isin(*sources) & F.col(at).isNotNull()).select(key, F.col(at).cast(rows.schema[at].dataType).alias(at), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), *map(dated, sources))
    both = left.unionByName(right).withColumn("_piece", piece)
    sums = both.groupBy(key, "_piece").agg(*[F.max(f"_{s}").alias(f"_{s}_sum") for s in sources])
    before = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(F.col(key).alias("_key"), F.col("_piece").alias("_of"), *[F.max(f"_{s}_sum").over(before).alias(f"_{s}_before") for s in sources])
    order = Window.partitionBy(key, "_piece").orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.select(key, at, "_piece", "_row", *[F.max(f"_{s}").over(order).alias(f"_{s}") for s in sources]).where("_row IS NOT NULL")
    joined = inside.join(carried, F.col(key).eqNullSafe(F.col("_key")) & F.col("_piece").eqNullSafe(F.col("_of")))
    known = [F.greatest(f"_{s}", f"_{s}_before").alias(s) for s in sources]
    return joined.select(key, at, *[F.col(f"_row.{c}").alias(c) for c in own], *known)


def changed_since(evaluated: Column, sources: tuple[str, ...]) -> Column:
    """Sources with a date after `evaluated`, the latest first, ties in the order given: an array of (source, changed)."""
    entries = [F.when(F.col(s) > evaluated, F.struct(F.lit(s).alias("source"), F.col(s).alias("changed"), F.lit(k).alias("place"))) for k, s in enumerate(sources)]

    def order(a: Column, b: Column) -> Column:
        return F.when(a["changed"] > b["changed"], -1).when(a["changed"] < b["changed"], 1).otherwise(a["place"] - b["place"])

    found = F.array_sort(F.array_compact(F.array(*entries)), order)
    return F.transform(found, lambda x: F.struct(x["source"].alias("source"), x["changed"].alias("changed")))


def evaluation_date(dates: dict[str, Column]) -> tuple[Column, Column]:
    """The latest of several dates, and the names of those that have it, in the order given."""
    latest = F.greatest(*dates.values()) if len(dates) > 1 else next(iter(dates.values()))
    names = F.array_compact(F.array(*[F.when(c == latest, F.lit(name)) for name, c in dates.items()]))
    return latest, names


def reevaluation_candidates(rows: DataFrame, changes: DataFrame, key: str, at: str, evaluated: str, sources: tuple[str, ...]) -> DataFrame:
    """Rows of which a source has changed since they were evaluated, as known at `at`: with `changed_since` and `latest`."""
    known = last_known(rows, changes, key, at, sources).withColumn("changed_since", changed_since(F.col(evaluated), sources))
    return known.where(F.size("changed_since") > 0).withColumn("latest", F.get("changed_since", 0)["changed"]).drop(*sources)
