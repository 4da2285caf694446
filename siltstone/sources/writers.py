"""Writers: guarded delimited exports, ledger appends, width migrations."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import formula_escape


def guarded(df: DataFrame) -> DataFrame:
    """All columns as text, with cells that a spreadsheet would run escaped and nulls as ''."""
    return df.select([formula_escape(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(c) for c in df.columns])


def export_csv(df: DataFrame, path: str, optional: tuple[str, ...] = ()) -> None:
    """CSV with header; optional columns that are empty in all rows are dropped."""
    empty = [c for c in optional if c in df.columns]
    if empty:
        used = df.agg(*[F.max(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "").alias(c) for c in empty]).first()
        df = df.drop(*[c for c in empty if not used[c]])
    guarded(df).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def append_transitions(df: DataFrame, path: str) -> None:
    """Transitions (num, date, origin, target, source, note) as tab-separated lines; the ledger is only appended to.

    Each append is a folder of its own, named by its time, so that readers keep the order
    of appends; within one, transitions of `seq` (if there is such a column) are in its order.
    """
    if "seq" in df.columns:
        df = df.repartitionByRange("seq").sortWithinPartitions("seq")
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]+", " ") for c in ("num", "date", "origin", "target", "source", "note")]
    df.select(F.concat_ws("\t", *cells).alias("value")).write.text(f"{path.rstrip('/')}/append-{time.time_ns():020d}")


def migrated(rows: DataFrame, versions: dict[int, list[str]], current: list[str]) -> DataFrame:
    """Rows (line) of known widths, as lines of the current columns; unknown widths pass through."""
    cells = F.split("line", "\t", -1)
    out = F.col("line")
    for width, names in versions.items():
        moved = F.concat_ws("\t", *[F.coalesce(F.get(cells, names.index(c)), F.lit("")) if c in names else F.lit("") for c in current])
        out = F.when(F.size(cells) == width, moved).otherwise(out)
    return rows.withColumn("line", out)


def export_chunks(df: DataFrame, path: str, rows: int = 5000) -> None:
    """Text lines (value) in files of at most `rows` lines."""
    df.select("value").write.option("maxRecordsPerFile", rows).text(path)


def kept_manifest(manifest: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """Rows of a manifest (path) whose file is there (files: path) and inside the folder."""
    inside = F.col("path").startswith(folder.rstrip("/") + "/") & ~F.col("path").rlike(r"(^|/)\.\.(/|$)")
    return manifest.where(inside).join(files.select("path").distinct(), "path", "left_semi")
