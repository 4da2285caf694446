"""Readers of the model's text files as DataFrames: missing cells are '', torn rows are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import formula_unescape
from ..functions.values import score_cell
from .cells import pipe_cells

# Columns of the sighting log, in file order (fixed values).
HISTORY = (
    "url first_seen portal title company status location fingerprint posted_at trust_score trust_flags normalized_company requisition_id "
    "language listing_key closes_at employment_type"
).split()
# Header aliases of the tracker's columns (fixed values).
TRACKER_ALIASES = {
    "#": "n", "n": "n", "num": "n", "date": "date", "company": "company", "via": "via", "role": "role", "score": "score", "status": "status",
    "pdf": "pdf", "report": "report", "notes": "notes", "location": "location", "url": "url",
}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, line) of text files in file order: the place of a line is part of a ledger's meaning.

    seq orders lines by append (files outside of any come first, by their times), file,
    block of the file, and place in the block; it does not depend on how Spark packs the
    blocks into tasks.
    """
    meta = lambda name: F.col(f"_metadata.{name}")
    batch = F.regexp_extract(meta("file_path"), r"/append-([0-9]+)/[^/]*$", 1)
    written = F.when(batch == "", meta("file_modification_time"))
    place = F.struct(
        batch.alias("append"), written.alias("written"), meta("file_path").alias("file"), meta("file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    )
    rows = spark.read.option("recursiveFileLookup", True).text(path).select("value", place.alias("seq"))
    return rows.select("seq", F.regexp_replace("value", r"\r$", "").alias("line")).where(F.trim("line") != "")


def _cells(rows: DataFrame, names: list[str]) -> DataFrame:
    cells = F.split("line", "\t", -1)
    return rows.select("seq", *[formula_unescape(F.trim(F.coalesce(F.get(cells, i), F.lit("")))).alias(c) for i, c in enumerate(names)])


def history(spark: SparkSession, path: str) -> DataFrame:
    """The sighting log: 17 text columns, short rows padded; the header goes only where it is the header."""
    return _cells(lines(spark, path), HISTORY).where(~((F.col("url") == HISTORY[0]) & (F.col("first_seen") == HISTORY[1])))


def status_log(spark: SparkSession, path: str) -> DataFrame:
    """The ledger (seq, num, date, origin, target, source, note); rows without a numeric id or a calendar date are torn."""
    rows = _cells(lines(spark, path), ["num", "date", "origin", "target", "source", "note"])
    typed = rows.withColumn("date", F.try_to_date("date", "yyyy-MM-dd")).where(F.col("num").rlike("^[0-9]+$"))
    return typed.withColumn("num", F.col("num").try_cast("long")).where("date IS NOT NULL AND origin != '' AND target != ''")


def discard_log(spark: SparkSession, path: str) -> DataFrame:
    """Discards of both generations: timestamp, url, reason, or with an id in second place."""
    cells = F.split("line", "\t", -1)
    n = F.size(cells)
    rows = lines(spark, path).where(n.isin(3, 4))
    return rows.select("seq", cells[0].alias("stamp"), F.get(cells, n - 2).alias("url"), F.get(cells, n - 1).alias("reason")).where("url != '' AND reason != ''")


def tracker(spark: SparkSession, path: str) -> DataFrame:
    """A Markdown pipe table with an alias header; rows without a numeric id are dropped."""
    rows = lines(spark, path).where(F.trim("line").startswith("|")).withColumn("cells", pipe_cells(F.col("line")))
    cells = F.col("cells")
    header = rows.where(F.exists(cells, lambda c: F.lower(c).isin("company"))).orderBy("seq").select(cells.alias("h")).first()
    if header is None:
        raise ValueError("no header row with a company column")
    places = {TRACKER_ALIASES[h.strip().lower()]: i for i, h in enumerate(header["h"]) if h.strip().lower() in TRACKER_ALIASES}
    if missing := {"n", "company", "role", "score", "status"} - places.keys():
        raise ValueError(f"header lacks {sorted(missing)}")
    out = rows.select("seq", *[F.coalesce(F.get(cells, i), F.lit("")).alias(c) for c, i in places.items()]).where(F.col("n").rlike("^[0-9]+$"))
    score = score_cell(F.col("score"))
    out = out.withColumn("n", F.col("n").cast("long")).withColumn("has_score", score.isNotNull()).withColumn("score", score)
    return out.withColumn("pdf", F.contains("pdf", F.lit("✅"))) if "pdf" in places else out


def inbox(spark: SparkSession, path: str) -> DataFrame:
    """The checklist of pending postings: done, url, company, role, location, and labels (last one wins) from the fourth cell on."""
    rows = lines(spark, path).where(F.col("line").rlike(r"^\s*- \[[ xX]\] "))
    body = F.regexp_replace("line", r"^\s*- \[[ xX]\] (#[0-9]+ *\|?)?", "")
    cells = F.transform(F.split(body, r"\|"), lambda c: F.trim(c))
    tail = F.filter(F.slice(cells, 4, F.greatest(F.size(cells) - 3, F.lit(0))), lambda c: c.rlike(r"^(posted|trust|yrs|note|rank): "))
    labels = F.aggregate(
        tail, F.create_map().cast("map<string,string>"),
        lambda m, c: F.map_concat(F.map_filter(m, lambda k, v: k != F.split(c, ": ", 2)[0]), F.create_map(F.split(c, ": ", 2)[0], F.split(c, ": ", 2)[1])),
    )
    place = F.get(cells, 3)
    return rows.select(
        "seq", F.col("line").rlike(r"^\s*- \[[xX]\]").alias("done"), cells[0].alias("url"), F.coalesce(F.get(cells, 1), F.lit("")).alias("company"),
        F.coalesce(F.get(cells, 2), F.lit("")).alias("role"), F.when(~place.rlike(r"^(posted|trust|yrs|note|rank): "), place).otherwise("").alias("location"), labels.alias("labels"),
    )


def postings(spark: SparkSession, path: str) -> DataFrame:
    """Landed postings as JSON lines, by a fixed schema: unknown fields are left out, missing ones null."""
    schema = (
        "title string, url string, company string, location string, workplace_type string, locations array<string>, country string, description string, "
        "employment_type string, posted_at long, salary struct<min:double,max:double,currency:string,period:string>, external_id string, requisition_id string, "
        "listing_identity struct<ats_provider:string,board_slug:string,posting_id:string>, trust_score int, trust_flags array<string>, language string"
    )
    return spark.read.schema(schema).json(path).withColumn("posted_at", F.timestamp_millis("posted_at"))
