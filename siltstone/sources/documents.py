"""Readers of reports, tables, lists, feeds and messages as DataFrames."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.urls import normalized_url
from .cells import pipe_cells
from .readers import lines

# Headings of the pending section (fixed values).
PENDING_HEADINGS = r"(?i)^#+\s*(pending|pendientes?|en attente|ausstehend|待处理|待處理)\b"
# Header aliases of contact and list columns, the first that a header has wins (fixed values).
LIST_ALIASES = {"url": ("url", "link", "website"), "name": ("name", "company", "employer")}


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): whole files; reports are small."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r\n", "\n").alias("text"))


def first_table(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, cells) of the rows of each file's first Markdown table, its header at place 0; rows of another width and the rule are left out."""
    rows = texts(spark, path).select("file", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    rows = rows.withColumn("bar", F.trim("line").startswith("|"))
    order = Window.partitionBy("file").orderBy("place")
    rows = rows.withColumn("table", F.sum((F.col("bar") & ~F.coalesce(F.lag("bar").over(order), F.lit(False))).cast("int")).over(order)).where("bar AND table = 1")
    rows = rows.where(~F.col("line").rlike(r"^\s*\|(\s*:?-+:?\s*\|)+\s*$")).withColumn("cells", pipe_cells(F.col("line")))
    header = F.first("cells").over(order)
    return rows.withColumn("width", F.size(header)).where(F.size("cells") == F.col("width")).select("file", (F.row_number().over(order) - 1).alias("place"), "cells")


def tracker_state(spark: SparkSession, path: str) -> str:
    """missing (no such file), malformed (no table with a company column), empty or rows."""
    try:
        table = first_table(spark, path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return "missing"
        raise
    headed = table.where("place = 0").where(F.exists("cells", lambda c: F.lower(c) == "company"))
    found = headed.select("file").join(table.where("place > 0").groupBy("file").agg(F.count("*").alias("n")), "file", "left").agg(F.count("*").alias("tables"), F.sum("n").alias("n")).first()
    return "malformed" if not found["tables"] else "rows" if found["n"] else "empty"


def pending(spark: SparkSession, path: str) -> DataFrame:
    """(key, url, rest, seq): the unchecked rows of each file's pending section, the first of each URL key; a section ends at the next heading."""
    rows = lines(spark, path).withColumn("heading", F.col("line").rlike("^#+ "))
    order = Window.partitionBy("seq.file").orderBy("seq")
    section = F.last(F.when(F.col("heading"), F.col("line").rlike(PENDING_HEADINGS)), ignorenulls=True).over(order)
    rows = rows.withColumn("inside", section).where("inside AND NOT heading").where(F.col("line").rlike(r"^\s*- \[ \] "))
    body = F.regexp_replace("line", r"^\s*- \[ \] ", "")
    url = F.trim(F.split(body, r"\|")[0])
    rows = rows.select("seq", url.alias("url"), normalized_url(url).alias("key"), F.trim(F.regexp_extract(body, r"^[^|]*\|(.*)$", 1)).alias("rest")).where("key != ''")
    return rows.groupBy("key").agg(F.min_by(F.struct("url", "rest", "seq"), "seq").alias("r")).select("key", "r.url", "r.rest", "r.seq")


def csv_rows(spark: SparkSession, path: str, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns of a quoted CSV by alias: for each name the first alias that the header has; a header column serves one name; names without one are ''."""
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    have = {c.strip().lower(): c for c in reversed(rows.columns)}
    used: set[str] = set()
    out = []
    for name, names in aliases.items():
        hit = next((have[a] for a in names if a in have and have[a] not in used), None)
        used |= {hit} if hit else set()
        out.append(F.coalesce(F.trim(F.col(f"`{hit}`")), F.lit("")).alias(name) if hit else F.lit("").alias(name))
    return rows.select(out)


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url, name) of a list, with or without a header, cells parted by commas or tabs; a line without a web address is left out."""
    cells = F.transform(F.split("line", r"[,\t]", -1), lambda c: F.trim(c))
    web = F.filter(cells, lambda c: c.rlike(r"(?i)^(https?://|www\.)"))
    name = F.filter(cells, lambda c: (c != "") & ~c.rlike(r"(?i)^(https?://|www\.)"))
    rows = lines(spark, path).select("seq", F.get(web, 0).alias("url"), F.coalesce(F.get(name, 0), F.lit("")).alias("name"))
    return rows.where("url IS NOT NULL")


def score_summaries(spark: SparkSession, path: str) -> DataFrame:
    """(file, values): the 'Key: value' lines between a report's two score-summary marks; none without both marks."""
    block = F.regexp_extract("text", r"(?s)---SCORE_SUMMARY---\n(.*?)\n---(?:END_)?SCORE_SUMMARY---", 1)
    return texts(spark, path).select("file", _values(block).alias("values")).where(F.size("values") > 0)


def report_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, title, values): the first heading, and the 'Label: value' lines up to the first rule or second heading."""
    head = F.split("text", r"\n(?:---|## )", 2)[0]
    title = F.regexp_extract("text", r"(?m)^# +(.+)$", 1)
    return texts(spark, path).select("file", title.alias("title"), _values(F.regexp_replace(head, r"\*\*", "")).alias("values"))


def machine_summaries(spark: SparkSession, path: str) -> DataFrame:
    """(file, values, lists) of the fenced YAML under a report's one 'Machine Summary' heading: plain values, and lists by key; none if the heading is not unique."""
    rows = texts(spark, path).where(F.regexp_count("text", F.lit(r"(?m)^##+ +Machine Summary *$")) == 1)
    body = F.regexp_extract("text", r"(?s)\n##+ +Machine Summary *\n+```ya?ml\n(.*?)\n```", 1)
    keyed = F.regexp_extract_all(body, F.lit(r"(?m)^([a-z_]+):\s*$((?:\n\s*- .*)+)"), F.lit(0))
    item = lambda block: F.transform(F.regexp_extract_all(block, F.lit(r"\n\s*- *(.*)"), F.lit(1)), lambda v: F.trim(F.translate(v, '"', "")))
    lists = F.map_from_entries(F.transform(keyed, lambda k: F.struct(F.regexp_extract(k, "^([a-z_]+)", 1), item(k))))
    return rows.select("file", _values(body).alias("values"), lists.alias("lists")).where(F.size("values") > 0)


def _values(block: Column) -> Column:
    """Map of the 'key: value' lines of a block; of repeated keys the last counts."""
    found = F.regexp_extract_all(block, F.lit(r"(?m)^([\p{L}_][\p{L}\p{N}_ ]*: *\S.*)$"), F.lit(1))
    pair = F.transform(found, lambda x: F.struct(F.lower(F.trim(F.split(x, ":", 2)[0])).alias("k"), F.trim(F.translate(F.split(x, ":", 2)[1], '"', "")).alias("v")))
    last = F.filter(pair, lambda x, i: ~F.exists(F.slice(pair, i + 2, F.size(pair)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """(title, link, published) of an RSS feed's items; items without link or title are dropped."""
    schema = "title string, link string, pubDate string"
    rows = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    return rows.select(F.trim("title").alias("title"), F.trim("link").alias("link"), F.col("pubDate").alias("published")).where("title != '' AND link != ''")


def messages(spark: SparkSession, path: str) -> DataFrame:
    """(file, subject, sender, body) of pasted messages: header lines up to the first empty line."""
    head, body = F.split("text", r"\n\s*\n", 2)[0], F.get(F.split("text", r"\n\s*\n", 2), 1)
    field = lambda name: F.trim(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*(.*)$", 1))
    return texts(spark, path).select("file", field("subject").alias("subject"), field("from").alias("sender"), F.regexp_replace(F.coalesce(body, F.lit("")), r"^\s+|\s+$", "").alias("body"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of (gzipped) JSON lines by a schema; broken lines are dropped."""
    return spark.read.schema(schema + ", _broken string").option("columnNameOfCorruptRecord", "_broken").json(path).where("_broken IS NULL").drop("_broken")
