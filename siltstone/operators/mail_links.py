"""Links in mails and pages: soft breaks rejoined, redirects unwrapped to a bounded depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Redirects within redirects that are followed.
DEPTH = 3
#: A web address, or a bare address of one network's jobs that is no part of another.
LINK = r"(?i)https?://[^\s\"'<>]+|(?<![\w.\-/%@:=&?#~+])(?:[a-z0-9-]+\.)?linkedin\.com/(?:comm/)?jobs/[^\s\"'<>]+"


def unfolded(text: Column) -> Column:
    """Quoted-printable text with its soft line breaks joined and its equals signs restored; other bytes stay as they are."""
    joined = F.regexp_replace(F.coalesce(text, F.lit("")), r"=\r?\n", "")
    return F.replace(F.regexp_replace(joined, "(?i)=3D", "="), F.lit("&amp;"), F.lit("&"))


def _inner(url: Column) -> Column:
    """The values of a URL's parameters that are web addresses themselves, in order."""
    pairs = F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&")
    values = F.transform(pairs, lambda p: F.try_url_decode(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)))
    return F.filter(values, lambda v: v.rlike("(?i)^https?://[^/?#]"))


def links(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, place, depth, url): every link of every text, and those that redirects in it lead to.

    ``place`` orders a text's links as they stand: the link's number, then the number of the
    parameter within it, and so on; an outer link comes before its inner ones.
    """
    found = F.transform(F.regexp_extract_all(unfolded(F.col(text_col)), F.lit(LINK), F.lit(0)), lambda u: F.regexp_replace(u, r"(?<![),.;!?\]])[),.;!?\]]++$", ""))
    level = texts.select(F.col(id_col).alias("id"), F.posexplode(found).alias("pos", "raw"))
    url = F.when(F.col("raw").rlike("(?i)^https?:"), F.col("raw")).otherwise(F.concat(F.lit("https://"), "raw"))
    level = level.select("id", F.array("pos").alias("place"), F.lit(0).alias("depth"), url.alias("url"))
    # Each depth is exploded out of the one before in the same pass over the rows.
    within = F.array(F.struct(F.col("place"), F.col("depth"), F.col("url")))
    out = level.select("id", within.alias("found"), within.alias("last"))
    for depth in range(1, DEPTH + 1):
        deeper = F.flatten(F.transform("last", lambda x: F.transform(_inner(x["url"]), lambda v, i: F.struct(F.concat(x["place"], F.array(i)).alias("place"), F.lit(depth).alias("depth"), v.alias("url")))))  # noqa: B023
        out = out.withColumn("last", deeper).withColumn("found", F.concat("found", "last"))
    return out.select("id", F.explode("found").alias("x")).select("id", "x.*")


def first_ids(found: DataFrame, identity: Column) -> DataFrame:
    """(id, nth, key): the distinct identities of a text's links, in first-seen order from 0; links without one are left out."""
    named = found.withColumn("key", identity).where("key IS NOT NULL AND key != ''").groupBy("id", "key").agg(F.min("place").alias("place"))
    listed = named.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "key"))).alias("all"))
    return listed.select("id", F.posexplode("all").alias("nth", "x")).select("id", "nth", F.col("x.key").alias("key"))
