"""Document frequencies, smoothed lift and coverage of terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_set


def document_frequency(docs: DataFrame, text_col: str, top: int | None = None) -> DataFrame:
    """(term, df, share) over the documents; the most frequent if top is given."""
    n = docs.agg(F.count("*").alias("n"))
    counts = docs.select(F.explode(token_set(F.col(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    if top is not None:
        counts = counts.orderBy(F.desc("df"), "term").limit(top)
    # One row of totals is joined to counts.
    return counts.join(F.broadcast(n)).select("term", "df", (F.col("df") / F.col("n")).alias("share"))


def term_lift(positive: DataFrame, baseline: DataFrame, text_col: str, least: int = 3) -> DataFrame:
    """(term, pos, base, lift): add-one smoothed log2 of the document shares, for terms of `least` positives."""
    side = lambda df, name: df.select(F.explode(token_set(F.col(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias(name))
    totals = positive.agg(F.count("*").alias("np")).join(F.broadcast(baseline.agg(F.count("*").alias("nb"))))
    joined = side(positive, "pos").where(F.col("pos") >= least).join(side(baseline, "base"), "term", "left").fillna(0, ["base"])
    lift = F.log2(((F.col("pos") + 1) / (F.col("np") + 2)) / ((F.col("base") + 1) / (F.col("nb") + 2)))
    return joined.join(F.broadcast(totals)).select("term", "pos", "base", F.round(lift, 6).alias("lift"))
