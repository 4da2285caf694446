"""Fuzzy role titles: tokens, seniority tiers, and a match that agrees on both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_rule

# Words that tell no roles apart (fixed values).
ROLE_STOP = ("with", "for", "the", "and", "remote", "hybrid", "full", "time", "part", "role", "team", "position", "senior", "junior", "lead", "staff", "principal")
# Short words that do (fixed values).
SHORT = ("ai", "ml", "qa", "ux", "ui", "sre", "ios", "web", "api", "seo", "crm", "erp", "hr", "it")
TIERS = [(r"\bintern(ship)?\b", "intern"), (r"\b(junior|jr|entry|graduate|trainee)\b", "entry"), (r"\b(senior|sr|staff|principal|lead|director|head|chief)\b", "senior")]


def role_tokens(title: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}+#]+"), lambda w: w != "")
    return F.array_distinct(F.filter(words, lambda w: ((F.length(w) > 3) | w.isin(*SHORT)) & ~w.isin(*ROLE_STOP)))


def role_tier(title: Column) -> Column:
    return first_rule(F.lower(F.coalesce(title, F.lit(""))), TIERS, "mid")


def same_role(left: Column, right: Column, least: float = 0.6) -> Column:
    """Equal titles, or: one tier, at least two shared tokens (or all of them), and an overlap of `least` of the union."""
    a, b = role_tokens(left), role_tokens(right)
    shared, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    enough = (shared >= 2) | ((shared >= 1) & (shared == union))
    return (F.lower(F.trim(left)) == F.lower(F.trim(right))) | ((role_tier(left) == role_tier(right)) & enough & (shared / F.greatest(union, F.lit(1)) >= least))


def role_matches(left: DataFrame, right: DataFrame, least: float = 0.6) -> DataFrame:
    """Pairs (left_title, right_title) of distinct titles (title) that match; candidates share a token or the whole title."""
    keys = lambda df, name: df.select(F.col("title").alias(name)).distinct().select(name, F.explode(F.array_union(role_tokens(F.col(name)), F.array(F.lower(F.trim(F.col(name)))))).alias("key"))
    pairs = keys(left, "left_title").join(keys(right, "right_title"), "key").select("left_title", "right_title").distinct()
    return pairs.where(same_role(F.col("left_title"), F.col("right_title"), least))
