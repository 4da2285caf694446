"""HTML and invisible characters as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scanners import entities_decoded


def html_to_text(html: Column, most: int = 4000) -> Column:
    """Text of a page: comments, scripts and styles dropped, tags twice around entity decoding, white space collapsed, capped (the cap is the feature)."""
    out = F.coalesce(html, F.lit(""))
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?is)<script\b[^>]*>.*?</script\s*>", " ")
    out = F.regexp_replace(out, r"(?is)<style\b[^>]*>.*?</style\s*>", " ")
    for _ in range(2):
        out = entities_decoded(F.regexp_replace(out, r"<[^>]*>", " "))
    return F.substring(F.trim(F.regexp_replace(out, r"\s+", " ")), 1, most)


def block_text(html: Column) -> Column:
    """Like html_to_text, whole and with a line for each block."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|section|article|ul|ol|table)\s*>", "\n")
    out = entities_decoded(F.regexp_replace(out, r"<[^>]*>", ""))
    lines = F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r" *\n\s*", "\n")
    return F.regexp_replace(lines, r"^\s+|\s+$", "")


INVISIBLE = "[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]"


def without_invisible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def invisible_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(INVISIBLE)).cast("long")
