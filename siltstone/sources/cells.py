"""Cells of Markdown tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pipe_cells(line: Column) -> Column:
    """Cells of a Markdown table's line; an escaped pipe belongs to its cell, an escaped backslash does not escape."""
    inner = F.regexp_replace(F.trim(line), r"^\|", "")
    marked = F.regexp_replace(F.regexp_replace(inner, r"\\\\", "\u0001"), r"\\\|", "\u0002")
    cells = F.split(F.regexp_replace(marked, r"\|$", ""), r"\|", -1)
    return F.transform(cells, lambda c: F.trim(F.translate(F.replace(c, F.lit("\u0001"), F.lit("\\")), "\u0002", "|")))
