"""Redaction of personal data and secrets as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9][0-9() .-]{7,}[0-9]"
PROFILE = r"https?://(www\.)?(linkedin\.com/in|github\.com)/[A-Za-z0-9_-]+"
SECRET = r"(sk-|ghp_|gho_|xox[abp]-|AKIA)[A-Za-z0-9_-]{8,}"
KEYED = r"(?i)(password|passwd|secret|token|api[_-]?key)(\s*[:=]\s*)[^\s,;]{8,}"
HOME = r"(/home/|/Users/)[A-Za-z0-9._-]+"


def redacted(text: Column) -> Column:
    """E-mail addresses, profile URLs and phone numbers, by placeholders."""
    for pattern, mark in ((EMAIL, "[EMAIL]"), (PROFILE, "[PROFILE]"), (PHONE, "[PHONE]")):
        text = F.regexp_replace(text, pattern, mark)
    return text


def scrubbed(text: Column) -> Column:
    """Vendor tokens and keyed secrets masked, home folders as ~."""
    text = F.regexp_replace(text, SECRET, "[SECRET]")
    text = F.regexp_replace(text, KEYED, "$1$2[SECRET]")
    return F.regexp_replace(text, HOME, "~")


def tokenised(text: Column, values: list[str]) -> Column:
    """Known values by PRIVACY_VALUE_n, the longest first, numbered in the given order; a longer value is never cut by a shorter one."""
    numbers = {v: i for i, v in enumerate(dict.fromkeys(v for v in values if v), 1)}
    for value in sorted(numbers, key=lambda v: (-len(v), v)):
        text = F.replace(text, F.lit(value), F.lit(f"PRIVACY_VALUE_{numbers[value]}"))
    return text
