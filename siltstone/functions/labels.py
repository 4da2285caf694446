"""Labels read off cells: outcomes, import stages, stamps, levels, acronyms, slugs, tones, headers, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import canonical_status, first_rule

# Canonical outcomes, and the outcome of each alias (fixed values).
OUTCOMES = ("interview_progress", "interview_only", "offer_received", "hired", "offer_declined", "rejected", "no_response")
OUTCOME_ALIASES = {
    "stage_reached": "interview_progress", "interview": "interview_progress", "offer": "offer_received", "accepted": "hired", "declined": "offer_declined",
    "rejection": "rejected", "ghosted": "no_response",
}
# Stages of other trackers (fixed values); "" is a row that was never sent.
FOREIGN_STAGES = {
    "bookmarked": "", "wishlist": "", "saved": "", "interested": "", "applying": "", "to apply": "", "not applied": "", "submitted": "APPLIED",
    "screen": "RESPONDED", "phone screen": "RESPONDED", "recruiter screen": "RESPONDED", "interviewing": "INTERVIEW", "final round": "INTERVIEW",
    "negotiating": "OFFER", "offer received": "OFFER", "not selected": "REJECTED", "no response": "DISCARDED", "ghosted": "DISCARDED",
    "withdrawn": "DISCARDED", "archived": "DISCARDED",
}
STAGES = ("EVALUATED", "SPECULATIVE", "APPLIED", "RESPONDED", "ASSESSMENT", "INTERVIEW", "OFFER", "REJECTED", "DISCARDED", "SKIP", "HIRED")
# Level tokens of titles (fixed values).
LEVELS = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "1": 1, "2": 2, "3": 3, "4": 4, "5": 5, "6": 6}
# Capitals that are no acronyms of a field (fixed values).
NO_ACRONYMS = ("ALL", "AND", "FOR", "THE", "NEW", "FTE", "PTE", "LLC", "INC", "LTD", "SR", "JR", "II", "III", "IV", "VI")
# Words of a doubtful posting in four languages (fixed values).
DOUBTS = "caut|precau|suspic|sospech|scam|fake|dikkatli|şüpheli|谨慎|審慎|疑似"
#: Labels of a scored posting, in order of display.
APPLY_LABELS = ("Recommended", "Check the posting first", "Below the apply line", "Not scored yet")


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _clean(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value, F.lit(""))))


def outcome(raw: Column) -> Column:
    """Canonical outcome of a name or alias, hyphens as underscores; null for others."""
    key = F.regexp_replace(_clean(raw), "-", "_")
    return F.when(key.isin(*OUTCOMES), key).otherwise(F.try_element_at(_map(OUTCOME_ALIASES), key))


def import_stage(raw: Column) -> Column:
    """Stage of an imported row: blank is APPLIED; own stages and aliases first, then those of other trackers; null for others."""
    key, own = _clean(raw), canonical_status(raw)
    return F.when(key == "", "APPLIED").when(own.isin(*STAGES), own).otherwise(F.try_element_at(_map(FOREIGN_STAGES), key))


def rank_stamp(raw: Column) -> Column:
    """(score, reason) of a stamp like 4/5 - reason; null without a reason."""
    pattern = r"([0-9]+(?:\.[0-9]+)?)\s*/\s*5\s*[—–-]\s*(\S.*)"
    text = F.trim(F.coalesce(raw, F.lit("")))
    found = F.struct(F.regexp_extract(text, pattern, 1).try_cast("double").alias("score"), F.trim(F.regexp_extract(text, pattern, 2)).alias("reason"))
    return F.when(text.rlike(pattern), found)


def levels(title: Column) -> Column:
    """Sorted levels (1 to 6, Roman or Arabic) that stand as words of their own in a title."""
    spaced = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[\s,()/\-–—]+", "  ")
    tokens = F.regexp_extract_all(F.concat(F.lit(" "), spaced, F.lit(" ")), F.lit(r" (?:level |lvl |grade |tier )?(i{1,3}|iv|vi?|[1-6])(?= )"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(tokens, lambda x: F.element_at(_map(LEVELS), x))))


def acronyms(title: Column) -> Column:
    """Two or three capitals that stand alone; none where the whole title is in capitals."""
    text = F.coalesce(title, F.lit(""))
    found = F.regexp_extract_all(text, F.lit("(?<![A-Za-z0-9])([A-Z]{2,3})(?![A-Za-z0-9])"), F.lit(1))
    kept = F.array_sort(F.array_distinct(F.filter(found, lambda w: ~w.isin(*NO_ACRONYMS))))
    return F.when(text.rlike(r"[\p{L}&&[^\p{Lu}]]"), kept).otherwise(F.array().cast("array<string>"))


def coverage_band(share: Column) -> Column:
    """Of a percentage of keywords: strong from 75, partial from 50, else weak."""
    return F.when(share >= 75, "strong").when(share >= 50, "partial").when(share.isNotNull(), "weak")


def from_header(value: Column) -> Column:
    """(name, email) of a From header; the e-mail in lower case, null if it is none."""
    text, mail = F.trim(F.coalesce(value, F.lit(""))), r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
    angle = r'^"?([^"<]*?)"?\s*<([^<>]+)>$'
    inside = F.trim(F.regexp_extract(text, angle, 2))
    name = F.when(text.rlike(angle), F.trim(F.regexp_extract(text, angle, 1))).when(text.rlike(mail), "").otherwise(text)
    address = F.when(text.rlike(angle), inside).otherwise(text)
    return F.struct(name.alias("name"), F.when(address.rlike(mail), F.lower(address)).alias("email"))


def contact_type(text: Column) -> Column:
    rules = [(r"\bhiring manager\b", "hiring-manager"), (r"\b(interview panel|interview team|panelist|panellist|interviewer)\b", "interviewer")]
    return first_rule(_clean(text), rules, "recruiter")


def slug(name: Column) -> Column:
    """Letters and digits of a name without accents, joined by hyphens; null if there are none."""
    plain = F.translate(F.lower(F.coalesce(name, F.lit(""))), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.nullif(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-|-$", ""), F.lit(""))


def placeholder(cell: Column) -> Column:
    """A cell that names nothing."""
    return _clean(cell).isin("", "-", "—", "–", "?", "n/a", "na", "none", "unknown", "tbd", "confidential")


def flagged(legitimacy: Column) -> Column:
    return F.lower(F.coalesce(legitimacy, F.lit(""))).rlike(DOUBTS)


def apply_label(score: Column, legitimacy: Column) -> Column:
    """From 4.0 recommended, or to be checked first if flagged; below the line, or not scored."""
    return F.when(score.isNull(), APPLY_LABELS[3]).when(score < 4, APPLY_LABELS[2]).when(flagged(legitimacy), APPLY_LABELS[1]).otherwise(APPLY_LABELS[0])


def fit_tone(cell: Column) -> Column:
    """good, warn or bad by a short cell's first word."""
    text = _clean(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\*+", ""))
    tone = (
        F.when(text.rlike(r"^(gap|missing)\b|^fail"), "bad").when(text.rlike(r"^(strong|exceeds|excellent)\b"), "good").when(text.rlike(r"^(adjacent|partial|adequate|ok)\b"), "warn")
    )
    return F.when(F.length(text) <= 48, tone)


def token_value(text: Column) -> Column:
    """Tokens of 12.3k or 1,234; 0 for anything else."""
    value = F.regexp_replace(_clean(text), ",", "")
    thousands = F.round(F.regexp_extract(value, r"^([0-9]+(?:\.[0-9]+)?)k$", 1).try_cast("double") * 1000).cast("long")
    return F.coalesce(thousands, F.regexp_extract(value, "^([0-9]+)", 1).try_cast("long"), F.lit(0).cast("long"))


def href(*cells: Column) -> Column:
    """The link of the first cell that has one: a bare URL, or the target of its first Markdown link."""
    web = r"^https?://[^\s<>\"]+$"
    target = r"\]\((https?://[^)\s]+)"
    text = [F.trim(F.coalesce(c, F.lit(""))) for c in cells]
    return F.coalesce(*[F.when(c.rlike(web), c).otherwise(F.nullif(F.regexp_extract(c, target, 1), F.lit(""))) for c in text])


def receipt(app: Column, message: Column, state: Column) -> Column:
    """SHA-256 of the three as a compact JSON array."""
    return F.sha2(F.to_json(F.array(*[c.cast("string") for c in (app, message, state)])), 256)


def status_cleanup(raw: Column) -> Column:
    """(status, note) of a status cell that says more than a stage: duplicates, dates and text in brackets go to the note."""
    text = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\*\*", ""))
    head = F.trim(F.regexp_extract(text, r"^([^0-9(]*)", 1))
    rest = F.trim(F.regexp_extract(text, r"^[^0-9(]*(.*)$", 1))
    duplicate = text.rlike("(?i)^(duplicado|duplicate|dup|repost)")
    return F.struct(
        F.when(duplicate, F.lit("DISCARDED")).otherwise(canonical_status(head)).alias("status"), F.when(duplicate, text).otherwise(rest).alias("note")
    )
