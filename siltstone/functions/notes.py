"""Fields that free notes of an application state: place, work mode, pay, posting day, last contact; and a report's score and warnings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import location as canonical_location
from .urls import let

# Currencies of notes: signs stand before an amount, codes before or after it (fixed values).
SIGNS = ("$", "€", "£", "¥", "₹", "₺", "₩", "zł", "₴")
CODES = ("CHF", "EUR", "USD", "GBP", "PLN", "UAH", "JPY", "CNY", "INR", "BRL", "SEK", "NOK", "DKK", "TRY", "KRW", "AUD", "CAD", "MXN", "SGD", "HKD", "ZAR")
# Two-letter states (fixed values).
STATES = "A[KLRZ]|C[AOT]|D[CE]|FL|GA|HI|I[ADLN]|K[SY]|LA|M[ADEINOST]|N[CDEHJMVY]|O[HKR]|PA|RI|S[CD]|T[NX]|UT|V[AT]|W[AIVY]"
# Towns that name a place by themselves (fixed values).
TOWNS = (
    "Porto|Lisbon|London|Berlin|Munich|Hamburg|Frankfurt|Cologne|D(?:ü|u)sseldorf|Stuttgart|Z(?:ü|u)rich|Geneva|Lausanne|Basel|Dublin|Cork|Amsterdam|Rotterdam|Eindhoven|Utrecht|Paris|Lyon|Madrid|Barcelona|"
    "Valencia|Stockholm|Gothenburg|Malm(?:ö|o)|Copenhagen|Oslo|Helsinki|Milan|Rome|Turin|Vienna|Brussels|Ghent|Antwerp|Luxembourg|Warsaw|Krak(?:ó|o)w|Wroc(?:ł|l)aw|Tallinn|Riga|Vilnius|Prague|Brno|Budapest|"
    "Bucharest|Sofia|Athens|Bengaluru|Bangalore|Singapore|Sydney|Toronto|Vancouver|Tel Aviv|S(?:ã|a)o Paulo"
)
_SIGN = "|".join(s.replace("$", r"\$") for s in SIGNS)
_BEFORE = f"{_SIGN}|(?:{'|'.join(CODES)}) ?"
_AMOUNT = r"\d[\d,]*(?:\.\d+)?[KkMmBb]?"
#: A currency and an amount or range; or an amount, not within a word, and its currency; without what describes a company's money.
_FIRST = "".join(sorted({s[0] for s in (*SIGNS, *CODES)}))
_SPAN = (
    # Few characters can begin one; at the others no alternative is tried.
    rf"(?=[~\d{_FIRST}])(?:~?(?:{_BEFORE})\s*{_AMOUNT}(?:\s*[-–]\s*(?:{_BEFORE})?{_AMOUNT})?|(?<![\p{{L}}\p{{N}}])~?{_AMOUNT}(?:\s*[-–]\s*{_AMOUNT})?\s+(?:{_SIGN}|{'|'.join(CODES)}))"
)
#: A span with the word of funding that follows, if one does; and what such a match ends with.
_SPAN_OF = rf"{_SPAN}(?:\s*(?i:valuation|(?:total\s+)?raised|series\s|round\b))?"
_FUNDING = r"(?i)(?:valuation|raised|series\s|round)\z"
_POSTED = r"(?im)(^|[;|])[^\S\n]*posted(?::[^\S\n]*|[^\S\n]+)(20\d{2}-\d{2}-\d{2})\b"
_DAY = r"\b20\d{2}-\d{2}-\d{2}\b"


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def stated_place(notes: Column, role: Column, given: Column) -> Column:
    """A given place; else "Location: ...", "City, ST" or a known town of the notes, or of the role; '' for none."""
    named = rf"\b([A-Z][A-Za-z.'-]+(?: [A-Z][A-Za-z.'-]+){{0,2}}),? ({STATES})\b"
    city = lambda c: F.when(c.rlike(named), F.concat(F.regexp_extract(c, named, 1), F.lit(", "), F.regexp_extract(c, named, 2)))
    town = lambda c: F.nullif(F.regexp_extract(c, rf"(?i)\b({TOWNS})\b", 1), F.lit(""))
    label = F.nullif(F.regexp_extract(_text(notes), r"(?i)\blocation:\s*([^;\n]+)", 1), F.lit(""))
    found = F.coalesce(label, city(_text(notes)), city(_text(role)), town(_text(notes)), town(_text(role)))
    return F.when(_text(given) != "", given).otherwise(F.coalesce(let(found, canonical_location), F.lit("")))


def stated_mode(notes: Column, role: Column, place: Column) -> Column:
    """Hybrid before RemoteFlex before Remote before Full; a place without a word about it is Full; '' for nothing."""
    all_ = F.lower(F.concat_ws(" ", _text(role), _text(notes), _text(place)))

    def named(a: Column) -> Column:
        flexible = a.contains("remote") & a.rlike("flex|remote[- ]first")
        return F.when(a.contains("hybrid"), "Hybrid").when(flexible, "RemoteFlex").when(a.contains("remote"), "Remote").when(a.rlike("onsite|on-site|in-office"), "Full")

    return F.coalesce(let(all_, named), F.when(_text(place) != "", "Full"), F.lit(""))


def pay_spans(notes: Column) -> Column:
    """Spans of pay in order; a span before a word of funding describes a company and is left out."""
    return F.filter(F.regexp_extract_all(_text(notes), F.lit(_SPAN_OF), F.lit(0)), lambda s: ~s.rlike(_FUNDING))


def pay_ceiling(span: Column) -> Column:
    """The largest amount of a span, with k, m and b; 0 without one."""
    parts = F.regexp_extract_all(_text(span), F.lit(r"\d[\d,]*(?:\.\d+)?\s*[KkMmBb]?"), F.lit(0))
    unit = lambda p: F.when(p.rlike("[Kk]$"), 1e3).when(p.rlike("[Mm]$"), 1e6).when(p.rlike("[Bb]$"), 1e9).otherwise(1.0)
    return F.coalesce(F.array_max(F.transform(parts, lambda p: F.regexp_replace(p, r"[,\sKkMmBb]", "").try_cast("double") * unit(p))), F.lit(0.0))


def note_fields(notes: Column, role: Column, place: Column, applied: Column) -> Column:
    """(place, mode, pay, pay_max, pay_source, posted_on, last_contact) of one application's notes.

    The first range is the pay, else the first amount.  The latest posting day counts, and it
    is no contact; the last contact is the latest other day, or the day of the application.
    """
    all_ = F.lower(F.concat_ws(" ", _text(role), _text(notes), _text(place)))
    pay = let(pay_spans(notes), lambda spans: F.coalesce(F.get(F.filter(spans, lambda s: s.rlike("[-–]")), 0), F.get(spans, 0), F.lit("")))
    source = let(all_, lambda a: F.when(a.contains("(posted"), "POSTED").when(a.rlike(r"\(est[),;. ]|\best\)|\bmarket\b"), "est"))
    posted = F.array_max(F.regexp_extract_all(_text(notes), F.lit(_POSTED), F.lit(2)))
    contact = F.regexp_extract_all(F.regexp_replace(_text(notes), _POSTED, "$1"), F.lit(_DAY), F.lit(0))
    where = stated_place(notes, role, place)
    money = let(pay, lambda p: F.struct(p.alias("span"), pay_ceiling(p).alias("max"), F.when(p != "", source).alias("source")))

    def fields(found: Column) -> Column:
        place_, pay_ = found["place"], found["money"]
        return F.struct(
            place_.alias("place"), stated_mode(notes, role, place_).alias("mode"), pay_["span"].alias("pay"), pay_["max"].alias("pay_max"), pay_["source"].alias("pay_source"), posted.alias("posted_on"),
            F.greatest(F.array_max(contact), applied.cast("string")).alias("last_contact"),
        )

    return let(F.struct(where.alias("place"), money.alias("money")), fields)


def report_score(text: Column) -> Column:
    """The score of a report: its summary's, else its header's, else its machine part's; null without any."""
    one = lambda pattern: F.regexp_extract(_text(text), pattern, 1).try_cast("double")
    return F.coalesce(one(r"(?m)^SCORE:\s*(\d+(?:\.\d+)?)\s*$"), one(r"(?m)^\*\*Score:\*\*\s*(\d+(?:\.\d+)?)\s*/\s*5\s*$"), one(r"(?m)^score:\s*[\"']?(\d+(?:\.\d+)?)[\"']?\s*$"))


def has_hard_stop(text: Column) -> Column:
    """Whether a report lists something under ``hard_stops``, as lines or in brackets."""
    return _text(text).rlike(r"hard_stops:[^\S\n]*\n[ \t]+-[ \t]*\S") | _text(text).rlike(r"hard_stops:\s*\[[^\]]*[^\]\s][^\]]*\]")


def is_suspicious(text: Column) -> Column:
    return _text(text).rlike(r"(?i)legitimacy_tier:\s*[\"']?Suspicious[\"']?") | _text(text).rlike(r"(?im)^(?:LEGITIMACY:|\*\*Legitimacy:\*\*)\s*Suspicious\s*$")


# Levels of a text by its words, from the lowest on (fixed values), and what follows such a word where it is none (fixed values).
LEVEL_WORDS = (("intern", "实习", "实习生", "应届"), ("junior", "初级"), ("mid", "中级"), ("senior", "高级", "资深"), ("staff", "principal", "lead", "负责人"))
NO_LEVEL_BEFORE = {
    "principal": "responsibilities|responsibility|duties|accountabilities|objectives|purpose|tasks|activities",
    "lead": "to|the|a|an|our|and|or|by|on|in|for|with|from|mentoring|projects",
    "mid": "market|size|sized|cap|tier|funnel|term|sized-company",
}


def text_levels(text: Column) -> Column:
    """The levels, 0 to 4, that a text names; "principal duties" and "lead the team" name none."""
    lower = F.lower(_text(text))

    def named(word: str) -> Column:
        if not word.isascii():
            return lower.contains(word)
        after = f"(?![^a-z0-9]*(?:{NO_LEVEL_BEFORE[word]})(?![a-z0-9-]))" if word in NO_LEVEL_BEFORE else ""
        return lower.rlike(rf"(?:^|[^a-z0-9]){word}(?![a-z0-9]){after}")

    found = []
    for level, words in enumerate(LEVEL_WORDS):
        any_ = named(words[0])
        for word in words[1:]:
            any_ = any_ | named(word)
        found.append(F.when(any_, F.lit(level)))
    return F.array_compact(F.array(*found))


def reuse_decision(new: Column, old: Column, similarity: Column, high: float = 0.72, medium: float = 0.45) -> Column:
    """(decision, reason) for an earlier text: another single level means writing anew, whatever the similarity."""
    a, b = text_levels(new), text_levels(old)
    mismatch = (F.size(a) == 1) & (F.size(b) == 1) & (F.get(a, 0) != F.get(b, 0))
    result = lambda d, r: F.struct(F.lit(d).alias("decision"), F.lit(r).alias("reason"))
    return (
        F.when(mismatch, result("regenerate", "level-mismatch")).when(similarity >= high, result("reuse", "high-similarity"))
        .when(similarity >= medium, result("reuse-with-edits", "medium-similarity")).otherwise(result("regenerate", "low-similarity"))
    )
