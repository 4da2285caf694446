"""Ordered decisions kept as codes: why a posting was missed, what a reply says of an application."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """One row of a decision table: its code, when it decides, and what to do then."""

    code: str
    holds: Column
    advice: Column


def decided(steps: list[Step], otherwise: str) -> Column:
    """(code, advice, place) of the first step that holds, as one expression; a null condition does not hold."""
    result = lambda code, advice, k: F.struct(F.lit(code).alias("code"), advice.alias("advice"), F.lit(k).alias("place"))
    out = result(otherwise, F.lit("none"), len(steps))
    for k, step in reversed(list(enumerate(steps))):
        out = F.when(F.coalesce(step.holds, F.lit(False)), result(step.code, step.advice, k)).otherwise(out)
    return out


#: What a diagnosis may say, in the order in which it is asked (fixed values).
GAPS = (
    "surfaced", "filtered", "tracked-disabled", "tracked-no-provider", "tracked-title-filter", "tracked-location-filter", "tracked-not-seen", "untracked-unsupported-ats", "untracked",
)


def coverage(postings: DataFrame, history: DataFrame, entries: DataFrame, scanned: DataFrame, title_ok: Column, location_ok: Column) -> DataFrame:
    """(n, code, advice, entry, other_board): why no scanner brought each posting (n, key, company, vendor, slug, title, location, url).

    ``history`` (key, seen_on, status) says what scanners did with a job, the first sighting
    counts; ``entries`` (entry, company, vendor, slug, enabled, provider) are the tracked
    companies, found by board, else by company, of several the least; ``scanned`` (company) are those
    that a scanner without entries has met.  ``title_ok`` and ``location_ok`` are the filters' verdicts; a
    posting without a location passes.  All joins are by key, on sides with one row a key.
    """
    first = history.where("key != ''").groupBy("key").agg(F.min_by("status", F.struct("seen_on", "status")).alias("seen_status"))
    facts = F.struct("entry", F.col("vendor").alias("their_vendor"), F.col("slug").alias("their_slug"), "enabled", "provider")
    by_board = entries.where("vendor IS NOT NULL AND slug IS NOT NULL").groupBy("vendor", "slug").agg(F.min_by(facts, "entry").alias("board_entry"))
    by_name = entries.where("company IS NOT NULL").groupBy("company").agg(F.min_by(facts, "entry").alias("name_entry"))
    met = scanned.where("company IS NOT NULL").select("company").distinct().withColumn("scanned", F.lit(True))
    rows = postings.join(first, "key", "left").join(by_board, ["vendor", "slug"], "left").join(by_name, "company", "left").join(met, "company", "left")
    e = F.coalesce("board_entry", "name_entry")
    tracked = e.isNotNull()
    board = F.concat_ws(":", "vendor", "slug")
    other = tracked & F.col("slug").isNotNull() & ~(e["their_vendor"].eqNullSafe(F.col("vendor")) & e["their_slug"].eqNullSafe(F.col("slug")))
    located = F.coalesce(F.trim("location"), F.lit("")) != ""
    steps = [
        Step("surfaced", F.col("seen_status") == "added", F.lit("none")),
        Step("filtered", F.col("seen_status").isNotNull(), F.when(F.col("seen_status").isin("skipped_title", "skipped_location"), F.regexp_replace("seen_status", "^skipped_", "")).otherwise("none")),
        Step("tracked-disabled", tracked & ~F.coalesce(e["enabled"], F.lit(True)), F.lit("enable")),
        Step("tracked-no-provider", tracked & e["provider"].isNull() & F.col("scanned").isNull(), F.when(F.col("slug").isNotNull(), F.concat(F.lit("point at "), board)).otherwise("search only")),
        Step("tracked-title-filter", tracked & ~title_ok, F.lit("title")),
        Step("tracked-location-filter", tracked & located & ~location_ok, F.lit("location")),
        Step("tracked-not-seen", tracked, F.when(other, F.concat(F.lit("point at "), board)).otherwise("none")),
        Step("untracked-unsupported-ats", F.col("slug").isNull(), F.lit("add by careers page")),
    ]
    found = rows.withColumn("found", decided(steps, "untracked"))
    advice = F.when(F.col("found.code") != "untracked", F.col("found.advice")).when(title_ok, F.concat(F.lit("add "), board)).otherwise("add with a title keyword")
    return found.select("n", F.col("found.code").alias("code"), advice.alias("advice"), e["entry"].alias("entry"), other.alias("other_board"))


@dataclass(frozen=True)
class Sign:
    """One kind of evidence: its weight, where it shows, whether it is strong; a veto counts only where no `inviting` sign shows."""

    weight: int
    shows: Column
    strong: bool = False
    inviting: bool = False
    veto: bool = False


def evidence(signs: dict[str, Sign], least: int = 4) -> Column:
    """(score, strong, reasons, vetoed, accepted) of weighted signs.

    Vetoes are left out as soon as an inviting sign shows.  Accepted needs the least score
    and a strong or inviting sign.
    """
    no = F.lit(False)
    shown = {name: F.coalesce(s.shows, no) for name, s in signs.items()}
    inviting = no
    for name, s in signs.items():
        if s.inviting:
            inviting = inviting | shown[name]
    counted = {name: shown[name] & ~inviting if s.veto else shown[name] for name, s in signs.items()}
    score, strong, vetoed = F.lit(0), F.lit(0), no
    for name, s in signs.items():
        score = score + F.when(counted[name], s.weight).otherwise(0)
        strong = strong + F.when(counted[name] & F.lit(s.strong), 1).otherwise(0)
        vetoed = vetoed | (counted[name] & F.lit(s.veto))
    reasons = F.array_compact(F.array(*[F.when(counted[name], F.lit(f"{s.weight:+d} {name}")) for name, s in signs.items()]))
    return F.struct(score.alias("score"), strong.alias("strong"), reasons.alias("reasons"), vetoed.alias("vetoed"), ((score >= least) & ((strong > 0) | inviting)).alias("accepted"))


# Wordings of mails about interviews, in two languages (fixed values).
_DIRECT = (
    r"(would|'d) (like|love) to invite you|(we are|we're) (happy|pleased|delighted|excited) to invite you|i (would like|want) to invite you"
    r"|invite you (to|for) (an? |the |your )?(first |initial |second |2nd |next |virtual |video |personal |short )*(interview|call|chat|conversation|meeting|round|get[- ]to[- ]know)"
    r"|(m(ö|oe)chten|w(ü|ue)rden) (sie|dich) (gern|gerne)? ?(zu|zum|für)? ?[^.]{0,60}einladen|laden (sie|dich) (gern|gerne)? ?[^.]{0,40}ein"
    r"|(please|kindly) (select|choose|pick|book) (a|your|the)? ?(time|slot|date)|schedule (your|a|an) (chat|call|interview|meeting)|i am confirming your interview|thank you for scheduling"
    r"|looking forward to (meeting|speaking with|talking to) you (on|at)"
)
_SUBJECT_INVITE = r"(?i)(invitation|einladung|invite)\s+(to|for|zu|zum|zur)\b[^|]{0,40}(interview|gespr(ä|ae)ch|call|meeting|conversation|kennenlernen|chat)|interview[- ]?(invitation|einladung|request)|your (upcoming )?interview with|(intro|initial|first|1st|second|2nd|third|3rd|next|final)[- ](call|conversation|interview|round|meeting|chat|gespr(ä|ae)ch)|(erst|kennenlern|vorstellungs)gespr(ä|ae)ch"
_SUBJECT_TOPIC = r"(?i)interview|intro|call|chat|meet|kennenlern|gespr(ä|ae)ch|einladung|invitation|termin|round|runde|screening|conversation|get to know"
_NOREPLY = r"(?i)no-?reply|do-?not-?reply|notifications?@|mailer|jobs?@|careers?@|recruiting@|talent@|hr@|bewerbung@|-jobs@"
_AVAILABILITY = r"(?i)your availability|available (for|on)|suitable (time|date|slot)|time slots?|which (time|date) (works|suits)|let (me|us) know (when|if) you|terminvorschl(ä|ae)g|zeitfenster|passt (es )?(ihnen|dir)|verfügbarkeit"
_RECEIPT = r"(?i)received your application|we('ve| have) (got|received) (it|your application)|thank(s| you) for (your )?(applying|application)|application (was|has been) (sent|received|submitted)|(bewerbung|unterlagen)[^.]{0,40}(eingegangen|erhalten)|eingangsbestätigung|vielen dank für (ihre|deine) bewerbung|successfully (received|submitted)"
_CONDITIONAL = r"if (there('s| is) a (match|fit)|your (profile|experience|background) (matches|fits|is a match)|we (see|think) (a|there is a) (match|fit)|you('re| are) (shortlisted|selected))|should (your|we|there)|in case (your|we)|(sollte|sollten|falls|wenn) (ihr|dein|wir|sie|du)[^.]{0,40}(passen|profil|überzeug|interesse)|we('ll| will) (be in touch|contact you|reach out|get back)|our (hiring |recruiting )?process|next steps? (in our process|would be|are)|here is a (quick )?look at our process|we will invite"
_MEETING = r"(?i)https?://([a-z0-9-]+\.)*(teams\.microsoft\.com/l/meetup-join/|teams\.live\.com/meet/|meet\.google\.com/[a-z]{3}-[a-z]{4}-[a-z]{3}\b|zoom\.us/(j|my|w)/|webex\.com/(meet|join)|whereby\.com/[^/\s]+)"


def invitation(subject: Column, body: Column, sender: Column, calendar: Column, booking: Column, proposed: Column) -> Column:
    """How much a mail reads like an invitation to talk; a subject, calendar part, booking link or proposed time is strong.

    A wording inside a condition ("if there is a match we would like to invite you") is no invitation, and receipts and
    conditions count against a mail only where nothing invites.
    """
    subject, body, sender = (F.coalesce(c, F.lit("")) for c in (subject, body, sender))
    whole = F.concat(F.trim(subject), F.lit("\n"), body)
    sentences = F.split(F.lower(whole), r"(?<=[.!?])\s+|\n+")
    direct = F.exists(sentences, lambda s: ~s.rlike(_CONDITIONAL) & s.rlike(_DIRECT))
    receipt = whole.rlike(_RECEIPT)
    in_subject = subject.rlike(_SUBJECT_INVITE) & ~subject.rlike(_RECEIPT)
    name = F.trim(F.regexp_extract(sender, '^"?([^"<]+?)"?\\s*<', 1))
    return evidence(
        {
            "calendar invite": Sign(3, calendar, strong=True, inviting=True),
            "proposed time": Sign(3, proposed, strong=True, inviting=True),
            "invite in the subject": Sign(3, in_subject, strong=True, inviting=True),
            "booking link": Sign(3, booking, strong=True, inviting=True),
            "direct invitation": Sign(2, direct, inviting=True),
            "subject about an interview or call": Sign(2, ~in_subject & subject.rlike(_SUBJECT_TOPIC) & ~subject.rlike(_RECEIPT)),
            "sent by a person": Sign(2, ~sender.rlike(_NOREPLY) & name.rlike(r"^[A-ZÄÖÜ][\wäöüß'-]+[ ,]+[A-ZÄÖÜ]")),
            "video-meeting link": Sign(1, body.rlike(_MEETING)),
            "participants named": Sign(1, whole.rlike(r"\b(with|mit|mit herrn|mit frau)\s+[A-ZÄÖÜ][a-zäöüß]+")),
            "asks for availability": Sign(1, whole.rlike(_AVAILABILITY)),
            "application receipt wording": Sign(-3, receipt, veto=True),
            "conditional wording": Sign(-3, F.exists(sentences, lambda s: s.rlike(_CONDITIONAL)), veto=True),
        }
    )


def transitions(proposals: DataFrame) -> DataFrame:
    """(num, verdict, old_status, new_status, proposals, choices): one row for each application of proposals (num, old_status, new_status).

    One distinct transition is an update, however often it is proposed; several are a
    conflict, listed as choices and left to a person.
    """
    each = proposals.groupBy("num", "old_status", "new_status").agg(F.count("*").alias("n"))
    per = each.groupBy("num").agg(F.count("*").alias("kinds"), F.sum("n").alias("proposals"), F.min(F.struct("old_status", "new_status")).alias("one"), F.array_sort(F.collect_list(F.concat_ws(" -> ", F.coalesce("old_status", F.lit("")), F.coalesce("new_status", F.lit(""))))).alias("all"))
    single = F.col("kinds") == 1
    return per.select(
        "num", F.when(single, "update").otherwise("conflict").alias("verdict"), F.when(single, F.col("one.old_status")).alias("old_status"), F.when(single, F.col("one.new_status")).alias("new_status"),
        "proposals", F.when(single, F.array().cast("array<string>")).otherwise(F.col("all")).alias("choices"),
    )
