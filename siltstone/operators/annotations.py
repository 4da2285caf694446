"""Sentences with their places, and what detectors find in them.

Later steps read annotations, not texts: a row for each sentence and detector, with the
place of the words that matched and a quote of at most EVIDENCE characters around them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import slices

#: Most characters of a quote.
EVIDENCE = 240
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


@dataclass(frozen=True)
class Detector:
    """A sentence counts if it matches `focus` and every one of `also`; with `near`, that must match from the focus up to `reach` characters after it."""

    focus: str
    also: tuple[str, ...] = ()
    near: str | None = None
    reach: int = 80


@dataclass(frozen=True)
class Point:
    """present: a sentence of each of `strong`, or `many` of the first; else partial: a sentence of any of `strong` or `weak`; else missing."""

    strong: tuple[str, ...]
    weak: tuple[str, ...] = ()
    many: int = 1


def _pieces(text: str) -> Iterator[tuple[int, int]]:
    """(begin, end) of sentences: lines, then parts after a full stop, trimmed."""
    at = 0
    for line in text.split("\n"):
        start = at
        for gap in (*_SENTENCE_END.finditer(line), None):
            stop = at + (gap.start() if gap else len(line))
            body = text[start:stop]
            if body.strip():
                begin = start + len(body) - len(body.lstrip())
                yield begin, begin + len(body.strip())
            start = at + gap.end() if gap else stop
        at += len(line) + 1


def _sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        at, numbers, begins, ends, texts = [], [], [], [], []
        for k, text in enumerate(batch.column("text").to_pylist()):
            for n, (begin, end) in enumerate(_pieces(text or "")):
                at.append(k)
                numbers.append(n)
                begins.append(begin)
                ends.append(end)
                texts.append(text[begin:end])
        columns = [batch.column("id").take(pa.array(at, pa.int64())), pa.array(numbers, pa.int64()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64()), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "sentence", "begin", "end", "text"])


def sentences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sentence, begin, end, text): sentences by number from 0, places in characters from 0."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fields = [base.schema["id"], *(T.StructField(c, T.LongType()) for c in ("sentence", "begin", "end")), base.schema["text"]]
    return base.mapInArrow(_sentences, T.StructType(fields))


def quote(text: Column, at: Column, length: Column) -> Column:
    """At most EVIDENCE characters of a sentence, around its match (at from 1)."""
    room = F.greatest(F.lit(0), EVIDENCE - F.least(length, F.lit(EVIDENCE)))
    start = F.least(F.greatest(F.lit(0), at - 1 - F.floor(room / 2)), F.length(text) - EVIDENCE)
    return F.when(F.length(text) <= EVIDENCE, text).otherwise(F.substring(text, (start + 1).cast("int"), F.lit(EVIDENCE)))


def _ascii_edges(pattern: str) -> str:
    """The pattern with word edges between ASCII words, as ``\\w`` has them; Java's own edges also see other letters."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def annotate(rows: DataFrame, detectors: dict[str, Detector]) -> DataFrame:
    """(id, sentence, detector, begin, end, evidence) for every sentence that a detector accepts, with its first match's place."""
    text = F.col("text")

    def entry(name: str, d: Detector) -> Column:
        focus = _ascii_edges(d.focus)
        found = F.regexp_extract(text, focus, 0)
        # Places of Spark's regexp_instr count UTF-16 units; the text before the match counts characters.
        at = F.length(F.split(text, focus, 2)[0]) + 1
        # Without its edges a pattern is quicker and finds no less, so most sentences end there.
        good = text.rlike(d.focus.replace(r"\b", "")) & text.rlike(focus)
        for pattern in d.also:
            good = good & text.rlike(_ascii_edges(pattern))
        if d.near:
            good = good & F.substring(text, at, F.length(found) + d.reach).rlike(_ascii_edges(d.near))
        return F.when(good, F.struct(F.lit(name).alias("detector"), at.alias("at"), F.length(found).alias("length")))

    hits = rows.select("id", "sentence", "begin", "text", F.explode(F.array_compact(F.array(*(entry(n, d) for n, d in detectors.items())))).alias("x"))
    begin = F.col("begin") + F.col("x.at") - 1
    return hits.select("id", "sentence", F.col("x.detector").alias("detector"), begin.alias("begin"), (begin + F.col("x.length")).alias("end"), quote(text, F.col("x.at"), F.col("x.length")).alias("evidence"))


def every_match(rows: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(id, sentence, detector, nth, match): all matches of each pattern, not only the first of a sentence."""

    def all_of(name: str, pattern: str) -> Column:
        matches = F.regexp_extract_all("text", F.lit(_ascii_edges(pattern)), F.lit(0))
        return F.transform(matches, lambda m, i: F.struct(F.lit(name).alias("detector"), i.alias("nth"), m.alias("match")))

    found = [all_of(n, p) for n, p in patterns.items()]
    hits = rows.select("id", "sentence", F.explode(F.flatten(F.array(*found))).alias("x")).select("id", "sentence", "x.*")
    return hits.where("match != ''")


def points(annotations: DataFrame, texts: DataFrame, wanted: dict[str, Point], most: int = 2) -> DataFrame:
    """(id, point, status, evidence) for every text (id) and point; evidence lists the first `most` quotes in reading order."""
    status_of = {}
    for name, point in wanted.items():
        for d in (*point.strong, *point.weak):
            status_of.setdefault(d, []).append(name)
    pairs = [F.struct(F.lit(d).alias("detector"), F.lit(p).alias("point")) for d, names in status_of.items() for p in names]
    lookup = F.filter(F.array(*pairs), lambda x: x["detector"] == F.col("detector"))
    rows = annotations.select("id", "sentence", "detector", "evidence", F.explode(lookup["point"]).alias("point"))
    counts = rows.groupBy("id", "point", "detector").agg(F.countDistinct("sentence").alias("n"), F.slice(F.array_sort(F.collect_set(F.struct("sentence", "evidence"))), 1, most).alias("first"))
    grouped = counts.groupBy("id", "point").agg(F.map_from_entries(F.collect_list(F.struct("detector", "n"))).alias("n"), F.flatten(F.collect_list(F.struct("detector", "first"))["first"]).alias("quotes"), F.collect_list("detector").alias("seen"))
    status = F.lit(None).cast("string")
    for name, point in wanted.items():
        enough = [F.coalesce(F.col("n")[F.lit(d)], F.lit(0)) >= (point.many if k == 0 else 1) for k, d in enumerate(point.strong)]
        all_ = enough[0]
        for e in enough[1:]:
            all_ = all_ & e
        status = F.when(F.col("point") == name, F.when(all_, "present").otherwise("partial")).otherwise(status)
    judged = grouped.select("id", "point", status.alias("status"), F.slice(F.transform(F.array_sort(F.array_distinct("quotes")), lambda x: x["evidence"]), 1, most).alias("evidence"))
    every = texts.select("id").distinct().select("id", F.explode(F.array(*map(F.lit, wanted))).alias("point"))
    joined = every.join(judged, ["id", "point"], "left")
    return joined.select("id", "point", F.coalesce("status", F.lit("missing")).alias("status"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"))


def point_counts(judged: DataFrame, ask_from: int = 3) -> DataFrame:
    """(id, present, partial, missing, ask): ask where `ask_from` points or more are missing."""
    n = {s: F.count(F.when(F.col("status") == s, 1)) for s in ("present", "partial", "missing")}
    return judged.groupBy("id").agg(*(c.alias(s) for s, c in n.items())).withColumn("ask", F.col("missing") >= ask_from)


_UNIT = "(?:department|division|team|group|office|unit)"
#: What a posting says of a role, by detector (fixed values).
ROLE_DETECTORS = {
    "reports-to": Detector(
        r"(?iu)(?<![A-Za-z0-9])(?:reports?|reporting)\s+(?:directly\s+)?to[*_]*(?:\s*[:–—][*_]*\s*|\s+-\s*|\s+)[*_]*(?:(?:the|our|a|an)\s+)?"
        r"(?!(?:the|our|a|an|n/a|tb[dca]|none|unknown)(?![\p{L}\p{M}0-9]))\p{L}[\p{L}\p{M}\w&/'-]*"
    ),
    "department": Detector(
        rf"(?i)\b(?:in|within|of|for|from)\s+(?:the\s+)?[\w&\s-]{{2,40}}?\b{_UNIT}\b|\b[A-Z][\w&-]+\s+{_UNIT}\b|\b(?:department|division)\s+of\s+[A-Z]\w+"
    ),
    "supervisor-word": Detector(
        r"(?i)\b(?:supervisor|line\s+manager|manager|director|head\s+of|team\s+lead|lead)\b", (r"(?i)\b(?:under|with|alongside|led\s+by|guidance\s+of|direction\s+of|join(?:ing)?)\b",)
    ),
    "part-of": Detector(rf"(?i)\b(?:join|within|part\s+of)\s+(?:the|our)\s+[\w&\s-]{{2,40}}\b{_UNIT}\b"),
    "named-unit": Detector(rf"(?i)\b{_UNIT}\b", (r"\b[A-Z][\w&-]+\s+(?:Department|Division|Team|Group|Office)\b",)),
    "owned": Detector(
        r"(?i)\b(?:responsible\s+for|accountable\s+for|you\s+will\s+(?:own|lead|manage|run|build|design|develop|deliver|drive|oversee|create|maintain|write|plan)|will\s+(?:own|lead|manage|oversee)|own(?:ing)?\s+the|lead(?:ing)?\s+the|owns?\s+)\b"
    ),
    "duties-heading": Detector(
        r"(?i)^(?:#+\s*)?(?:key\s+|main\s+|core\s+)?(?:responsibilities|duties|what\s+you['’]?ll\s+do|what\s+you\s+will\s+do|the\s+role|scope(?:\s+of\s+work)?|about\s+the\s+role)\s*:?\s*$"
    ),
    "deliverable": Detector(_DELIVERABLE := r"(?i)\b(?:deliverables?|outputs?|you\s+will\s+(?:produce|deliver|publish|write|prepare|ship|launch|create|build|draft)|will\s+(?:produce|deliver|publish|ship|launch))\b"),
    "deliverable-format": Detector(
        _DELIVERABLE,
        (
            r"(?i)\b(?:reports?|dashboards?|curricul(?:um|a)|courses?|documents?|documentation|plans?|roadmaps?|modules?|manuals?|guides?|presentations?|policies|policy|prototypes?|releases?|pipelines?|datasets?|playbooks?|runbooks?|proposals?|specs?|specifications?|training\s+materials?|workshops?|handbooks?)\b",
        ),
    ),
    "measure": Detector(_MEASURE := r"(?i)\b(?:success\s+(?:is|will\s+be|looks\s+like|means|measure)|measured\s+(?:by|on|against)|KPIs?|OKRs?|metrics?|targets?|quota|success\s+criteria|performance\s+indicators?)\b"),
    "horizon": Detector(
        _HORIZON := r"(?i)\b(?:first|initial)\s+(?:30|60|90|three|six|3|6)\b|\bwithin\s+(?:the\s+first\s+)?(?:\d+|three|six|a\s+few)\s+(?:days|weeks|months)\b|\b(?:30|60|90)[-\s]day\b|\bby\s+the\s+end\s+of\s+(?:the\s+)?(?:first\s+)?(?:quarter|term|semester|\d+\s+months)\b|\bfirst\s+(?:quarter|year|term|semester)\b"
    ),
    "measure-in-horizon": Detector(_MEASURE, (_HORIZON,)),
    "coordination": Detector(_WITH := r"(?i)\b(?:work(?:s|ing)?\s+(?:closely\s+|cross-functionally\s+)?with|partner(?:s|ing)?\s+with|collaborat(?:e|es|ing)\s+with|liais(?:e|es|ing)\s+with|coordinat(?:e|es|ing)\s+with|cross-functional)\b"),
    "named-group": Detector(
        _WITH,
        near=r"(?i)\b(?:engineering|engineers|product|design(?:ers)?|finance|legal|HR|human\s+resources|marketing|sales|operations|support|data|security|IT|vendors?|suppliers?|instructors?|faculty|executives?|leadership|customers?|clients?|procurement|regional\s+managers?|account\s+managers?|recruiters?|trainers?|developers?|analysts?|nurses?|teachers?)\b",
    ),
    "cadence": Detector(
        _CADENCE := r"(?i)\b(?:daily|weekly|bi-?weekly|fortnightly|monthly|quarterly|annual(?:ly)?|sprints?|release\s+cycles?|each\s+(?:week|month|quarter|term|semester)|every\s+(?:\d+|two|three|other)?\s*(?:days?|weeks?|months?|quarters?)|per\s+(?:week|month|quarter)|on\s+a\s+(?:daily|weekly|monthly|quarterly)\s+basis)\b"
    ),
    "delivery-cadence": Detector(
        _CADENCE, (r"(?i)\b(?:deliver\w*|release\w*|ship\w*|updates?|report\w*|review\w*|check-?ins?|milestones?|launch\w*|publish\w*|cycles?|sprints?|deadlines?|demos?|stand-?ups?)\b",)
    ),
    "vague-cadence": Detector(r"(?i)\b(?:regular(?:ly)?|ongoing|periodic(?:ally)?|timely|tight\s+deadlines?|deadlines?|fast-paced)\b"),
}
#: The six points of a clear role, by the detectors that show them (fixed values).
ROLE_POINTS = {
    "supervisor": Point(("reports-to", "department"), ("supervisor-word", "part-of", "named-unit")),
    "scope": Point(("owned",), ("duties-heading",), many=2),
    "deliverables": Point(("deliverable-format",), ("deliverable",)),
    "success": Point(("measure-in-horizon",), ("measure", "horizon")),
    "coordination": Point(("named-group",), ("coordination",)),
    "cadence": Point(("delivery-cadence",), ("cadence", "vague-cadence")),
}
#: Wording that carries a duty without saying who owns it (fixed values).
SOFT_VERBS = {
    "participate in": r"(?i)\bparticipat(?:e|es|ed|ing)\s+in\b",
    "support": r"(?i)\bsupport(?:s|ed|ing)?\s+(?:the|our|with|in|of)\b",
    "assist": r"(?i)\bassist(?:s|ed|ing)?\s+(?:with|in|the|our)\b",
    "help with": r"(?i)\bhelp(?:s|ed|ing)?\s+(?:with|to|the|our)\b",
    "contribute to": r"(?i)\bcontribut(?:e|es|ed|ing)\s+to\b",
    "involved in": r"(?i)\b(?:be\s+|being\s+|get\s+|getting\s+)?involved\s+in\b",
    "exposure to": r"(?i)\bexposure\s+to\b",
    "potential (hedged scope)": r"(?i)\bpotential(?:ly)?\s+(?:implementation|rollout|launch|migration|project|expansion|role|opportunit(?:y|ies))\b",
    "other duties as assigned": r"(?i)\bother\s+duties\s+as\s+(?:assigned|required|needed)\b",
    "as needed": r"(?i)\bas\s+(?:needed|required)\b",
}
#: Soft verbs from which a posting's duties count as soft.
HEAVY = 3


def role_clarity(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(points, counts): status and quotes of each point of every text, and a row for each text with its counts and soft verbs.

    A department alone is no supervisor: without "reports to", only the weak signs count.
    A text without sentences has nothing to ask about.
    """
    rows = sentences(docs, id_col, text_col)
    texts = docs.select(F.col(id_col).alias("id"))
    found = annotate(rows, ROLE_DETECTORS)
    named = found.where("detector = 'reports-to'").select("id").distinct().withColumn("led", F.lit(True))
    # A named department counts beside "reports to" only.
    found = found.join(named, "id", "left").where("detector != 'department' OR led").where("detector NOT IN ('supervisor-word', 'part-of', 'named-unit') OR led IS NULL").drop("led")
    judged = points(found, texts, ROLE_POINTS)
    soft = every_match(rows, SOFT_VERBS).groupBy("id").agg(F.count("*").alias("soft_verbs"))
    some = rows.select("id").distinct().withColumn("some", F.lit(True))
    counts = point_counts(judged).join(soft, "id", "left").join(some, "id", "left")
    soft_count = F.coalesce("soft_verbs", F.lit(0))
    return judged, counts.select("id", "present", "partial", "missing", (F.col("ask") & F.col("some").isNotNull()).alias("ask"), soft_count.alias("soft_verbs"), (soft_count >= HEAVY).alias("soft"))
