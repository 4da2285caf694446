"""Fields of notes, report facts, levels, reuse, enrichment and finding."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siltstone.functions import notes
from siltstone.operators import enrichment


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


#: Notes, role, given place; place, mode, pay, ceiling, source, posting day, last contact (applied on 2026-06-01).
NOTES = [
    ("Pay $140-210K (POSTED); Rejected 2026-06-04", "Engineer", "", "", "", "$140-210K", 210000.0, "POSTED", None, "2026-06-04"),
    ("~$150-220K (est). Remote-first", "Engineer", None, "", "RemoteFlex", "~$150-220K", 220000.0, "est", None, "2026-06-01"),
    ("$600M valuation, $70M Series C, base $170K min", "X", "", "", "", "$170K", 170000.0, None, None, "2026-06-01"),
    ("$170K floor, $174,986-209,983", "Data — Charlotte, NC", "", "Charlotte, NC", "Full", "$174,986-209,983", 209983.0, None, None, "2026-06-01"),
    ("Location: Remote hub Porto; hybrid", "X", "", "Remote Hub Porto", "Hybrid", "", 0.0, None, None, "2026-06-01"),
    ("Office in Austin TX. 150-200K PLN monthly", "X", "", "Austin, TX", "Full", "150-200K PLN", 200000.0, None, None, "2026-06-01"),
    ("G18 EUR level; US$120K; onsite", "X", "", "", "Full", "$120K", 120000.0, None, None, "2026-06-01"),
    ("posted: 2026-07-20; posted 2026-07-01; call 2026-06-20", "X", "", "", "", "", 0.0, None, "2026-07-20", "2026-06-20"),
    ("Recruiter posted 2026-07-20 update", "Lisbon remote", "", "Lisbon", "Remote", "", 0.0, None, None, "2026-07-20"),
    ("market rate 90,000 EUR", "X", "Graz", "Graz", "Full", "90,000 EUR", 90000.0, "est", None, "2026-06-01"),
    (None, None, None, "", "", "", 0.0, None, None, "2026-06-01"),
]


def test_note_fields(spark):
    rows = spark.createDataFrame([(k, *n[:3], dt.date(2026, 6, 1)) for k, n in enumerate(NOTES)], "k long, notes string, role string, place string, day date")
    got = {r.k: tuple(r.f) for r in rows.select("k", notes.note_fields(*(F.col(c) for c in ("notes", "role", "place", "day"))).alias("f")).collect()}
    assert got == {k: n[3:] for k, n in enumerate(NOTES)}


@pytest.mark.parametrize(
    ("text", "score", "stop", "doubt"),
    [
        ("SCORE: 4.5\n**Score:** 3/5\nscore: 2", 4.5, False, False), ("x\n**Score:** 3.5 / 5\nscore: 2", 3.5, False, False), ('a\nscore: "2.0"\n', 2.0, False, False), ("score 3", None, False, False),
        ("hard_stops:\n  - visa\n", None, True, False), ("hard_stops: []\nx", None, False, False), ("hard_stops: [ visa ]", None, True, False), ("hard_stops:\nnext: 1", None, False, False),
        ("legitimacy_tier: 'Suspicious'", None, False, True), ("LEGITIMACY: suspicious", None, False, True), ("**Legitimacy:** Suspicious ", None, False, True), ("it looks suspicious", None, False, False), (None, None, False, False),
    ],
)
def test_reports(spark, text, score, stop, doubt):
    column = F.lit(text).cast("string")
    assert (value(spark, notes.report_score(column)), value(spark, notes.has_hard_stop(column)), value(spark, notes.is_suspicious(column))) == (score, stop, doubt)


def test_levels_and_reuse(spark):
    cases = {
        "Senior engineer": [3], "Principal responsibilities: lead the team": [], "Principal Engineer": [4], "Lead Engineer": [4], "mid-market accounts": [], "mid level": [2], "junior to senior": [1, 3], "资深工程师": [3],
        "international seniority": [], "Lead, data": [4], "": [],
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "k long, t string").select("k", notes.text_levels(F.col("t")).alias("l"))
    assert {r.k: r.l for r in rows.collect()} == dict(enumerate(cases.values()))
    decide = lambda a, b, s: tuple(value(spark, notes.reuse_decision(F.lit(a), F.lit(b), F.lit(s))))
    assert decide("senior", "junior", 0.9) == ("regenerate", "level-mismatch") and decide("senior", "junior to senior", 0.72) == ("reuse", "high-similarity")
    assert decide("x", "senior", 0.5) == ("reuse-with-edits", "medium-similarity") and decide("x", "y", 0.1) == ("regenerate", "low-similarity")


def test_enriched(spark):
    day = dt.date(2026, 6, 1)
    apps = spark.createDataFrame([(1, "Engineer", "$100-120K; 2026-07-01", "", day, 7), (2, "X", None, "Wien", day, None), (3, "Y", "", "", day, 9)], "num long, role string, notes string, place string, day date, report long")
    reports = spark.createDataFrame([(7, "SCORE: 4.1\narchetype: 'Platform'\nhard_stops: [visa]"), (7, "short"), (8, "SCORE: 1"), (None, "SCORE: 2"), (9, "**Archetype** | **Data** |")], "report long, text string")
    got = {r.num: r for r in enrichment.enriched(apps, reports).collect()}
    assert (got[1].pay_max, got[1].last_contact, got[1].archetype, got[1].report_score, got[1].hard_stop) == (120000.0, "2026-07-01", "Platform", 4.1, True)
    assert (got[2].place, got[2].mode, got[2].report_score) == ("Wien", "Full", None) and got[3].archetype == "Data" and len(got) == 3


def test_found(spark):
    rows = spark.createDataFrame([(7, 12, "Acme", "Data Engineer"), (12, 7, "Globex", "ML Engineer"), (3, None, None, "Engineer, Data"), (40, 40, "Data Ltd", None)], "num long, report long, company string, role string")
    queries = spark.createDataFrame([("007",), (" acme ",), ("data engineer",), ("",), ("nothing",), (None,)], "query string")
    got = {(r.query, r.num): r.by_what for r in enrichment.found(rows, queries).collect()}
    assert got == {("007", 7): "row", ("007", 12): "report", ("acme", 7): "part", ("data engineer", 7): "part", ("data engineer", 3): "role"}


def test_found_meets_each_spelling_once(spark, capsys):
    rows = spark.createDataFrame([(k, k + 500, "Acme" if k % 2 else None, "Data Engineer") for k in range(100)], "num long, report long, company string, role string")
    got = enrichment.found(rows, spark.createDataFrame([("engineer",), ("acme",)], "query string"))
    got.explain("simple")
    below = capsys.readouterr().out.split("BroadcastNestedLoopJoin", 1)[1]
    assert "HashAggregate(keys=[company" in below.split("Broadcast", 1)[0]
    assert sorted((r["query"], r["num"]) for r in got.collect()) == sorted([("engineer", k) for k in range(100)] + [("acme", k) for k in range(1, 100, 2)])


def test_funding_is_taken_with_its_span(spark):
    text = "Raised $107M series B; $80-95K (POSTED); 12,000 EUR per month; $5M round; 3 USD Valuation; zł 40 Total  raised"
    row = spark.range(1).select(notes.pay_spans(F.lit(text)).alias("spans")).first()
    assert row["spans"] == ["$80-95K", "12,000 EUR"]
