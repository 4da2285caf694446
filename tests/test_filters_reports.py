"""Filters, identities and reports on small cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siltstone.functions import filters, values
from siltstone.operators import identity, reports, state


def column(spark, rows, expr, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("place", "title", "strict", "want"),
    [
        ("Berlin", "x", False, True), ("Paris", "x", False, False), ("Berlin Falls", "x", False, False), ("Oslo", "x", False, True), ("Oslo Falls", "x", False, False),
        ("Paris", "Remote engineer", False, True), ("Worldwide", "x", False, True), ("", "x", False, True), (None, "x", True, False),
    ],
)
def test_location_tiers(spark, place, title, strict, want):
    df = spark.createDataFrame([(place, title)], "p string, t string")
    test = filters.location_filter(F.col("p"), F.col("t"), ["berlin"], ["lyon"], ["oslo"], ["falls"], strict)
    assert df.select(test).first()[0] == want


def test_salary(spark):
    rows = [(100.0, None, "usd"), (None, 90.0, "USD"), (None, None, "USD"), (10.0, None, "EUR"), (None, 200.0, None)]
    df = spark.createDataFrame(rows, "low double, high double, c string")
    got = [r[0] for r in df.select(filters.salary_filter(F.col("low"), F.col("high"), F.col("c"), 100.0, "usd")).collect()]
    assert got == [True, False, True, True, True]


def test_employment(spark):
    raw = ["Full-time", "not a contract, full time", "Internship (part-time)", "non-permanent", None]
    assert column(spark, raw, filters.employment_type) == ["full-time", "full-time", "internship", None, None]
    assert column(spark, raw, lambda c: filters.employment_filter(c, ["internship"], include_unknown=False)) == [False, False, True, False, False]
    with pytest.raises(ValueError, match="no such"):
        filters.employment_filter(F.lit("x"), ["sometimes"])


def test_public_url(spark):
    raw = ["https://a.example.com/x", "http://localhost/x", "https://10.0.0.1/", "https://u:p@x.org", "ftp://x.org", "https://0x7f.1/", "https://intranet", None]
    assert column(spark, raw, filters.public_url) == [True, False, False, False, False, False, False, False]


def test_fit_and_advice(spark):
    yes, no = F.lit(True), F.lit(False)
    score = lambda title: filters.fit_score(F.lit(title), F.lit("senior data engineer"), yes, no, yes)
    row = spark.range(1).select(score("Senior data engineer"), score("data engineer"), score("engineer"), score("")).first()
    assert tuple(row) == (5, 4, 2 if 1 / 3 < 0.34 else 3, 2)
    advice = spark.range(1).select(*[filters.recommendation(F.lit(s), F.lit(h), F.lit(u)) for s, h, u in ((4.5, False, False), (4.5, False, True), (4.5, True, False), (3.2, False, False), (2.0, False, True))]).first()
    assert tuple(advice) == ("Apply", "Check first", "Skip", "Consider", "Skip")


def test_company_relation(spark):
    pairs = [("Acme Inc", "ACME"), ("Acme", "Acme Labs"), ("Acme", "Acme Rocket"), ("Acme Rocket", "Acme Rocket Berlin"), ("", "Acme"), ("Acme", None)]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(identity.company_relation(F.col("a"), F.col("b"))).collect()] == ["same", "parent", None, "parent", None, None]


def test_import_plan(spark):
    rows = spark.createDataFrame([(1, "k1", "New Co", "dev"), (2, "k1", "New Co", "dev"), (3, None, "Acme Inc", "Dev"), (4, "k9", "Acme", "dev"), (5, "k2", "Beta", "ops")], "seq long, url_key string, company string, role string")
    known = spark.createDataFrame([("k2", "Other", "x"), (None, "Gamma", "y"), ("k7", "Acme", "dev")], "url_key string, company string, role string")
    got = {r["seq"]: r["verdict"] for r in identity.import_plan(rows, known).collect()}
    assert got == {1: "new", 2: "repeated", 3: "known", 4: "new", 5: "known"}


def test_reconcile(spark):
    pending = spark.createDataFrame([(k,) for k in "abcde"], "key string")
    batch = spark.createDataFrame([("a", 1, "completed", None), ("a", 2, "completed", "r"), ("b", 1, "completed", None), ("c", 1, "dealbreaker", None), ("e", 1, "completed", "r")], "key string, id long, status string, report string")
    done = spark.createDataFrame([("e",)], "key string")
    assert {r["key"]: r["bucket"] for r in identity.reconcile(pending, batch, done).collect()} == {"a": "moved", "b": "no-report", "c": "dealbreaker", "d": "keep", "e": "already"}


def test_closing_dates(spark):
    raw = ["Apply by 2026-01-31.", "Deadline: 5 March 2026", "closing date: Sept 3, 2026", "closes on 07.02.2026", "Deadline: 2026-02-30", "no date", None]
    d = dt.date
    assert column(spark, raw, values.closing_date) == [d(2026, 1, 31), d(2026, 3, 5), d(2026, 9, 3), d(2026, 2, 7), None, None, None]


def test_skip_blockers(spark):
    skipped = spark.createDataFrame([(i, dt.date(2024, 1, i)) for i in (1, 2, 3)], "id long, day date")
    needs = spark.createDataFrame(
        [(1, "Go", "critical", "missing"), (1, "go ", "high", "partial"), (2, "GO", "high", "partial"), (2, "Rust", "critical", "missing"), (3, "Go", "low", "missing")],
        "id long, requirement string, importance string, match string",
    )
    assert [tuple(r) for r in reports.skip_blockers(skipped, needs).collect()] == [("go", 2, 1)]


def test_empty_reports(spark):
    none = spark.createDataFrame([], "portal string, status string, company string, first_seen date")
    assert reports.scan_stats(none).first()["total"] == 0
    assert reports.portal_coverage(none.select("portal"), none).first()["producing_pct"] is None


def test_fresh_facts(spark):
    t = dt.datetime
    facts = spark.createDataFrame([("a", t(2024, 1, 1, 0), 1), ("a", t(2024, 1, 1, 5), 2), ("b", t(2023, 1, 1), 3), ("c", t(2024, 1, 3), 4)], "key string, stamped timestamp, v int")
    now = F.expr("timestamp '2024-01-01 12:00:00'")
    assert [tuple(r)[::2] for r in state.fresh_facts(facts, now, 86400).collect()] == [("a", 2)]
    assert state.fresh_facts(facts, now, 86400, F.expr("timestamp '2024-01-01 06:00:00'")).count() == 0


def test_fresh_facts_within_a_second(spark):
    t = dt.datetime
    facts = spark.createDataFrame(
        [("a", t(2024, 1, 1, 11), 1, 1), ("a", t(2024, 1, 1, 12, 0, 0, 400_000), 2, 2), ("b", t(2024, 1, 1, 12, 0, 0, 1), 3, 3), ("c", t(2024, 1, 1, 9), 5, 4), ("c", t(2024, 1, 1, 9), 4, 5), ("d", t(2023, 12, 31, 12), 6, 6)],
        "key string, stamped timestamp, seq long, v int",
    )
    now = F.expr("timestamp '2024-01-01 12:00:00'")
    assert {r["key"]: r["v"] for r in state.fresh_facts(facts, now, 86400, seq="seq").collect()} == {"a": 1, "c": 5, "d": 6}


def test_cadence(spark):
    rows = spark.createDataFrame([(1, dt.date(2024, 1, 1), 0), (2, dt.date(2024, 1, 3), 0), (3, dt.date(2024, 1, 5), 0), (4, dt.date(2024, 1, 1), 2)], "n int, last_contact date, sent int")
    got = {r["n"]: r["urgency"] for r in state.cadence(rows, F.expr("date '2024-01-10'")).collect()}
    assert got == {1: "overdue", 2: "urgent", 3: "waiting", 4: "cold"}
