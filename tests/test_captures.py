"""Slugs, levers, keywords, truncated boards and the results' view."""

from pyspark.sql import functions as F

from siltstone.functions import captures
from siltstone.operators import queues


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_slugs(spark):
    cases = {
        "Acme, Inc. (EU)": "acme-inc-eu", "  R&D__Lab ": "rd-lab", "株式会社アクメ": "株式会社アクメ", "Яндекс Маркет": "яндекс-маркет", "Zoë": "zo", "—": "", "": "", "-a-": "a",
    }
    for text, want in cases.items():
        assert value(spark, captures.capture_slug(F.lit(text))) == want, text
    assert value(spark, captures.capture_slug(F.lit(None).cast("string"))) == ""
    assert value(spark, captures.capture_slug(F.lit("x" * 500))) == "x" * captures.SLUG_BYTES
    cut = value(spark, captures.capture_slug(F.lit("株" * 500), 10))
    assert cut == "株" * 3
    assert value(spark, captures.capture_slug(F.lit("Я😀я"), 5)) == "яя"


def test_levers_and_cards(spark):
    lists = lambda *v: F.array(*map(F.lit, v)) if v else F.lit(None).cast("array<string>")
    levers = captures.score_levers(lists("visa"), lists("sql", "sql", "go"), lists("team size"), lists("pay"), lists("python"))
    got = value(spark, levers)
    assert (got.holding, got.close, got.verify, got.strengths) == (["visa"], ["sql", "go"], ["team size", "pay evidence is unknown"], ["python"])
    assert tuple(value(spark, captures.card_reason(F.lit("Apply"), levers))) == ("Apply", "python", "visa")
    bare = captures.score_levers(lists(), lists("sql"), lists(), lists(), lists())
    assert tuple(value(spark, captures.card_reason(F.lit(None).cast("string"), bare))) == (None, None, "sql")
    nothing = captures.score_levers(lists(), lists(), lists(), lists(), lists())
    assert value(spark, captures.card_reason(F.lit(""), nothing)) is None


def test_keywords_and_truncation(spark):
    words = captures.target_keywords(F.array(F.lit(" Data "), F.lit(None), F.lit("")), F.array(F.lit("ML"), F.lit("Data")))
    assert value(spark, words) == ["Data", "ML"] and value(spark, captures.target_keywords(F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"))) == []
    note = lambda r, f, t: value(spark, captures.truncation_note(F.lit("Acme"), F.lit(r).cast("string"), F.lit(f).cast("int"), F.lit(t).cast("int")))
    assert note("page-cap", 100, 340) == "Acme (page-cap, 100 of 340)" and note("rate-limited", 7, None) == "Acme (rate-limited, 7 read)" and note("x", None, None) == "Acme (x)"
    assert note("descriptions-omitted", 3, 9) == "Acme (descriptions omitted, 3 of 9 with descriptions)" and note("descriptions-omitted", 3, None) == "Acme (descriptions omitted)" and note(None, 1, 2) is None


def test_results_view(spark):
    rows = [(1, "Data Engineer", "Acme", "high", 4.0), (2, "Cook", "Datahouse", "low", 1.0), (3, None, "Data", None, None), (4, "Clerk", "X", "high", 5.0), (5, "data", None, "high", 4.5)]
    df = spark.createDataFrame(rows, "n long, title string, company string, band string, score double")
    view = lambda **k: [(r.n, r.place) for r in sorted(queues.results_view(df, **k).collect(), key=lambda r: r.place)]
    assert view(query=" DATA ", hidden=("low",)) == [(5, 1), (1, 2), (3, 3)]
    assert view() == [(4, 1), (5, 2), (1, 3), (2, 4), (3, 5)] and view(query="none") == []
    assert view(keys=[("company", True), ("score", True)], hidden=("high",)) == [(3, 1), (2, 2)]
