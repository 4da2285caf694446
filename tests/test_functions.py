"""Expected values of the Column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siltstone.functions import markup, privacy, text, urls, values, vendors


def column(spark, rows, expr, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_status(spark):
    raw = ["Aplicado", "**Hired**", None, "—", " yanıt verildi ", "İşe alındı", "Ghosted", "online assessment", "geo blocker"]
    want = ["APPLIED", "HIRED", "DISCARDED", "DISCARDED", "RESPONDED", "HIRED", "GHOSTED", "ASSESSMENT", "SKIP"]
    assert column(spark, raw, text.canonical_status) == want


def test_seniority_and_archetype(spark):
    assert column(spark, ["VP of Sales", "Lead Engineer", "Senior Dev", "intern", "Engineer", None], text.seniority) == [
        "Executive", "Lead / Manager", "Senior", "Junior / Entry", "Mid-Level", "Mid-Level",
    ]
    assert column(spark, ["", "supply chain development", "AI PM", "MLOps", "Data"], text.archetype) == [
        "Unclassified", "Other / Cross-Functional", "Technical AI PM", "AI Platform & LLMOps", "Data & Analytics",
    ]


def test_location(spark):
    raw = ["Wien, AT", "Remote", "new york, ny", "Idaho Falls, ID", "req 12", None, "singapore, on-site"]
    assert column(spark, raw, text.location) == ["Vienna", "", "New York, NY", "Idaho Falls, ID", "", "", "Singapore"]


def test_tokens_and_jaccard(spark):
    df = spark.createDataFrame([("The C++ and node.js a 5", "c++ NODE.JS"), ("", ""), ("x1", None)], "a string, b string")
    a, b = text.token_set(F.col("a")), text.token_set(F.col("b"))
    assert [sorted(r[0]) for r in df.select(a).collect()] == [["5", "c++", "node.js"], [], ["x1"]]
    assert [r[0] for r in df.select(text.jaccard(a, b)).collect()] == pytest.approx([2 / 3, 1.0, 0.0])


@pytest.mark.parametrize(
    ("value", "term", "want"),
    [
        ("ai全栈工程师", "ai", True), ("aiエンジニア", "ai", True), ("maintainer", "ai", False), ("évp", "vp", False), ("svp, vp", "vp", True),
        ("engineers", "engineer", True), ("coengineers", "stem:engineer", False), ("engineers", "word:engineer", False), ("x", "word:", False), (None, "ai", False),
    ],
)
def test_keyword(spark, value, term, want):
    assert column(spark, [value], lambda c: text.keyword(c, term)) == [want]


def test_title_filter(spark):
    rows = ["Senior C++ developer", "Junior data engineer", "Data engineer", None]
    assert column(spark, rows, lambda c: text.title_filter(c, ["data + engineer", "c++"], ["junior"])) == [True, False, True, False]
    assert column(spark, ["x", None], lambda c: text.title_filter(c, [], [])) == [True, True]


def test_formula_guard_round_trip(spark):
    cells = ["=1+1", "-x", "plain", "'=x", "'plain", ""]
    assert column(spark, cells, lambda c: text.formula_unescape(text.formula_escape(c))) == cells


def test_urls(spark):
    raw = ["http://A.example.com/x/?utm_source=a&b=2&a=1#top", "https://b.example.com", "ftp://x", None, "not a url"]
    assert column(spark, raw, urls.normalized_url) == ["https://a.example.com/x?a=1&b=2", "https://b.example.com/", "", "", ""]


def test_urls_of_pages_within_pages(spark):
    """Ids of jobs in fragments, ports, and parameters that differ in case name different jobs."""
    cases = {
        "https://x.org/#/job/1": "https://x.org/?fragment_job_id=1",
        "https://x.org/#!/jobs/a%20b/": "https://x.org/?fragment_job_id=a b",
        "https://x.org/#/job/1%zz": "https://x.org/",
        "https://x.org/a/?q=2#/jobs/2?lang=de&x=1": "https://x.org/a?fragment_job_id=2&lang=de&q=2",
        "https://x.org/a?lang=fr#/jobs/2?lang=de": "https://x.org/a?fragment_job_id=2&lang=fr",
        "https://app.mokahr.com/apply/x#/job/9": "https://app.mokahr.com/apply/x?mokahr_job_id=9",
        "https://x.org/#/job/": "https://x.org/",
        "https://x.org/#/team/1": "https://x.org/",
        "https://x.org:8443/a?id=AbC": "https://x.org:8443/a?id=AbC",
        "http://x.org:80/a": "https://x.org/a",
        "https://x.org:443/a": "https://x.org/a",
        "https://user@x.org:81/a": "https://x.org:81/a",
        "https://apply.careers.microsoft.com/careers/job/17": "https://apply.careers.microsoft.com/careers?domain=microsoft.com&pid=17",
        "https://apply.careers.microsoft.com/careers?domain=microsoft.com&pid=17&x=1": "https://apply.careers.microsoft.com/careers?domain=microsoft.com&pid=17",
        "https://apply.careers.microsoft.com/careers?q=data": "https://apply.careers.microsoft.com/careers?q=data",
    }
    assert dict(zip(cases, column(spark, list(cases), urls.normalized_url))) == cases
    keys = column(spark, ["https://X.org/A?id=AbC", "https://x.org/a?id=aBc", "https://x.org/a?lang=de&id=AbC", "https://x.org/#/job/1?lang=de", "https://x.org/#/job/1", "https://x.org/#/job/2"], vendors.job_key)
    assert keys[0] == keys[2] != keys[1] and keys[3] == keys[4] != keys[5]


def test_listing_key(spark):
    key = spark.range(1).select(urls.listing_key(F.lit("greenhouse"), F.lit("example"), F.lit("12345")), urls.listing_key(F.lit("x"), F.lit(None), F.lit("1"))).first()
    assert key[0].startswith("listing_v1_a8b20889") and key[0].endswith("ecc6") and key[1] is None


def test_values(spark):
    assert column(spark, ["4.2/5", "**4.2**", "N/A", "3,5", "7", "4/10"], values.score_cell) == [4.2, 4.2, None, 3.5, None, None]
    assert column(spark, ["$120,000", "85k", "none"], values.money) == [120000.0, 85000.0, None]
    days = [dt.date(2025, 12, 29), dt.date(2026, 1, 1), dt.date(2024, 12, 31), dt.date(2027, 1, 1)]
    assert column(spark, days, values.iso_week, "date") == ["2026-W01", "2026-W01", "2025-W01", "2026-W53"]


def test_markup(spark):
    page = "<p>A&lt;b&gt; <!-- x --><script>var t='</p>'</script>c</p><p>d</p>"
    assert column(spark, [page, None], markup.html_to_text) == ["A c d", ""]
    assert column(spark, ["<p>a</p><p>b <b>c</b></p>"], markup.block_text) == ["a\nb c"]


def test_privacy(spark):
    raw = ["mail a.b@example.com or +1 (555) 123-4567", "https://linkedin.com/in/me x"]
    assert column(spark, raw, privacy.redacted) == ["mail [EMAIL] or [PHONE]", "[PROFILE] x"]
    assert column(spark, ["token=abcdefghij /home/me/x ghp_abcdefgh123"], privacy.scrubbed) == ["token=[SECRET] ~/x [SECRET]"]
    assert column(spark, ["Ann Lee and Ann"], lambda c: privacy.tokenised(c, ["Ann", "Ann Lee"])) == ["PRIVACY_VALUE_2 and PRIVACY_VALUE_1"]
