"""Labels, matchers, vendors and pay on single values."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions import days, labels, matchers, pages, pay, vendors
from siltstone.operators import lookups, queues, similarity


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_title_conflicts(spark):
    found = value(spark, matchers.title_conflicts(["data", "senior manager", "stem:anal"], ["word:manager", "data analyst", "ist"]))
    assert [tuple(r) for r in found] == [("senior manager", "word:manager")]


def test_most_distance():
    assert similarity.most_distance(0.92) == 5 and similarity.most_distance(1.0) == 0 and similarity.most_distance(0) == 64


@pytest.mark.parametrize(
    ("left", "right", "relation"),
    [
        ("https://boards.greenhouse.io/a/jobs/12", "https://www.acme.com/careers?gh_jid=12", "same"),
        ("https://job-boards.greenhouse.io/embed/job_app?for=a&token=12", "https://boards.greenhouse.io/a/jobs/12", "same"),
        ("https://www.linkedin.com/jobs/view/engineer-at-acme-1234567/", "https://linkedin.com/jobs/search?currentJobId=1234567", "same"),
        ("https://a.wd1.myworkdayjobs.com/en-US/X/job/Y_1", "https://a.wd1.myworkdayjobs.com/X/job/Y_1", "one-sided-language"),
        ("https://x.com/j/1?lang=de", "https://x.com/j/1?lang=fr", "distinct"),
        ("https://x.com/j/1", "mailto:x", "no-key"),
        ("https://X.com/J/1/?ref=a", "http://x.com/j/1", "same"),
    ],
)
def test_url_relation(spark, left, right, relation):
    assert value(spark, vendors.url_relation(F.lit(left), F.lit(right))) == relation


@pytest.mark.parametrize(
    ("text", "low", "high", "currency", "period"),
    [
        ("$120k - $150k", 120000, 150000, None, None), ("80-100k EUR per annum", 80000, 100000, "EUR", "annual"), ("1.234,50 € monthly", 1234.5, 1234.5, "EUR", "monthly"),
        ("USD or EUR 5,000", 5000, 5000, "", None), ("none", None, None, None, None), (None, None, None, None, None),
    ],
)
def test_pay(spark, text, low, high, currency, period):
    c = F.lit(text).cast("string")
    got = value(spark, F.struct(pay.pay_range(c).alias("r"), pay.currency(c).alias("c"), pay.period(c).alias("p")))
    assert (got["r"]["low"], got["r"]["high"], got["c"], got["p"]) == (low, high, currency, period)


def test_close_day(spark):
    day = lambda text: value(spark, days.close_day(F.lit(text)))
    assert day("2024-02-28T23:30:00-05:00") == dt.date(2024, 2, 29) and day("2024-03-01T00:15+01:00") == dt.date(2024, 2, 29)
    assert day("2024-02-30") is None and day("2024-01-01T24:00Z") is None and day("2024-01-01T10:00+14:01") is None


def test_null_cells(spark):
    """Nulls go through every label without an error."""
    null = F.lit(None).cast("string")
    for f in (labels.outcome, labels.rank_stamp, labels.slug, labels.fit_tone, labels.href, matchers.workplace, matchers.posting_url, vendors.ats_vendor, vendors.ats_coordinates):
        assert value(spark, f(null)) is None
    assert value(spark, labels.import_stage(null)) == "APPLIED" and value(spark, vendors.job_key(null)) is None or value(spark, vendors.job_key(null)) == ""
    assert value(spark, labels.token_value(null)) == 0 and value(spark, labels.levels(null)) == [] and value(spark, labels.acronyms(null)) == []


def test_first_acceptable(spark):
    pick = lambda stripped, *c: value(spark, queues.first_acceptable(F.lit(stripped), [F.lit(x) for x in c], 3))
    assert pick("a b c d", "a b c", "a b c d e") == "a b c d e" and pick("a", "b c", "d e f") == "d e f" and pick("a b c d", "x", "y z") == "a b c d"


def test_company_key(spark):
    assert value(spark, lookups.company_key(F.lit(" Acme, Inc. "), forms=False)) == "acme" and value(spark, lookups.company_key(F.lit("Acme Inc"))) == "acme inc"


def test_pages(spark):
    one = '<script type="application/ld+json">{"@graph": [{"@type": "Thing"}, {"@type": "JobPosting", "title": "T", "hiringOrganization": {"name": "A"}, "validThrough": "2024-01-01"}]}</script>'
    plain = '<script type="application/ld+json">[{"@type": "JobPosting", "title": "U", "hiringOrganization": "B"}]</script>'
    got = value(spark, pages.job_posting(F.lit(one)))
    assert (got["title"], got["company"], got["closes"]) == ("T", "A", "2024-01-01")
    assert value(spark, pages.job_posting(F.lit(plain)))["company"] == "B"
    for none in (one + plain, "", None, '<script type="application/ld+json">broken</script>'):
        assert value(spark, pages.job_posting(F.lit(none).cast("string"))) is None
    html = 'x {"description": "a"} y {"description" : "long \\"one\\" \\u00e9"}'
    assert value(spark, pages.embedded_description(F.lit(html))) == 'long "one" é' and value(spark, pages.embedded_description(F.lit("no"))) is None
    role = value(spark, pages.panel_role(F.lit("Director of Engineering and Product")))
    assert (role["role"], role["also"]) == ("hiring-manager", ["engineer", "product"]) and value(spark, pages.panel_role(F.lit("Chef"))) is None
    fresh = lambda d, c, x: value(spark, pages.evidence_freshness(F.lit(d).cast("int"), F.lit(c), F.lit(x)))
    assert [fresh(None, 0, False), fresh(40, 0, False), fresh(3, 1, False), fresh(3, 0, True), fresh(3, 0, False)] == ["unknown", "stale", "stale", "partial", "fresh"]
    assert value(spark, pages.blocker_group(F.lit(" "), F.lit("Visa"), F.lit("x"))) == "visa"


def test_places_among_all_rows(spark):
    """As a plain sort has them, missing, empty and not-a-number values last in either direction, over many partitions."""
    rng = random.Random(5)
    rows = [(k, rng.choice(["a", "b", "", None]), rng.choice([1.5, 2.0, 3.0, None, float("nan")])) for k in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "n long, decision string, score double").repartition(7)
    got = {r.n: r.place for r in queues.placed_overall(df, [("decision", True), ("score", False)], "n").collect()}
    none = lambda s: s is None or s != s
    order = sorted(rows, key=lambda r: (not r[1], r[1] or "", none(r[2]), 0 if none(r[2]) else -r[2], r[0]))
    assert got == {r[0]: k for k, r in enumerate(order, 1)}
    assert queues.placed_overall(df.limit(0), [("decision", True)], "n").collect() == []
