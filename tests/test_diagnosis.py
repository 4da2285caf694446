"""Coverage codes, reply evidence, transitions and links in mails."""

from urllib.parse import quote

from pyspark.sql import functions as F

from siltstone.functions import vendors
from siltstone.operators import diagnosis, mail_links

POSTINGS = "n long, key string, company string, vendor string, slug string, title string, location string, url string"


def test_coverage_codes(spark):
    """Each of the nine codes, in the order in which they are asked."""
    rows = [
        (1, "k1", "acme", "lever", "acme", "good", "ok", "u"), (2, "k2", "acme", "lever", "acme", "good", "ok", "u"), (3, "", "off", None, None, "good", "ok", "u"), (4, "", "none", "lever", "none", "good", "ok", "u"),
        (5, "", "acme", "lever", "acme", "bad", "ok", "u"), (6, "", "acme", "lever", "acme", "good", "bad", "u"), (7, "", "acme", "ashby", "acme", "good", "", "u"), (8, "", "new", None, None, "good", "ok", "u"),
        (9, "", "new", "lever", "new", "good", "ok", "u"), (10, "k3", "new", "lever", "new", "bad", "ok", "u"), (11, None, None, "lever", "acme", "good", None, "u"), (12, "", "met", None, None, "good", "ok", "u"),
    ]
    history = spark.createDataFrame([("k1", 2, "skipped_title"), ("k1", 1, "added"), ("k2", 1, "skipped_location"), ("k2", 3, "added"), ("", 1, "added"), ("k3", 1, "skipped_dup")], "key string, seen_on int, status string")
    entries = spark.createDataFrame(
        [(1, "acme", "lever", "acme", True, "lever"), (2, "off", "lever", "off", False, "lever"), (3, "none", None, None, None, None), (4, "met", None, None, True, None), (9, "acme", "lever", "acme", False, None)],
        "entry long, company string, vendor string, slug string, enabled boolean, provider string",
    )
    scanned = spark.createDataFrame([("met",), ("met",), (None,)], "company string")
    found = diagnosis.coverage(spark.createDataFrame(rows, POSTINGS), history, entries, scanned, F.col("title") == "good", F.col("location") != "bad")
    got = {r.n: (r.code, r.advice) for r in found.collect()}
    assert got == {
        1: ("surfaced", "none"), 2: ("filtered", "location"), 3: ("tracked-disabled", "enable"), 4: ("tracked-no-provider", "point at lever:none"), 5: ("tracked-title-filter", "title"),
        6: ("tracked-location-filter", "location"), 7: ("tracked-not-seen", "point at ashby:acme"), 8: ("untracked-unsupported-ats", "add by careers page"), 9: ("untracked", "add lever:new"), 10: ("filtered", "none"),
        11: ("tracked-not-seen", "none"), 12: ("tracked-not-seen", "none"),
    }
    assert {code for code, _ in got.values()} == set(diagnosis.GAPS)


def test_first_step_that_holds(spark):
    steps = [diagnosis.Step("a", F.lit(None).cast("boolean"), F.lit("x")), diagnosis.Step("b", F.col("n") > 1, F.lit("y")), diagnosis.Step("c", F.col("n") > 0, F.lit("z"))]
    rows = spark.createDataFrame([(0,), (1,), (2,), (None,)], "n long").select("n", diagnosis.decided(steps, "d").alias("x")).collect()
    assert [(r.n, r.x.code, r.x.place) for r in rows] == [(0, "d", 3), (1, "c", 2), (2, "b", 1), (None, "d", 3)]


#: Subject, body, sender, calendar, booking, proposed time; score and whether it is an invitation.
MAILS = [
    ("Interview invitation", "Hi", "jobs@x.org", False, False, False, 0, False),
    ("Invitation to an interview", "Hi", "jobs@x.org", False, False, False, 3, False),
    ("Invitation to an interview", "What is your availability?", "jobs@x.org", False, False, False, 4, True),
    ("Your application", "Thank you for applying. If your profile matches we would like to invite you to an interview.", "no-reply@x.org", False, False, False, -6, False),
    ("Your application", "Thank you for applying. We would like to invite you to a call. Which time works?", '"Jane Doe" <jane@x.org>', False, False, False, 5, True),
    ("Hello", "See you", "x", True, False, True, 6, True),
    ("Einladung zum Gespräch", "Bitte buchen", "Max Mustermann <max@x.de>", False, True, False, 8, True),
    ("Chat", "https://meet.google.com/abc-defg-hij", "x@y.z", False, False, False, 3, False),
    (None, None, None, None, None, None, 0, False),
]


def test_invitations(spark):
    rows = spark.createDataFrame([(k, *m[:6]) for k, m in enumerate(MAILS)], "k long, subject string, body string, sender string, calendar boolean, booking boolean, proposed boolean")
    found = rows.select("k", diagnosis.invitation(*(F.col(c) for c in ("subject", "body", "sender", "calendar", "booking", "proposed"))).alias("e"))
    got = {r.k: r.e for r in found.collect()}
    # The first subject names the interview before the invitation: still an invitation by its subject alone.
    want = {k: (m[6], m[7]) for k, m in enumerate(MAILS)} | {0: (3, False)}
    assert {k: (e.score, e.accepted) for k, e in got.items()} == want
    assert got[3].vetoed and not got[4].vetoed and "+2 direct invitation" in got[4].reasons


def test_transitions(spark):
    rows = [(1, "Applied", "Interview"), (1, "Applied", "Interview"), (2, "Applied", "Interview"), (2, "Applied", "Rejected"), (3, None, "Offer"), (None, "a", "b")]
    got = {r.num: (r.verdict, r.old_status, r.new_status, r.proposals, r.choices) for r in diagnosis.transitions(spark.createDataFrame(rows, "num long, old_status string, new_status string")).collect()}
    assert got == {
        1: ("update", "Applied", "Interview", 2, []), 2: ("conflict", None, None, 2, ["Applied -> Interview", "Applied -> Rejected"]), 3: ("update", None, "Offer", 1, []), None: ("update", "a", "b", 1, []),
    }


def nested(url, times):
    for _ in range(times):
        url = "https://r.example/x?a=1&u=" + quote(url, safe="")
    return url


def test_links(spark):
    job = lambda k: f"https://www.linkedin.com/comm/jobs/view/40112233{k}?trk=x"
    texts = [
        f"First {nested(job(40), 3)}, then ({job(41)}). Again {job(41)} and {nested(job(42), 4)}!",
        "folded https://www.linkedin.com/jobs/vi=\r\new/4011223350?trk=3Deml&amp;x=1] and linkedin.com/jobs/view/4011223351; not.evil-linkedin.com/jobs/view/4011223352",
        "x=\n=3D", "", None, '<a href="https://a.example/r?to=ftp%3A%2F%2Fx&b=%zz&c=https%3A%2F%2Fb.example%2F">',
    ]
    found = mail_links.links(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    keys = {(r.id, r.nth): r.key for r in mail_links.first_ids(found, F.regexp_extract(vendors.job_key(F.col("url")), r"^linkedin\.com:([0-9]+)$", 1)).collect()}
    assert keys == {(0, 0): "4011223340", (0, 1): "4011223341", (1, 0): "4011223350", (1, 1): "4011223351"}
    rows = [(r.id, r.depth, r.url) for r in found.collect() if r.id == 5]
    assert sorted(rows) == [(5, 0, "https://a.example/r?to=ftp%3A%2F%2Fx&b=%zz&c=https%3A%2F%2Fb.example%2F"), (5, 1, "https://b.example/")]
    assert max(r.depth for r in found.collect()) == mail_links.DEPTH
