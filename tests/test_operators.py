"""Operators against expected values and plain Python versions."""

import datetime as dt
import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from siltstone.operators import joins, ledger, metrics, mining, roles, similarity, state
from siltstone.operators.lineage import settled
from siltstone.plans import registry


def tracker(spark, counts):
    rows = [(i, s, 4.0) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    return spark.createDataFrame(rows, "n long, status string, score double")


@pytest.mark.parametrize(
    ("counts", "want"),
    [
        ({"Applied": 4, "Responded": 2, "Interview": 1, "Offer": 1, "Rejected": 2, "Evaluated": 9}, [19, 10, 6, 2, 1]),
        ({"Applied": 2, "Interview": 1, "Hired": 1}, [4, 4, 2, 2, 1]),
        ({"Applied": 1, "Assessment": 1}, [2, 2, 1, 0, 0]),
        ({}, [0, 0, 0, 0, 0]),
    ],
)
def test_funnel(spark, counts, want):
    rows = tracker(spark, counts)
    assert [r["count"] for r in metrics.funnel(rows).orderBy("position").collect()] == want
    rates = metrics.rates(rows).first()
    assert (rates["response_rate"] is None) == (want[1] == 0)


def fold_plain(rows):
    seen, void = {}, {}
    for num, date, origin, target, source in rows:
        if num is None or date is None or not origin or not target:
            continue
        got = seen.setdefault(num, [])
        if target == "-":
            if got:
                void[num] = got.pop()[2]
            continue
        stale = void.pop(num, None)
        entry = (date, "-" if stale is not None and origin.upper() == stale.upper() else origin, target)
        at = max((i for i, g in enumerate(got) if g[2] == target), default=-1) if source == "correction" else -1
        if at < 0:
            got.append(entry)
        else:
            got[at] = entry
    return {k: v for k, v in seen.items() if v}


def test_ledger_fold_matches_plain(spark):
    rng = random.Random(5)
    stages = ["Applied", "Responded", "Interview", "Offer", "Rejected", "-", "-", ""]
    rows = [
        (rng.choice([None, *range(40)]), dt.date(2024, 1, 1 + rng.randrange(28)), rng.choice(stages[:5]), rng.choice(stages), rng.choice(["web", "correction"]))
        for _ in range(1500)
    ]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "num long, date date, origin string, target string, source string, seq long")
    got = {}
    for r in ledger.fold(df).orderBy("num", "position").collect():
        got.setdefault(r["num"], []).append((r["date"], r["origin"], r["target"]))
    assert got == fold_plain(rows)


def test_recovered_stages(spark):
    log = spark.createDataFrame([(1, 0, dt.date(2024, 1, 1), "Applied", "Interview"), (2, 0, dt.date(2024, 1, 1), "Applied", "Offer"), (9, 0, dt.date(2024, 1, 1), "Applied", "Offer")], "num long, position int, date date, origin string, target string")
    rows = spark.createDataFrame([(1, "Rejected"), (2, "SKIP"), (3, "Applied")], "n long, status string")
    found = ledger.recovered_stages(rows, log)
    assert {r["n"]: r["rank"] for r in found.collect()} == {1: 4, 3: 1}
    assert tuple(ledger.stage_tiles(found).first()) == (2, 1, 1, 0)


def test_velocity(spark):
    d = dt.date
    log = spark.createDataFrame(
        [(1, 0, d(2024, 1, 1), "", "Applied"), (1, 1, d(2024, 1, 4), "", "Responded"), (1, 2, d(2024, 2, 1), "", "Applied"), (1, 3, d(2024, 2, 6), "", "Responded"), (2, 0, d(2024, 1, 1), "", "Applied")],
        "num long, position int, date date, origin string, target string",
    )
    assert tuple(ledger.velocity(log, "RESPONDED").first()) == (4.0, 2, 1)


def simhash_plain(value):
    words = re.sub(r" {2,}", " ", re.sub(r"[^a-z0-9]+", " ", value.lower())).strip().split(" ")
    if len(" ".join(words)) < 200 or len(words) < 3:
        return None
    sums = [0] * 64
    for i in range(len(words) - 2):
        h = int.from_bytes(hashlib.sha1(" ".join(words[i : i + 3]).encode()).digest()[:8], "big")
        for b in range(64):
            sums[b] += 1 if h >> b & 1 else -1
    out = sum(1 << b for b in range(64) if sums[b] > 0)
    return out - (1 << 64) if out >> 63 else out


def test_simhash_and_bands(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(80)) for _ in range(12)]
    docs = [(i, t if i % 3 or not t else t.replace("alpha", "omega", 1)) for i, t in enumerate(itertools.chain(base, base, [None, "short"]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["id"]: r["fingerprint"] for r in similarity.simhash64(df, "doc_id", "text").collect()}
    assert got == {i: h for i, t in docs if t and (h := simhash_plain(t)) is not None}
    prints = spark.createDataFrame(list(got.items()), "id long, fingerprint long")
    pairs = {(r["left_id"], r["right_id"]) for r in similarity.hamming_join(prints.where("id % 2 = 0"), prints.where("id % 2 = 1")).collect()}
    near = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 5
    assert pairs == {(a, b) for a in got for b in got if a % 2 == 0 and b % 2 == 1 and near(got[a], got[b])}


def test_jaccard_classes(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(rng.randrange(0, 9)))) for i in range(60)]
    found = similarity.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string"), 0.6, "doc_id", "text").collect()
    classes = {}
    for i, t in docs:
        if t:
            classes.setdefault(frozenset(t.split()), []).append(i)
    want = {}
    for x, a in classes.items():
        for y, b in classes.items():
            if a[0] < b[0] and len(x & y) / len(x | y) >= 0.6:
                want[a[0], b[0]] = (len(x & y) / len(x | y), len(a), len(b))
    assert {(r["left_id"], r["right_id"]): (r["similarity"], r["left_copies"], r["right_copies"]) for r in found} == want and len(want) > 5



def test_admission_is_stateful(spark):
    rows = spark.createDataFrame([("u", "bad", 1), ("u", "ok", 2), ("v", "ok", 3)], "url string, company string, seq long")
    yes = F.lit(True)
    got = {r["seq"]: r["reason"] for r in joins.admission(rows, F.col("company") == "bad", yes, yes).collect()}
    assert got == {1: "blacklisted", 2: "seen", 3: "admitted"}


def test_numbered_is_dense(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1009).alias("seq"))
    got = [r["id"] for r in joins.numbered(rows, "seq", 5).orderBy("seq").collect()]
    assert got == list(range(6, 1006))


def test_sankey_rolls_up(spark):
    rows = spark.createDataFrame([(1, "Assessment"), (2, "Speculative"), (3, "Discarded"), (4, "Rejected")], "n long, status string")
    seen = spark.createDataFrame([(3, "APPLIED"), (4, "INTERVIEW")], "num long, stage string")
    nodes = {r["node"]: r["value"] for r in metrics.sankey_nodes(rows, seen).collect()}
    assert nodes == {"tracked": 4, "speculative": 1, "submitted": 3, "discarded": 1, "engaged": 2, "assessment": 1, "rejectedInterview": 1}


def test_lift_and_frequency(spark):
    docs = spark.createDataFrame([("rust go",), ("rust",), ("rust java",), (None,)], "text string")
    lift = {r["term"]: (r["pos"], r["base"]) for r in mining.term_lift(docs, docs.where("text = 'rust'"), "text").collect()}
    assert lift == {"rust": (3, 1)}
    assert mining.document_frequency(docs, "text", top=1).first()["df"] == 3


def test_roles(spark):
    titles = ["Senior Data Engineer", "Data Engineer", "data engineer", "Data Platform Engineer", "Sales Manager", None]
    df = spark.createDataFrame([(t,) for t in titles], "title string")
    got = {(r[0], r[1]) for r in roles.role_matches(df, df).collect() if r[0] < r[1]}
    assert got == {("Data Engineer", "data engineer"), ("Data Engineer", "Data Platform Engineer"), ("Data Platform Engineer", "data engineer")}


def test_dead_boards(spark):
    rows = [("a", 1, True), ("a", 2, False), ("a", 3, True), ("b", 1, True), ("b", 2, True), ("b", 3, True), ("b", 4, True), ("c", 1, False)]
    df = spark.createDataFrame(rows, "board string, seq long, missing boolean")
    assert {tuple(r) for r in state.dead_boards(df).collect()} == {("a", 1), ("b", 3)}


def test_settled_columns_are_computed_once(spark, capsys):
    rows = settled(spark.createDataFrame([("a-b",), (None,), ("c",)], "x string"), F.regexp_replace("x", "marker|-", "").alias("key"), "x")
    kept = rows.where("key != 'c'").groupBy("key").agg(F.max("x").alias("x"))
    kept.explain("simple")
    assert capsys.readouterr().out.count("marker|-") == 1
    assert [tuple(r) for r in kept.collect()] == [("ab", "a-b")]


def test_queries_compute_job_keys_once(spark, capsys):
    for name, times in (("inbox_pending", 2), ("evaluated_match", 3), ("known_postings", 3), ("close_by_url", 1), ("coverage_diagnosis", 2)):
        registry.QUERIES[name](spark, "/root/testdata/sf0.001").explain("simple")
        assert capsys.readouterr().out.count("currentJobId=([") == 2 * times, name  # each key shows the pattern twice


def test_rare_tokens_come_first(spark, monkeypatch):
    monkeypatch.setattr(similarity, "KNOWN_TOKENS", 1)
    sets = spark.createDataFrame([(k, [1, 2, 3, 5000 - k]) for k in range(300)], "id long, tokens array<long>")
    prefix = sets.mapInArrow(similarity._prefixes(0.8, *similarity._frequencies(sets)), "id long, n int, place int, token long, last long")
    assert sorted(tuple(r) for r in prefix.collect()) == [(k, 4, 1, 5000 - k, 0) for k in range(300)]


def written(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_near_copies_are_paired_without_shuffling_pairs(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{k}x" for k in range(4000)]
    base = rng.sample(words, 300)
    sets = {k: set(rng.sample(base, 285)) | set(rng.sample(words, rng.randrange(30))) for k in range(300)}
    sets |= {k: set(rng.sample(words, rng.randrange(1, 60))) for k in range(300, 340)}
    docs = [(k, " ".join(sorted(x))) for k, x in sets.items()]
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(similarity, "PART", 60, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written(spark)
        found = {(r[0], r[1]): r[2] for r in similarity.jaccard_classes(df, 0.8, "doc_id", "text").collect()}
        moved = written(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == want and len(want) > 30_000
    assert moved < 6 * 8 * sum(map(len, sets.values())), moved


def test_jaccard_classes_of_any_size(spark):
    rng = random.Random(4)
    # Long sets fill slots, and more than a byte counts.
    base = [f"t{k}" for k in range(3000)]
    sizes = rng.choices((1, 4, 40, 140, 3000), k=160)
    sets = {f"i{k}": set(rng.sample(base[:most], rng.randrange(most * 3 // 4, most) + 1)) for k, most in enumerate(sizes)}
    docs = spark.createDataFrame([(k, " ".join(sorted(x))) for k, x in sets.items()], "doc_id string, text string")
    for threshold in (0.5, 0.8, 0.95):
        classes = {}
        for k, x in sorted(sets.items()):
            classes.setdefault(frozenset(x), []).append(k)
        named = [(x, ks[0], len(ks)) for x, ks in classes.items()]
        want = {(a, b): (len(x & y) / len(x | y), m, n) for x, a, m in named for y, b, n in named if a < b and len(x & y) / len(x | y) >= threshold}
        found = similarity.jaccard_classes(docs, threshold, "doc_id", "text").collect()
        assert {(r[0], r[1]): tuple(r[2:]) for r in found} == want and len(found) == len(want) > 20
