"""Temporal list join against a plain version, in both of its join forms."""

import datetime as dt
import random

import pytest

from siltstone.llm import op3_url_lists as op


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def plain(captures, entries):
    out = set()
    for i, url, at in captures:
        if url is None or at is None or "://" not in url:
            continue
        rest = url.split("://", 1)[1].split("?")[0].split("#")[0]
        host, _, path = rest.partition("/")
        host = host.split("@")[-1].split(":")[0].lower().rstrip(".")
        if not host:
            continue
        labels = host.split(".")
        keys = {host, *(".".join(labels[-k:]) for k in range(1, min(len(labels), op.MAX_LABELS) + 1))}
        parts = [p for p in path.split("/") if p]
        keys |= {host + "/" + "/".join(parts[:k]).lower() for k in range(1, min(len(parts), op.MAX_SEGMENTS) + 1)}
        for name in {e[0] for e in entries}:
            for key in keys:
                past = [e for e in entries if e[0] == name and e[1].lower() == key and e[3] <= at]
                if past:
                    last = max(e[3] for e in past)
                    if all(e[2] == "add" for e in past if e[3] == last):
                        out.add((i, name, key))
    return out


@pytest.mark.parametrize("limit", [op.BROADCAST_INTERVALS, 0])
def test_against_plain(spark, monkeypatch, limit):
    monkeypatch.setattr(op, "BROADCAST_INTERVALS", limit)
    rng = random.Random(1)
    hosts = ["a.example.com", "example.com", "b.a.example.com", "example.org", "localhost"]
    entries = [(rng.choice("xy"), rng.choice([*hosts, "Example.com/p", "example.org/p/q"]), rng.choice(["add", "remove"]), day(rng.randrange(20))) for _ in range(60)]
    captures = [(i, f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/p', '/P/q?x', ':80/p/q/r/s#t'])}", day(rng.randrange(22))) for i in range(200)]
    captures += [(900, None, day(3)), (901, "nonsense", day(3)), (902, "http://example.com", None), (903, "http://", day(1)), (904, "http://u@EXAMPLE.com./", day(19))]
    c = spark.createDataFrame(captures, "id long, url string, at date")
    e = spark.createDataFrame(entries, "list string, key string, action string, effective_at date")
    got = [(r["id"], r["list"], r["key"]) for r in op.temporal_list_join(c, e, "id", "url", "at").collect()]
    assert len(got) == len(set(got)) and set(got) == plain(captures, entries)


def test_empty_list_and_nulls(spark):
    c = spark.createDataFrame([(1, "http://x.org", day(1))], "id long, url string, at date")
    e = spark.createDataFrame([], "list string, key string, action string, effective_at date")
    assert op.temporal_list_join(c, e, "id", "url", "at").count() == 0
    e = spark.createDataFrame([("x", None, "add", day(0)), ("x", "x.org", "add", None), (None, "x.org", "add", day(0))], e.schema)
    assert op.temporal_list_join(c, e, "id", "url", "at").count() == 0


def test_plan_has_no_python(spark):
    c = spark.createDataFrame([(1, "http://x.org", day(1))], "id long, url string, at date")
    e = spark.createDataFrame([("x", "x.org", "add", day(0))], "list string, key string, action string, effective_at date")
    plan = op.temporal_list_join(c, e, "id", "url", "at")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_entries_of_one_label(spark):
    """A top-level domain, and an internal host without a dot."""
    captures = spark.createDataFrame([(1, "https://a.example.com/x", "2024-05-01"), (2, "http://intranet//a", "2024-05-01"), (3, "https://com.example.org/", "2024-05-01")], "id long, url string, day string")
    entries = spark.createDataFrame([("block", "com", "add", "2024-01-01"), ("block", "intranet/a", "add", "2024-01-01"), ("review", "intranet", "add", "2024-01-01")], "list string, key string, action string, effective_at string")
    got = {(r["id"], r["list"], r["key"]) for r in op.temporal_list_join(captures, entries, "id", "url", "day").collect()}
    assert got == {(1, "block", "com"), (2, "review", "intranet"), (2, "block", "intranet/a")}


def test_deep_entries(spark):
    c = spark.createDataFrame([(1, "http://x.a.b.c.d.e.org/1/2/3/4/5", day(1)), (2, "http://h.org/1/2/3/4/5", day(1)), (3, "http://h.org/1/2/3", day(1))], "id long, url string, at date")
    e = spark.createDataFrame([("x", "a.b.c.d.e.org", "add", day(0)), ("x", "h.org/1/2/3/4", "add", day(0))], "list string, key string, action string, effective_at date")
    got = {(r["id"], r["key"]) for r in op.temporal_list_join(c, e, "id", "url", "at").collect()}
    assert got == {(1, "a.b.c.d.e.org"), (2, "h.org/1/2/3/4")}


def test_odd_captures(spark):
    """Very long URLs, repeated rows, columns with the join's own names, and an empty table."""
    e = spark.createDataFrame([("x", "h.org/a/b", "add", day(0)), ("x", "z.h.org", "add", day(0))], "list string, key string, action string, effective_at date")
    long_ = "http://" + "a." * 5000 + "z.h.org/" + "s/" * 50_000
    rows = [(1, "http://h.org/a/b/c", day(1), "k", 1, "l"), (1, "http://h.org/a/b/c", day(1), "k", 1, "l"), (2, long_, day(1), "k", 2, "l")]
    c = spark.createDataFrame(rows, "id long, url string, at date, key string, salt int, list string")
    assert sorted((r["id"], r["key"]) for r in op.temporal_list_join(c, e, "id", "url", "at").collect()) == [(1, "h.org/a/b"), (1, "h.org/a/b"), (2, "z.h.org")]
    assert op.temporal_list_join(c.where("false"), e, "id", "url", "at").count() == 0
