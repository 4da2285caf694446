"""Employers, the registry's fold, dates as known, and the tail of growing files."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import asof, employers
from siltstone.sources import tail

REGISTRY = [
    ("ibm", "IBM Corporation", 90), ("meta", "Metabolic Diagnostics Inc", 50), ("msft", "Microsoft", 70), ("acme-llc", "Acme LLC", 5), ("acme-inc", "Acme Inc", 5),
    ("home", "The Home Depot", 9), ("att", "AT&T", 3), ("apple-bank", "Apple Bank", 2), ("apple", "Apple Inc", 8), ("stripe", "Stripe Payments", 4), ("twin1", "Twin Cities", 6),
    ("twin2", "Twin Cities", 6), ("same", "Globex", 1), ("same", "Globex Corporation", 3), (None, "Nobody", 1), ("x", None, 1), ("none", "---", None),
]
WRITTEN = {
    "I.B.M.": ("ibm", "plausible"), "ibm corp": ("ibm", "plausible"), "IBM Corporation": ("ibm", "exact"), "Meta": (None, "none"), "Microsoft Corporation": ("msft", "plausible"),
    "Acme LLC": ("acme-llc", "exact"), "Acme": (None, "ambiguous"), "Home Depot": ("home", "plausible"), "apple": ("apple", "plausible"), "Apple Inc.": ("apple", "exact"),
    "Strpe Payments": ("stripe", "misspelt"), "Stripe Paymentss": ("stripe", "misspelt"), "Stride Payments": ("stripe", "misspelt"), "Strxxe Payments": (None, "none"),
    "Twin Cities": (None, "ambiguous"), "Globex": ("same", "exact"), "": (None, "none"), "...": (None, "none"), None: (None, "none"), "at&t": ("att", "exact"),
}


def test_employers(spark):
    registry = spark.createDataFrame(REGISTRY, "key string, name string, evidence long")
    names = spark.createDataFrame(list(enumerate(WRITTEN)), "id long, name string")
    got = {r.id: (r.key, r.reason) for r in employers.resolve_employers(names, registry).collect()}
    assert {name: got[k] for k, name in enumerate(WRITTEN)} == WRITTEN


def test_a_block_has_two_rows_however_many_employers_share_it(spark):
    """Five hundred names that begin alike: the one with the most evidence, found among two."""
    registry = spark.createDataFrame([(str(k), f"Global Widgets {k}", k) for k in range(500)], "key string, name string, evidence long")
    names = spark.createDataFrame([(1, "Global Widgets"), (2, "Global Widgets 7"), (3, "Global")], "id long, name string")
    got = {r.id: (r.key, r.reason) for r in employers.resolve_employers(names, registry).collect()}
    assert got == {1: ("499", "plausible"), 2: ("7", "exact"), 3: ("499", "plausible")}


SCHEMA = "host string, board string, url string, contribution string, seq long"


def test_fold_in_any_order(spark):
    rng = random.Random(23)
    make = lambda n: [(f"h{rng.randrange(4)}", rng.choice(["a", "b", None]), f"u{k}", f"c{rng.randrange(5)}", k) for k in range(n)]
    registry, one, two = (spark.createDataFrame(make(n), SCHEMA) for n in (5, 20, 20))
    fold = lambda a, b: employers.fold_identities(a, b, ("host", "board"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    first = fold(fold(registry, one), two)
    assert rows(first) == rows(fold(fold(registry, two), one))
    assert rows(first) == rows(fold(first, one)) == rows(fold(first, registry))
    assert len(rows(first)) == len({(r[0], r[1]) for r in rows(first)})


def test_fold_report(spark):
    registry = spark.createDataFrame([("h", "a", "u", "c0", 1)], SCHEMA)
    inbox = spark.createDataFrame([("h", "a", "u", "c1", 2), ("h", "b", "u", "c1", 3), ("h", "b", "u", "c2", 4), ("h", "b", "v", "c1", 5), ("i", "a", "u", "c2", 6), (None, "a", "u", "c3", 7)], SCHEMA)
    got = {r.contribution: (r.added, r.skipped) for r in employers.fold_report(registry, inbox, ("host", "board")).collect()}
    assert got == {"c1": (1, 2), "c2": (1, 1)}
    assert employers.fold_report(employers.fold_identities(registry, inbox, ("host", "board")), inbox, ("host", "board")).agg(F.sum("added")).first()[0] == 0


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_last_known(spark, width):
    """Against all pairs, with pieces of one day, of a week, and of all time."""
    rng = random.Random(16)
    day = lambda: datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randrange(60))
    rows = [(k, rng.choice(["a", "b", None]), day()) for k in range(80)]
    changes = [(rng.choice(["a", "b", None]), rng.choice(["cv", "profile", "other"]), day()) for _ in range(60)]
    left, right = spark.createDataFrame(rows, "n long, key string, day date"), spark.createDataFrame(changes, "key string, source string, day date")
    got = {r.n: (r.cv, r.profile) for r in asof.last_known(left, right, "key", "day", ("cv", "profile"), width).collect()}
    last = lambda key, at, source: max((d for k, s, d in changes if k == key and s == source and d <= at), default=None)
    assert got == {n: (last(key, at, "cv"), last(key, at, "profile")) for n, key, at in rows}


def test_reevaluation(spark):
    d = datetime.date
    rows = spark.createDataFrame([(1, "me", d(2024, 5, 1), d(2024, 1, 10)), (2, "me", d(2024, 5, 1), d(2024, 4, 1)), (3, "you", d(2024, 5, 1), d(2024, 1, 1)), (4, "me", d(2024, 5, 1), None)], "n long, key string, day date, evaluated date")
    changes = spark.createDataFrame([("me", "cv", d(2024, 2, 1)), ("me", "profile", d(2024, 3, 1)), ("me", "digest", d(2024, 3, 1)), ("me", "cv", d(2024, 6, 1)), ("me", "other", d(2024, 4, 9))], "key string, source string, day date")
    (row,) = asof.reevaluation_candidates(rows, changes, "key", "day", "evaluated", ("cv", "profile", "digest")).collect()
    assert row.n == 1 and row.latest == d(2024, 3, 1)
    assert [(x.source, x.changed) for x in row.changed_since] == [("profile", d(2024, 3, 1)), ("digest", d(2024, 3, 1)), ("cv", d(2024, 2, 1))]


def test_evaluation_date(spark):
    d = datetime.date
    row = spark.createDataFrame([(d(2024, 1, 1), d(2024, 2, 1), None, d(2024, 2, 1))], "a date, b date, c date, e date")
    latest, names = asof.evaluation_date({c: F.col(c) for c in "abce"})
    got = row.select(latest.alias("latest"), names.alias("names")).first()
    assert got.latest == d(2024, 2, 1) and got.names == ["b", "e"]


def write(path, text, mode="w"):
    with open(path, mode) as handle:
        handle.write(text)


def test_tail_stream(spark, tmp_path):
    """Appends, a torn last line, a restart from the checkpoint, rewrites, new files and removed ones."""
    folder, done = tmp_path / "logs", tmp_path / "checkpoint"
    (folder / "deep").mkdir(parents=True)
    spark.dataSource.register(tail.LineTail)

    def batch():
        lines = spark.readStream.format("line_tail").option("path", str(folder)).option("chunk", "7").load()
        query = lines.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(done)).start()
        query.processAllAvailable()
        query.stop()
        return sorted((os.path.basename(r.file), r.line) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    write(folder / "a.jsonl", '{"a": 1}\n{"a": 2}\n{"a"')
    write(folder / "deep" / "b.jsonl", "ä1\r\n")
    write(folder / "c.txt", "no\n")
    first = [("a.jsonl", '{"a": 1}'), ("a.jsonl", '{"a": 2}'), ("b.jsonl", "ä1")]
    assert batch() == first
    assert batch() == first, "nothing new"
    write(folder / "a.jsonl", ": 3}\n", "a")
    write(folder / "deep" / "b.jsonl", "ä2", "a")
    second = sorted([*first, ("a.jsonl", '{"a": 3}')])
    assert batch() == second
    write(folder / "a.jsonl", "new\n")  # shorter
    write(folder / "deep" / "b.jsonl", "öther and longer\nlines\n")  # longer, other beginning
    write(folder / "d.jsonl", "d\n")
    third = sorted([*second, ("a.jsonl", "new"), ("b.jsonl", "öther and longer"), ("b.jsonl", "lines"), ("d.jsonl", "d")])
    assert batch() == third
    os.remove(folder / "d.jsonl")
    assert batch() == third


def test_ranges_share_no_line(tmp_path):
    """Every cut of a file into ranges gives each line once."""
    text = "".join("x" * (k % 5) + "\n" for k in range(40)) + "torn"
    write(tmp_path / "f.jsonl", text)
    path, lines = str(tmp_path / "f.jsonl"), text.split("\n")[:-1]
    end = tail.place_of(path)["end"]
    assert end == len(text) - 4
    for chunk in range(1, 30):
        reader = tail.TailReader({"path": str(tmp_path), "chunk": chunk})
        parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
        got = sorted((place, line) for p in parts for _, place, line in reader.read(p))
        assert [line for _, line in got] == lines and len({place for place, _ in got}) == len(lines)
