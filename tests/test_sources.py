"""Readers and writers over small files."""

from pyspark.sql import functions as F

from siltstone.sources import readers, writers


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_history(spark, tmp_path):
    path = put(tmp_path / "h.tsv", "url\tfirst_seen\tportal\nhttps://x\t2024-01-01\tp\t'=t\n\nhttps://y\r\n")
    rows = readers.history(spark, path).orderBy("seq").collect()
    assert [(r["url"], r["title"], r["employment_type"]) for r in rows] == [("https://x", "=t", ""), ("https://y", "", "")]


def test_status_log(spark, tmp_path):
    path = put(tmp_path / "l.tsv", "1\t2024-01-01\tApplied\tResponded\tweb\t\n2junk\t2024-01-01\ta\tb\n3\t2026-02-30\ta\tb\n4\t2024-01-02\ta\t\n5\t2024-01-03\ta\t-\n")
    assert [(r["num"], r["target"]) for r in readers.status_log(spark, path).orderBy("seq").collect()] == [(1, "Responded"), (5, "-")]


def test_tracker(spark, tmp_path):
    path = put(tmp_path / "t.md", "# Apps\n| # | Date | Company | Role | Score | Status | PDF |\n|---|---|---|---|---|---|---|\n| 1 | 2024-01-01 | A | R | 4.2/5 | Applied | ✅ |\n| x | | | | | | |\n| 2 | | B | S | N/A | SKIP | ❌ |\n")
    rows = readers.tracker(spark, path).orderBy("n").collect()
    assert [(r["n"], r["company"], r["score"], r["has_score"], r["pdf"]) for r in rows] == [(1, "A", 4.2, True, True), (2, "B", None, False, False)]


def test_inbox(spark, tmp_path):
    path = put(tmp_path / "i.md", "- [ ] https://x | Co | Role | Paris | posted: 2024 | rank: 3/5 | rank: 4/5\n- [x] https://y\nnoise\n")
    rows = readers.inbox(spark, path).orderBy("seq").collect()
    assert [(r["done"], r["url"], r["location"]) for r in rows] == [(False, "https://x", "Paris"), (True, "https://y", "")]
    assert rows[0]["labels"] == {"posted": "2024", "rank": "4/5"}


def test_discard_log(spark, tmp_path):
    path = put(tmp_path / "d.tsv", "t\thttps://x\tsalary\nt\t7\thttps://y\tstale\nbad\n")
    assert [(r["url"], r["reason"]) for r in readers.discard_log(spark, path).orderBy("seq").collect()] == [("https://x", "salary"), ("https://y", "stale")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("=x", "", 1), ('a"b', None, 2)], "a string, b string, c int")
    writers.export_csv(df, str(tmp_path / "out"), optional=("b",))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out")).orderBy("c").collect()
    assert [tuple(r) for r in back] == [("'=x", "1"), ('a"b', "2")]
    rows = spark.createDataFrame([("1\t2",), ("1\t2\t3\t4",)], "line string")
    assert [r["line"] for r in writers.migrated(rows, {2: ["x", "y"]}, ["y", "z", "x"]).collect()] == ["2\t\t1", "1\t2\t3\t4"]
    log = spark.createDataFrame([(1, "2024-01-01", "Applied", "-", "web", "a\tb")], "num long, date string, origin string, target string, source string, note string")
    writers.append_transitions(log, str(tmp_path / "log"))
    writers.append_transitions(log, str(tmp_path / "log"))
    got = readers.status_log(spark, str(tmp_path / "log"))
    assert got.agg(F.count("*")).first()[0] == 2 and got.first()["note"] == "a b"


def test_order_of_appends(spark, tmp_path):
    """A later, larger append keeps its place: Spark packs larger files first."""
    row = lambda target, note="": (1, "2024-01-01", "Applied", target, "web", note)
    schema = "num long, date string, origin string, target string, source string, note string"
    writers.append_transitions(spark.createDataFrame([row("Applied"), row("Interview")], schema).coalesce(1), str(tmp_path / "log"))
    later = [row("-", "x" * 500)] + [row("Responded", f"{k}" * 200) for k in range(50)]
    writers.append_transitions(spark.createDataFrame(later, schema).coalesce(1), str(tmp_path / "log"))
    got = [r["target"] for r in readers.status_log(spark, str(tmp_path / "log")).orderBy("seq").collect()]
    assert got == ["Applied", "Interview", "-"] + ["Responded"] * 50
    from siltstone.operators import ledger

    assert [r["target"] for r in ledger.fold(readers.status_log(spark, str(tmp_path / "log"))).orderBy("position").limit(2).collect()] == ["Applied", "Responded"]


def test_chunks_and_manifest(spark, tmp_path):
    writers.export_chunks(spark.range(12).selectExpr("CAST(id AS string) AS value").coalesce(1), str(tmp_path / "c"), rows=5)
    assert sorted(len(f.read_text().split()) for f in (tmp_path / "c").glob("part-*.txt")) == [2, 5, 5]
    rows = spark.createDataFrame([("/o/a.pdf",), ("/o/b.pdf",), ("/x/c.pdf",), ("/o/../c.pdf",)], "path string")
    files = spark.createDataFrame([("/o/a.pdf",), ("/x/c.pdf",), ("/o/../c.pdf",)], "path string")
    assert [r["path"] for r in writers.kept_manifest(rows, files, "/o").collect()] == ["/o/a.pdf"]


def test_postings(spark, tmp_path):
    path = put(tmp_path / "p.jsonl", '{"title": "T", "posted_at": 0, "salary": {"min": 1}, "other": 5}\n{"url": "u"}\n')
    rows = readers.postings(spark, path).collect()
    assert rows[0]["title"] == "T" and rows[0]["salary"]["min"] == 1.0 and rows[1]["title"] is None


def test_tracker_cells_with_escaped_pipes(spark, tmp_path):
    """An escaped pipe belongs to its cell."""
    (tmp_path / "t.md").write_text("| # | Company | Role | Score | Status |\n|-|-|-|-|-|\n| 1 | A \\| B | Lead \\\\ | 4.0/5 | Applied |\n| x | C | D | 1/5 | Applied |\n")
    (row,) = readers.tracker(spark, str(tmp_path / "t.md")).collect()
    assert (row.n, row.company, row.role) == (1, "A | B", "Lead \\")
