"""Readers of reports, tables, lists, feeds and messages."""

import gzip

from pyspark.sql import functions as F

from siltstone.sources import documents as d


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_pipe_cells(spark):
    rows = spark.createDataFrame([(r"| a | b \| c | d\\| e |",), ("|x|",), ("",)], "line string")
    assert [r["c"] for r in rows.select(d.pipe_cells(F.col("line")).alias("c")).collect()] == [["a", "b | c", "d\\", "e"], ["x"], [""]]


def test_first_table_and_state(spark, tmp_path):
    path = put(tmp_path / "a.md", "# T\n\n| # | Company |\n|---|:-:|\n| 1 | A |\n| 2 |\n| 3 | C |\ntext\n| x | y |\n| 9 | Z |\n")
    assert [(r["place"], r["cells"]) for r in d.first_table(spark, path).orderBy("place").collect()] == [(0, ["#", "Company"]), (1, ["1", "A"]), (2, ["3", "C"])]
    assert d.tracker_state(spark, path) == "rows"
    assert d.tracker_state(spark, put(tmp_path / "b.md", "| Company |\n|---|\n")) == "empty"
    assert d.tracker_state(spark, put(tmp_path / "c.md", "nothing\n")) == "malformed"
    assert d.tracker_state(spark, str(tmp_path / "none.md")) == "missing"


def test_pending(spark, tmp_path):
    path = put(tmp_path / "p.md", "# Inbox\n- [ ] https://a.com/0\n## Pendientes\n- [ ] https://a.com/1 | A | R\n- [x] https://a.com/2\n- [ ] https://A.com/1/?utm_source=x | later\n## Done\n- [ ] https://a.com/3\n")
    assert [(r["key"], r["rest"]) for r in d.pending(spark, path).collect()] == [("https://a.com/1", "A | R")]


def test_csv_and_lists(spark, tmp_path):
    path = put(tmp_path / "c.csv", 'Company,Link,Note\n"A ""x"", Inc",https://a.com,"two\nlines"\n,https://b.com,\n')
    rows = d.csv_rows(spark, path, {"url": ("url", "link"), "name": ("name", "company"), "other": ("company",)}).collect()
    assert [tuple(r) for r in rows] == [("https://a.com", 'A "x", Inc', ""), ("https://b.com", "", "")]
    path = put(tmp_path / "l.txt", "url,name\nhttps://a.com,A\nB\twww.b.com\n\nnothing\n")
    assert [(r["url"], r["name"]) for r in d.url_list(spark, path).orderBy("seq").collect()] == [("https://a.com", "A"), ("www.b.com", "B")]


def test_reports(spark, tmp_path):
    text = '# Acme - Role\n**Score:** 4.2/5\n**URL:** https://x.com:80/a\n\n## A\nNot: this\n---SCORE_SUMMARY---\nTotal: 4.2\nFit: 3\nFit: 4\n---END_SCORE_SUMMARY---\n## Machine Summary\n\n```yaml\ncompany: "Acme"\nhard_stops:\n  - "visa"\n  - travel\nscore: 4.2\n```\n'
    (tmp_path / "r").mkdir()
    put(tmp_path / "r" / "1.md", text)
    put(tmp_path / "r" / "2.md", "no heading\n## Machine Summary\n## Machine Summary\n")
    path = str(tmp_path / "r")
    assert [r["values"] for r in d.score_summaries(spark, path).collect()] == [{"total": "4.2", "fit": "4"}]
    head = d.report_headers(spark, path).where("title != ''").first()
    assert head["title"] == "Acme - Role" and head["values"] == {"score": "4.2/5", "url": "https://x.com:80/a"}
    summary = d.machine_summaries(spark, path).collect()
    assert [(r["values"], r["lists"]) for r in summary] == [({"company": "Acme", "score": "4.2"}, {"hard_stops": ["visa", "travel"]})]


def test_feeds_messages_and_json(spark, tmp_path):
    path = put(tmp_path / "f.xml", "<rss><channel><item><title> T </title><link>https://a</link></item><item><title>none</title></item></channel></rss>")
    assert [tuple(r) for r in d.feed_items(spark, path).collect()] == [("T", "https://a", None)]
    path = put(tmp_path / "m.txt", "From: A <a@b.c>\nSubject: Hello\n\nBody: one\n\ntwo\n")
    row = d.messages(spark, path).first()
    assert (row["subject"], row["sender"], row["body"]) == ("Hello", "A <a@b.c>", "Body: one\n\ntwo")
    with gzip.open(tmp_path / "x.jsonl.gz", "wt") as out:
        out.write('{"a": 1}\nbroken\n{"a": 2, "b": 3}\n')
    assert [r["a"] for r in d.json_lines(spark, str(tmp_path / "x.jsonl.gz"), "a long").collect()] == [1, 2]
