"""Streaming forms, driven to completion over small file sources."""

import datetime as dt

from siltstone.streaming import stateful


def run(query_df, mode, spark, name):
    query = query_df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return [tuple(r) for r in spark.sql(f"SELECT * FROM {name}").collect()]


def source(spark, tmp_path, rows, schema):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del i
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def test_dead_board_counter(spark, tmp_path):
    rows = [[("a", 1, True), ("b", 1, True), ("b", 2, True), ("b", 3, True), ("b", 4, True), ("a", 2, False), ("a", 3, True)]]
    got = run(stateful.dead_board_counter(source(spark, tmp_path, rows, "board string, seq long, missing boolean")), "update", spark, "boards")
    assert sorted(got) == [("a", 1), ("b", 3)]


def test_admitted(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [[("u", t), ("u", t), ("v", t)]]
    got = run(stateful.admitted(source(spark, tmp_path, rows, "url string, ts timestamp")), "append", spark, "offers")
    assert sorted(r[0] for r in got) == ["u", "v"]


def test_rolling_usage(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [[(1, t, 7, 2.0), (1, t, 7, 2.0), (2, t + dt.timedelta(hours=1), 7, 3.0)]]
    got = run(stateful.rolling_usage(source(spark, tmp_path, rows, "event_id long, ts timestamp, user_id long, value double"), 5), "append", spark, "usage")
    assert sorted((r[0], r[3], r[4]) for r in got) == [(1, 2.0, 1), (2, 5.0, 2)]
    more = stateful.rolling_usage(source(spark, tmp_path / "more", [[(k, t + dt.timedelta(hours=3 * k), 7, 1.0) for k in range(5)]], "event_id long, ts timestamp, user_id long, value double"), 5)
    assert sorted((r[0], r[3]) for r in run(more, "append", spark, "more")) == [(0, 1.0), (1, 2.0), (2, 2.0), (3, 2.0), (4, 2.0)]


def batches(spark, tmp_path, parts, make):
    """Run a stateful query once for each part, from its checkpoint on; the rows of each run."""
    schema, out = "event_id long, ts timestamp, user_id long, value double", []
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = make(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        query = query.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        rows = sorted((r.event_id, r.kind, r.total, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
        out.append([r for r in rows if r not in sum(out, [])])
    return out


def test_late_events(spark, tmp_path):
    """An event within the allowed time corrects the sums it belongs to; one behind it is marked, and counts nowhere."""
    t = dt.datetime(2024, 1, 1)
    at = lambda k, hours, value=1.0: (k, t + dt.timedelta(hours=hours), 7, value)
    parts = [[at(1, 10), at(2, 12), at(3, 20)], [at(4, 11)], [at(5, 5)], [at(1, 10, 9.0), at(6, 21)]]
    got = batches(spark, tmp_path, parts, lambda df: stateful.rolling_usage(df, 5, late_hours=12))
    assert got[0] == [(1, "first", 1.0, 1), (2, "first", 2.0, 2), (3, "first", 1.0, 1)]
    assert got[1] == [(2, "corrected", 3.0, 3), (4, "first", 2.0, 2)]
    assert got[2] == [(5, "late", None, 0)]
    assert got[3] == [(1, "corrected", 9.0, 1), (2, "corrected", 11.0, 3), (4, "corrected", 10.0, 2), (6, "first", 2.0, 2)]
