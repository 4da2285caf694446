"""The pipeline's stages on a small corpus with planted cases."""

import random

import corpus_pipeline
from pyspark.sql import functions as F


def corpus(tmp_path, spark):
    rng = random.Random(11)
    words = ["w%d" % k for k in range(400)]
    text = lambda n: "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(n))
    rows = [(i, text(4)) for i in range(300)]
    item = " ".join(rng.choice(words) for _ in range(40))
    labels = [(i, 1, 0) for i in range(300)]
    for i in range(300, 400):
        rows.append((i, text(2) + " idiot moron " + text(1) + " stupid"))
        labels.append((i, 0, 1))
    near = rows[5][1].replace("\n", " ").split(" ")
    near[3] = "changed"
    planted = {900: rows[1][1], 901: text(2) + "\n" + item + "\n" + text(1), 902: " ".join(near), 903: None, 904: "", 905: text(2) + "\n" + "\n".join(rows[7][1].split("\n")[1:3])}
    edited = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(20)]
    planted |= {906: "\n".join(edited), 907: "\n".join([*edited[:9], edited[9].replace(" ", " edited ", 1), *edited[10:]])}
    rows += list(planted.items())
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return dict(rows)


def test_stages(spark, tmp_path):
    rows = corpus(tmp_path, spark)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "near dedup", "decontamination", "packing"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, ids = docs.columns, [set(rows)]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out-{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out-{k}"))
        assert docs.columns == columns or k == 4
        ids.append({r[0] for r in docs.select("doc_id").collect()})
    assert ids[0] - ids[1] == set(range(300, 400))
    assert ids[1] - ids[2] == {900}
    assert ids[2] - ids[3] == {902, 907}
    assert ids[3] - ids[4] == {901}
    assert ids[4] == ids[5]
    cut = spark.read.parquet(str(tmp_path / "out-1")).where(F.col("doc_id") == 905).first()
    assert cut["text"] == "\n".join(rows[905].split("\n")[:2]) and cut["n_chars"] == len(cut["text"])


def test_odd_documents(spark, tmp_path):
    """Nulls, repeated ids, empty tables and clashing extra columns pass through every stage."""
    corpus(tmp_path, spark)
    names = ["doc_id", "text", "lang", "source", "n_chars", "kept", "_kept", "_text_sha256", "n_removed", "component_id", "label", "a.b"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, _kept string, _text_sha256 string, n_removed long, component_id long, label int, `a.b` int"
    body = "\n".join(f"a line of its own with number {k} and more" for k in range(4))
    rows = [(1, body), (1, body), (1, body + "\nnew"), (2, body), (3, None), (None, body), (None, None), (4, ""), (5, "x " * 9000), (6, None)]
    odd = spark.createDataFrame([(i, t, None, None, None, "k", None, "s", 1, 2, 3, 4) for i, t in rows], schema)
    for docs, least in ((odd, 8), (odd.where("false"), 0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            found = stage(spark, docs, str(tmp_path))
            assert k == 4 or found.columns == names
            found.write.mode("overwrite").parquet(str(tmp_path / f"odd-{k}-{least}"))
            docs = spark.read.parquet(str(tmp_path / f"odd-{k}-{least}"))
            if k == 1 and least:
                kept = sorted(r["text"] for r in docs.where("doc_id = 1").collect())
                assert kept == [body, body, body + "\nnew"]  # one id does not delete from itself
                assert docs.where("doc_id = 2").count() == 0
        assert docs.count() >= least


def test_run(spark, tmp_path):
    corpus(tmp_path, spark)
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
    assert found.select("doc_id").distinct().count() == 304
