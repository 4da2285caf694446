"""Toxicity: folding, exceptions, and accuracy on texts held out."""

import math
import random
import zlib

from siltstone.llm import op8_toxicity as op
from siltstone.llm.common import texts


def test_fold():
    assert op.fold("1D10T") == "idiot" and op.fold("іdіоt") == "idiot" and op.fold("ｉｄｉｏｔ") == "idiot" and op.fold("id​iot") == "idiot"
    assert op.fold("word$$$ 2024 a@b") == "word    2024 aab"
    assert op.fold("мир") == "мир"
    assert op.fold("an I.D.I.O.T and s t u p i d!") == "an idiot and stupid!" and op.fold("a b c, e.g. x-y") == "a b c, e.g. x-y"


def test_features_and_exceptions():
    model = op.Model((("clown", 2.0, True), ("troll", 1.5, False)), ("clown fish",), (0, 0, 0, 0))
    automaton = model.matcher()
    hits = lambda t: round(math.expm1(op.features(op.fold(t), automaton)[2]))
    assert [hits(t) for t in ("a clown", "clowns", "cl0wn fish", "Trolling", "control", "clown clown fish", "")] == [1, 0, 0, 1, 0, 1, 0]
    assert op.features("x", op.Model((), (), (0, 0, 0, 0)).matcher()) == (0.0, 0.0, 0.0)


def test_learned_on_the_rest(spark):
    rng = random.Random(8)
    calm = ["word%d" % k for k in range(500)]
    rows, labels = [], []
    for i in range(900):
        bad = rng.random() < 0.3
        words = [rng.choice(calm) for _ in range(rng.randrange(20, 120))]
        if bad:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "m0ron", "stupid", "scumbag", "scumlord"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, label int")
    got = op.score(texts(docs), op.learn(texts(docs), known)).collect()
    out = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in out} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    truth = dict(labels)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in out) / len(out) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_learned_exceptions(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(1200):
        words = [f"word{rng.randrange(400)}" for _ in range(40)]
        kind = rng.random()
        if kind < 0.3:
            words[rng.randrange(38)] = rng.choice(["trash", "scumbag", "vermin"])
        elif i % 240 == 1:
            words[5:7] = ["trash", "can"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind < 0.3)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, label int")
    model = op.learn(texts(docs), known)
    assert "trash can" in model.exceptions and not any("scumbag" in x for x in model.exceptions)
    got = {r["doc_id"]: r["predicted"] for r in op.score(texts(docs), model).collect()}
    assert sum(got[i] == y for i, y in labels) > 0.99 * len(labels)


def test_very_long_texts(spark):
    model = op.Model((("clown", 2.0, True),), ("clown fish",), (-1.0, 1.0, 0.0, 0.0))
    rows = [(1, "clown fish " * 100_000), (2, "clown " * 100_000), (3, "c l o w n"), (4, "x" * 1_000_000)]
    got = {r["doc_id"]: r["n_hits"] for r in op.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == {1: 0, 2: 100_000, 3: 1, 4: 0}


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, None), (None, 1), (5, 7)], "doc_id long, label int")
    got = op.score(odd, op.learn(odd, labels)).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert op.score(none, op.learn(none, labels)).count() == 0
    nothing = op.learn(odd, labels.where("false"))
    assert all(r["score"] == 0 and r["predicted"] == 0 for r in op.score(odd, nothing).collect())
