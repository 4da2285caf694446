"""Decontamination against edit distances of all places."""

import random

import numpy as np

from siltstone.llm import op9_decontamination as op
from siltstone.llm.common import texts


def best(item, text):
    """Least edits of the item anywhere in the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
    return min(row)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row = row, [i]
        for j, d in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
    return row[-1]


def corpus(seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gam", "delta", "é", "the", "of", "zeta", "omega"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(4, 40)))) for i in range(12)]
    docs = []
    for i in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))
        if rng.random() < 0.6:
            leak = list(rng.choice(items)[1])
            for _ in range(rng.randrange(0, 9)):
                at = rng.randrange(len(leak))
                leak[at : at + rng.choice([0, 1])] = rng.choice(["", "x", "Q"])
            text = text[: len(text) // 2] + "  " + "".join(leak).upper() + "\n" + text[len(text) // 2 :]
        docs.append((i, text))
    return items, docs


def test_against_all_places(spark, monkeypatch):
    for seed, hits in ((1, op.PASS_HITS), (2, 50)):
        monkeypatch.setattr(op, "PASS_HITS", hits)
        items, docs = corpus(seed)
        found = op.find_items(texts(spark.createDataFrame(docs, "doc_id long, text string")), spark.createDataFrame(items, "item_id long, text string"))
        got = {(r["doc_id"], r["item_id"]): r for r in found.collect()}
        want = {}
        for i, t in docs:
            for k, item in items:
                x, y = op.normalised(item), op.normalised(t)
                allowed = min(int(len(x) * op.EDITS), (len(x) - op.Q) // op.Q)
                if len(x) >= op.Q and (d := best(x, y)) <= allowed:
                    want[i, k] = d
        assert {key: r["edits"] for key, r in got.items()} == want and len(want) > 10
        named = dict(items), dict(docs)
        for (i, k), r in got.items():
            assert distance(op.normalised(named[0][k]), op.normalised(named[1][i])[r["begin"] : r["end"]]) == r["edits"]


def test_alignment_bands():
    rng = np.random.default_rng(3)
    for _ in range(100):
        text = rng.integers(0, 3, 40)
        item = np.delete(text[10:30].copy(), 4)
        item[2] += 1
        got = op.banded_alignment(item, text, -19, 40, 8)
        assert got and got[0] == best(item.tolist(), text.tolist())


def test_passes_and_odd_rows(spark, monkeypatch, odd, none):
    items = spark.createDataFrame([(1, "one two three four five six"), (2, None), (None, "one two three"), (3, "short"), (4, "ONE  two three four five six")], "item_id long, text string")
    monkeypatch.setattr(op, "PASS_CHARS", 10)
    got = {(r["doc_id"], r["item_id"]) for r in op.find_items(odd, items).collect()}
    assert got == {(d, i) for d in (1, 4, None) for i in (1, 4)}
    assert op.find_items(none, items).count() == 0
    assert op.find_items(odd, items.where("false")).count() == 0


def test_repetitive_texts(spark):
    docs = spark.createDataFrame([(1, "a" * 50000), (2, "ab" * 20000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a" * 300), (2, "ba" * 100)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in op.find_items(docs, items).collect()} == {(1, 1), (2, 2)}


def test_clashing_columns_and_long_texts(spark):
    rng = random.Random(5)
    long_ = " ".join(f"w{rng.randrange(10**5)}" for _ in range(60_000))
    item = "an item of the benchmark that stands in a very long text"
    docs = spark.createDataFrame([(1, f"{long_} {item} {long_}", 7, 1), (2, long_, 8, 2)], "doc_id long, text string, item_id long, begin long")
    items = spark.createDataFrame([(5, item, 1, "x")], "item_id long, text string, doc_id long, edits string")
    assert [(r["doc_id"], r["item_id"], r["edits"]) for r in op.find_items(docs, items).collect()] == [(1, 5, 0)]
