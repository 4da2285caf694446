"""Near duplicates against all pairs."""

import random
import re

import pytest

from siltstone.llm import op6_lsh_forest as op
from siltstone.llm.common import texts


def plain(rows):
    sets = []
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((doc, frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])))
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return sorted(((d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets), key=str)


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for k in range(6):
        base = [rng.choice("ABcdéfgh") + str(rng.randrange(40)) for _ in range(rng.choice([3, 6, 40, 120]))]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randrange(0, 6)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            rows.append((rng.randrange(10**6), rng.choice([" ", "\n", "\t "]).join(copy)))
    return rows


def test_against_all_pairs(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = [tuple(r)[:4] for r in op.near_duplicates(texts(df)).collect()]
        assert sorted(got, key=str) == plain(rows)


@pytest.mark.parametrize(("trees", "many"), [((32, 128, 512), 0), ((32,), 0), ((32, 128), 2)])
def test_crowded_regions(spark, monkeypatch, trees, many):
    """All regions crowded: deeper forests find the links, and so does the comparison of what is left of a crowd."""
    monkeypatch.setattr(op, "MANY", many)
    monkeypatch.setattr(op, "CROWD", 2)
    monkeypatch.setattr(op, "UNIT", 7)
    monkeypatch.setattr(op, "TREES", trees)
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted([tuple(r)[:4] for r in op.near_duplicates(texts(df)).collect()], key=str) == plain(rows)


def test_odd_rows(odd, none):
    got = [tuple(r)[:4] for r in op.near_duplicates(odd).collect()]
    assert sorted(got, key=str) == plain([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert op.near_duplicates(none).count() == 0


def test_a_region_over_many_partitions(spark):
    """One crowd of near copies, of which every partition holds a piece, and strangers."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    rows = [(i, " ".join(base + [f"x{i}"])) for i in range(300)] + [(1000 + i, " ".join(f"y{rng.randrange(10**6)}" for _ in range(30))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted([tuple(r)[:4] for r in op.near_duplicates(texts(df)).collect()], key=str) == plain(rows)


def test_very_long_texts(spark):
    rng = random.Random(9)
    long_ = [f"w{rng.randrange(3000)}" for _ in range(60_000)]
    rows = [(1, " ".join(long_)), (2, " ".join(long_[5000:])), (3, " ".join(long_[:30_000])), (4, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted([tuple(r)[:4] for r in op.near_duplicates(texts(df)).collect()], key=str) == plain(rows)
