"""Both repeat removers against a table of all windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from siltstone.llm import repeats
from siltstone.llm.common import texts
from siltstone.llm.op4_suffix_trees import deep_nodes, remove_repeated_words
from siltstone.llm.op5_suffix_array import deep_shallow, remove_repeated_bytes


def plain(rows, words, window):
    """Results of each row, rows of distinct or equal ids."""
    units = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", t.encode()) if words else list(t.encode())
    first = {}
    for doc, text in rows:
        if doc is not None:
            u = units(text or "")
            for i in range(len(u) - window + 1):
                k = tuple(u[i : i + window])
                first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, text in rows:
        u = units(text or "")
        mask = np.zeros(len(u) + 1, bool)
        if doc is not None:
            for i in range(len(u) - window + 1):
                if first[tuple(u[i : i + window])] < doc:
                    mask[i : i + window] = True
        kept = b" ".join(x for x, m in zip(u, mask) if not m) if words else bytes(x for x, m in zip(u, mask) if not m)
        spans = int(np.count_nonzero(mask[:-1] & ~np.concatenate([[False], mask[:-2]]))) if len(u) else 0
        out.append((doc, len(u), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, words):
    rng = random.Random(seed)
    vocabulary = ["w%d" % k for k in range(300)] if words else [chr(97 + k) for k in range(6)]
    join = " ".join if words else "".join
    passages = [[rng.choice(vocabulary) for _ in range(rng.randrange(8, 60))] for _ in range(6)]
    rows = []
    for i in range(70):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            parts += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))]
        rows.append((i * 3, join(parts)))
    rows += [(500, rows[5][1]), (501, rows[5][1] + (" x" if words else "x")), (502, None), (503, ""), (504, join(["a"] * 400)), (505, join(["a"] * 200)), (None, rows[5][1])]
    rows += [(506, rows[7][1] + rows[9][1]), (506, rows[9][1]), (507, "é " * 80 + "ü"), (508, "ü" + "é " * 80), (509, "\x0b".join(["q"] * 90) + "\x1c" + " ")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("words", [True, False])
@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("small", [False, True])
def test_against_plain(spark, monkeypatch, words, seed, small):
    if small:  # many blocks and passes
        for name, value in (("PASS_BYTES", 300), ("BLOCK_ANCHORS", 40), ("BLOCK_REGION_BYTES", 500), ("GROUP_SUFFIXES", 300)):
            monkeypatch.setattr(repeats, name, value)
    rows = corpus(seed, words)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    remove = remove_repeated_words if words else remove_repeated_bytes
    found = remove(texts(df), window=12, anchor=4, keep_text=True, hot=3 if small else 10**6).collect()
    order = lambda r: (r[0] is not None, r)
    assert sorted([tuple(r)[:5] for r in found], key=order) == sorted(plain(rows, words, 12), key=order)
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in found)


def test_odd_rows(odd, none):
    for remove in (remove_repeated_words, remove_repeated_bytes):
        got = remove(odd, window=6, anchor=3).collect()
        assert len(got) == odd.count()
        assert [r["n_removed"] == r["n_units"] > 0 for r in got if r["doc_id"] == 4] == [True]
        assert [r["n_removed"] for r in got if r["doc_id"] == 1] == [0, 0]
        assert remove(none).count() == 0


@pytest.mark.parametrize("depth", [3, 8, 24, 25, 50])
def test_deep_shallow_sorts(depth):
    rng = np.random.default_rng(depth)
    base = rng.integers(97, 99, 200).astype(np.uint8)
    buf = np.concatenate([base, base[20:150], rng.integers(97, 99, 300).astype(np.uint8), base, np.full(120, 97, np.uint8)])
    starts = rng.permutation(len(buf) - depth)
    order, heads = deep_shallow(buf, starts, depth)
    found = [buf[s : s + depth].tobytes() for s in starts[order]]
    assert found == sorted(found)
    assert heads.tolist() == [i == 0 or found[i] != found[i - 1] for i in range(len(found))]


def test_deep_nodes():
    rng = np.random.default_rng(1)
    base = rng.integers(1, 3, 60)
    units = np.concatenate([base, rng.integers(1, 3, 80), base, np.ones(90, np.int64)])
    starts = np.arange(len(units) - 20)
    docs = starts // 70
    leaves, node, least = deep_nodes(units, starts, docs, 20)
    groups = {}
    for s in starts:
        groups.setdefault(tuple(units[s : s + 20]), []).append(s)
    want = {tuple(g): min(docs[g]) for g in groups.values() if len({*docs[g]}) > 1}
    got = {tuple(sorted(leaves[node == k])): d for k, d in enumerate(least)}
    assert got == want and len(got) > 10
    assert [len(x) for x in deep_nodes(units, starts[:0], docs[:0], 20)[:2]] == [0, 0]


def test_equal_hashes_of_other_bytes(monkeypatch):
    """Regions that only look equal are kept apart."""
    buf = np.frombuffer(b"abcdabceabcd", np.uint8)
    at, sizes, docs = np.array([0, 4, 8]), np.array([4, 4, 4]), np.array([1, 2, 3])
    first, least = repeats._first_of_equals(buf, at, sizes, np.zeros(3, np.uint64), docs)
    assert first.tolist() == [0, 1, 0] and least.tolist() == [1, 2, 1]


def test_very_long_texts(spark):
    rng = random.Random(4)
    long_ = " ".join(rng.choice(["ab", "cd", "e"]) + str(rng.randrange(5000)) for _ in range(60_000))
    rows = [(1, long_), (2, "x " + long_), (3, long_[: len(long_) // 2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for remove, words in ((remove_repeated_words, True), (remove_repeated_bytes, False)):
        found = sorted(tuple(r)[:5] for r in remove(df).collect())
        assert found == plain(rows, words, 50)
