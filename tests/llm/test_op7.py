"""Packing: places are sound, and as few sequences as possible where that is known."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from siltstone.llm import op7_packing as op

WORD = public_tokenizers.path("word_bpe_49k.json")


def least_bins(sizes, capacity):
    """The least number of bins, by trying all (for a few pieces)."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def put(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= sizes[k] and rooms[i] not in rooms[:i]:
                put(k + 1, [*rooms[:i], rooms[i] - sizes[k], *rooms[i + 1 :]])
        put(k + 1, [*rooms, capacity - sizes[k]])

    put(0, [])
    return best


def bins(sizes, capacity):
    count = np.bincount(sizes, minlength=capacity + 1)
    whole = count.copy()
    fixed = op.reduce_by_dominance(count, capacity)
    done = np.zeros(capacity + 1, int)
    for items, times in fixed:
        assert sum(s * m for s, m in items) <= capacity and times > 0
        for s, m in items:
            done[s] += m * times
    assert (done + count == whole).all()
    rest = op.best_fit(count.copy(), capacity)
    for items, times in rest:
        assert 0 < sum(s * m for s, m in items) <= capacity
        for s, m in items:
            done[s] += m * times
    assert (done == whole).all()
    return fixed, rest


def test_reduction_is_optimal(spark):
    rng = random.Random(4)
    for _ in range(150):
        capacity = rng.choice([10, 13, 20])
        sizes = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9))]
        fixed, _ = bins(sizes, capacity)
        rest = list(sizes)
        for items, times in fixed:
            for s, m in items:
                for _ in range(m * times):
                    rest.remove(s)
        # What is fixed never costs a bin: the least for the rest and the fixed bins are the least for all.
        assert sum(t for _, t in fixed) + least_bins(rest, capacity) == least_bins(sizes, capacity)


def test_near_least(spark):
    rng = random.Random(5)
    for _ in range(60):
        sizes = [rng.randrange(1, 21) for _ in range(9)]
        fixed, rest = bins(sizes, 20)
        assert sum(t for _, t in itertools.chain(fixed, rest)) <= least_bins(sizes, 20) + 1


def check(rows, got, capacity):
    model = Tokenizer.from_file(WORD)
    want = []
    for doc, text in rows:
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.append((doc, k, at, len(part), zlib.crc32(part)))
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_documents(spark):
    rng = random.Random(6)
    rows = [(i, "Some words, and MORE: " * rng.randrange(0, 60)) for i in range(150)] + [(900, None), (901, "long " * 3000), (902, "same"), (903, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = op.pack_documents(df, WORD, 1, 256).collect()
    total = sum(r["length"] for r in got)
    assert check(rows, got, 256) <= -(-total // 256) + 1


def test_odd_rows(odd, none):
    check([(r["doc_id"], r["text"]) for r in odd.collect()], op.pack_documents(odd, WORD, 1, 64).collect(), 64)
    assert op.pack_documents(none, WORD, 1, 64).count() == 0
