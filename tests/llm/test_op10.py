"""Vectors against all pairs."""

import numpy as np

from siltstone.llm import op10_sorted_projections as op


def plain(ids, vectors, threshold=0.9):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hit = unit @ unit.T >= threshold
    np.fill_diagonal(hit, False)
    label = list(range(len(ids)))
    for i in range(len(ids)):
        seen, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(hit[todo.pop()]):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        label[i] = min(ids[j] for j in seen)
    return {d: (int(h.sum()), c, d == c) for d, h, c in zip(ids, hit, label)}


def test_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 32))
    crowd = centres[0] + rng.standard_normal((250, 32)) * 0.12
    some = np.concatenate([c + rng.standard_normal((4, 32)) * 0.3 for c in centres])
    vectors = np.concatenate([crowd, some, some[:5], rng.standard_normal((200, 32))])
    ids = rng.permutation(len(vectors) * 2)[: len(vectors)].tolist()
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>, n int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in op.near_vectors(df).collect()}
    want = plain(ids, vectors)
    assert got.keys() == want.keys()
    links = sum(n for n, _, _ in want.values())
    assert sum(n for n, _, _ in got.values()) >= 0.9 * links
    assert all(got[k][0] <= want[k][0] for k in want)
    assert sum(got[k] == want[k] for k in want) >= 0.95 * len(want)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in op.near_vectors(df).collect()}
    assert got == {
        1: (2, 1, True), 2: (2, 1, False), 10: (2, 1, False), None: (0, None, True), **{k: (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9)},
    }
    assert op.near_vectors(df.where("false")).count() == 0


def test_several_vectors_of_one_id(spark):
    """Vectors of one id stay apart: a far one inherits no link, and joins the id's components."""
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, a), (2, a), (2, b), (3, b), (4, c), (4, c), (5, [0.99, 0.01, 0.0]), (6, [0.0, 0.0, 2.0])]
    df = spark.createDataFrame([(*r, 0, 0, 0, 0) for r in rows], "vec_id long, embedding array<float>, cell int, key int, size int, first int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in op.near_vectors(df).collect())
    # Equal directions are linked; the two equal rows of 4 are links of each other.
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 1, 1, False), (4, 2, 4, True), (4, 2, 4, True), (5, 2, 1, False), (6, 2, 4, False)]


def test_passes_grow_with_the_input():
    assert op.passes(10**9, 0.9) > op.passes(10**6, 0.9) > op.passes(100, 0.9) >= op.LEAST_PASSES


def crowd(spark, spread, members=8000):
    """Links found and true links of a crowd, with twice as many vectors far from it."""
    rng = np.random.default_rng(6)
    near = rng.standard_normal(64) + rng.standard_normal((members, 64)) * spread
    vectors = np.concatenate([near, rng.standard_normal((2 * members, 64))])
    df = spark.createDataFrame(list(enumerate(vectors.tolist())), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in op.near_vectors(df).collect()}
    unit = near / np.linalg.norm(near, axis=1, keepdims=True)
    true = ((unit @ unit.T) >= 0.9).sum(axis=1) - 1
    assert all(got[i] <= true[i] for i in range(members))
    return sum(got[i] for i in range(members)), int(true.sum())


def test_a_wide_crowd_is_compared_whole(spark):
    found, true = crowd(spark, 0.28)  # cosines of about 0.927: hardly any within a cell
    assert found >= 0.99 * true


def test_a_tight_crowd_is_gathered_whole(spark):
    found, true = crowd(spark, 0.14)  # cosines of about 0.98
    assert found >= 0.99 * true
