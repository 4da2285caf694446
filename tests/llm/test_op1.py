"""Line dedup: patience diff against its definition, and whole results against a plain version."""

import random
import time

from siltstone.llm import op1_line_alignment as op
from siltstone.llm.common import texts


def test_patience_blocks_are_common_and_ordered():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.randrange(12) for _ in range(rng.randrange(0, 15))]
        b = [rng.randrange(12) for _ in range(rng.randrange(0, 15))]
        blocks = op.patience(a, b)
        for i, j, n in blocks:
            assert a[i : i + n] == b[j : j + n]
        assert all(p[0] + p[2] <= q[0] and p[1] + p[2] <= q[1] for p, q in zip(blocks, blocks[1:]))


def test_patience_keeps_unique_lines_in_order():
    assert op.patience([1, 2, 3, 4, 5], [9, 2, 3, 8, 5, 1]) == [(1, 1, 2), (4, 4, 1)]
    assert op.patience([1, 2, 3], [1, 2, 3]) == [(0, 0, 3)]
    assert op.patience([], [1]) == []


def plain(rows, block):
    """By all pairs of documents: a line goes if it lies in a run of a block's bytes that a document with a smaller id has as well."""
    size = lambda x: len(x.encode())
    lines = {i: (t or "").split("\n") if t else [] for i, t in rows if i is not None}
    runs = {i: {tuple(x[b:e]) for b in range(len(x)) for e in range(b + 1, len(x) + 1)} for i, x in lines.items()}
    out = {}
    for i, x in lines.items():
        gone = set()
        for b in range(len(x)):
            for e in range(b + 1, len(x) + 1):
                if sum(map(size, x[b:e])) >= block and any(j < i and tuple(x[b:e]) in runs[j] for j in lines):
                    gone.update(range(b, e))
        out[i] = (len(x), len(gone), "\n".join(line for k, line in enumerate(x) if k not in gone))
    return out


def test_against_all_pairs(spark):
    rng = random.Random(7)
    pool = ["line number %d of the shared pool é" % k for k in range(40)] + ["short", "", "a few words"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 9)))) for i in range(80)]
    rows += [(90, rows[3][1]), (91, "\n".join(pool[:6])), (92, "\n".join(["new"] + pool[1:5] + ["", "x"])), (93, None), (94, "short\nshort"), (95, "short\nshort!"), (96, "short\nshort")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rare, several in ((3, 2), (20, 3), (1, 1)):
        got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept"]) for r in op.aligned_line_dedup(texts(df), rare=rare, several=several).collect()}
        assert got == plain(rows, op.BLOCK)


def test_crossed_blocks_with_many_holders(spark):
    """Two long lines in one order in twelve documents, and in the other order in two later ones."""
    x, y = "x" * 69 + "!", "y" * 69 + "?"
    rows = [(k, f"{x}\nown {k}\n{y}") for k in range(1, 13)] + [(20, f"{y}\n{x}\nown 20"), (21, f"{y}\n{x}\nown 21"), (22, f"{x}\n{y}")]
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept"]) for r in op.aligned_line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain(rows, op.BLOCK)
    assert got[20][1] == got[21][1] == got[22][1] == 2


def test_one_very_long_line(spark):
    line = "a line without an end " * 50_000
    rows = [(1, line), (2, f"x\n{line}"), (3, line + "y")]
    got = {r["doc_id"]: r["n_removed"] for r in op.aligned_line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0}


def test_later_holders_of_rare_lines_are_partners(spark):
    """Six lines that six documents have one each of, and two later ones have all of."""
    pool = [f"shared line {k} of some forty bytes in all it is" for k in range(6)]
    rows = [(k + 1, f"own {k}\n{line}\nown too {k}") for k, line in enumerate(pool)] + [(10, "\n".join(pool)), (11, "\n".join(["x", *pool, "y"]))]
    got = {r["doc_id"]: r["n_removed"] for r in op.aligned_line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[11] == 6 and got[10] == 0


def test_long_documents_align_in_linear_time(spark):
    a, b = [x for k in range(20_000) for x in (k, -1)], [x for k in range(20_000) for x in (k, -2)]
    began = time.perf_counter()
    assert len(op.patience(a, b)) == 20_000
    assert time.perf_counter() - began < 5
    text = "\n".join(f"line {k} of a very long document" for k in range(30_000))
    rows = [(1, text), (2, "first\n" + text + "\nlast")]
    got = {r["doc_id"]: r["kept"] for r in op.aligned_line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: text, 2: "first\nlast"}


def test_odd_rows(odd, none):
    got = op.aligned_line_dedup(odd).collect()
    assert len(got) == odd.count()
    kept = {(r["doc_id"], r["kept"]) for r in got}
    assert (None, "one two three four five six seven eight nine ten") in kept  # no id: whole
    assert (4, "one two three four five six seven eight nine ten") in kept and (2, "") in kept  # a copy shorter than a block stays, null is empty
    long_copies = odd.where("doc_id IN (1, 4)").selectExpr("doc_id", "repeat(text, 3) AS text")
    assert {(r["doc_id"], r["kept"] == "") for r in op.aligned_line_dedup(long_copies).collect()} == {(1, False), (4, True)}
    assert sum(r["doc_id"] == 1 and r["n_removed"] == 0 for r in got) == 2  # rows of one id don't delete from each other
    assert op.aligned_line_dedup(none).count() == 0


def test_a_hot_long_line_goes_from_all_later_documents(spark):
    hot = "one long line that many more documents than a rare line's have, and nothing else in common"
    rows = [(i, f"own line {i} of a document\n{hot}\nanother own line {i}") for i in range(200)]
    got = {r["doc_id"]: r["n_removed"] for r in op.aligned_line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(i > 0) for i, _ in rows}


def test_longest_common_run_where_no_line_is_unique():
    assert op.patience([7, 1, 2, 1, 2, 8], [9, 1, 2, 5, 1, 2, 6]) == [(1, 1, 2), (3, 4, 2)]
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        i, j, n = op._longest_common(a, 0, len(a), b, 0, len(b))
        assert a[i : i + n] == b[j : j + n]
        assert n == max(k for k in range(13) if any(a[x : x + k] == b[y : y + k] for x in range(len(a) - k + 1) for y in range(len(b) - k + 1)))


def test_blocks_whose_lines_first_stand_apart(spark):
    a, b = "a line of some forty bytes that comes first", "and one more that is met with it only later"
    verse = "\n".join(f"verse {k}" for k in range(9))
    twice = "\n".join(["a passage of two lines, each of thirty", "bytes and more, that stands here twice"])
    rows = [(1, f"x\n{a}"), (2, f"{b}\ny"), (3, f"{a}\n{b}"), (4, f"q\n{a}\n{b}\nr"), (5, f"own\n{verse}\nown"), (6, f"mine\n{verse}\nmine")]
    rows += [(7, f"s\n{twice}\nt\n{twice}\nu"), (8, f"v\n{twice}\nw"), (9, f"{a}\n\n" + "z" * 20), (10, f"0\n{a}\n\n" + "z" * 20)]
    got = {r["doc_id"]: r["n_removed"] for r in op.aligned_line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 2, 5: 0, 6: 9, 7: 0, 8: 2, 9: 0, 10: 3}


def test_every_block_of_one_earlier_document_goes(spark):
    rng = random.Random(8)
    pool = [f"{k} " * rng.randrange(1, 12) + f"of the pool {k}" for k in range(30)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(6))) for i in range(60)]
    rows += [(100 + i, "\n".join([f"before {i}", *text.split("\n")[1:5], f"after {i}"])) for i, text in rows]
    got = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in op.aligned_line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        cut = text.split("\n")[1:-1]
        if i >= 100 and len("".join(cut)) >= op.BLOCK:
            assert got[i] == (4, f"before {i - 100}\nafter {i - 100}")


def test_edited_copies(spark):
    lines = [f"line {k} of a document with a number of words in it" for k in range(8)]
    rows = [(1, "\n".join(lines)), (2, "\n".join([*lines[:3], "changed", *lines[4:]])), (3, "\n".join(["new", *lines[:3]])), (4, "\n".join([*lines[:2], *["other words in this line and " * 5] * 6]))]
    got = {r["doc_id"]: r["edited_copy"] for r in op.aligned_line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False}
