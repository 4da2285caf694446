"""Line dedup by pairwise alignment.

Overlapping documents are found through shared rare lines: a document is aligned
with every earlier one that shares a line which only a few documents have.  Commoner
lines, and runs of lines, give star pairs: from each line on, and up to each line, the
shortest run that is long enough to be deleted has a first document (least id),
which is a partner of all later ones that have the run.  So a run in a third of all documents gives as
many pairs as documents and no more, and every line of a block that an earlier
document has lies in a run whose first document is a partner.  A commoner line alone
gives a pair if the pair shares several, or lines that together are long enough to be deleted.

The alignment is a patience diff: lines that are unique in both, their longest
increasing subsequence, and the same again between them; runs grow from there.  Where
no line is unique in both, the longest common run is taken.  Aligned common
blocks that are long enough are deleted from the later document.  An alignment keeps the
order, so blocks that stand in another order in the later document are looked for in
what it left.  All alignments are made on the input, not on what is left.

The result is that of all pairs: a line goes if and only if it lies in a run of lines, of
a block's bytes, that a document with a smaller id has as well.  The shortest such run around the
line has a first document, and that is a partner; so the number of holders changes no result.

A document is an edited copy if it has as many lines as an earlier one between any two
aligned blocks, and a quarter of its bytes aligned: only lines within changed.  Its lines
are deleted like others, and `edited_copy` tells callers who judge whole documents.

Cases: a null or empty text has no lines and stays; exact copies of a smaller id
are one aligned block, so they lose all lines if a block long; rows with a null doc_id stay whole and are no partners; rows
of one doc_id don't delete from each other; an empty table gives no rows; other
columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, table, texts
from .kernels import arrow_bytes, byte_units, range_hashes
from .tokens import slices

#: Bytes of a line that counts as evidence, documents that may have a rare line, common lines that make up for one.
EVIDENCE, RARE, SEVERAL = 20, 8, 3
#: Bytes of a block that is deleted.
BLOCK = 60


def patience(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Common blocks (begin in a, begin in b, lines) of two line sequences, in order."""
    matches: dict[int, int] = {}
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, left, right = todo.pop()
        while lo < hi and left < right and a[lo] == b[left]:
            matches[lo] = left
            lo, left = lo + 1, left + 1
        while lo < hi and left < right and a[hi - 1] == b[right - 1]:
            hi, right = hi - 1, right - 1
            matches[hi] = right
        if lo == hi or left == right:
            continue
        anchors = _increasing(_unique_in_both(a, lo, hi, b, left, right))
        if not anchors:
            i, j, n = _longest_common(a, lo, hi, b, left, right)
            if n:
                matches.update((i + k, j + k) for k in range(n))
                todo += [(lo, i, left, j), (i + n, hi, j + n, right)]
            continue
        for i, j in anchors:
            if (lo, left) != (i, j):
                todo.append((lo, i, left, j))
            matches[i] = j
            lo, left = i + 1, j + 1
        todo.append((lo, hi, left, right))
    blocks: list[tuple[int, int, int]] = []
    for i in sorted(matches):
        j = matches[i]
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1] = (*blocks[-1][:2], blocks[-1][2] + 1)
        else:
            blocks.append((i, j, 1))
    return blocks


def _unique_in_both(a: list[int], lo: int, hi: int, b: list[int], left: int, right: int) -> list[tuple[int, int]]:
    """Places, in the order of a, of the lines that each range has exactly once."""
    once: dict[int, int] = {}
    for i in range(lo, hi):
        once[a[i]] = -1 if a[i] in once else i
    other: dict[int, int] = {}
    for j in range(left, right):
        if once.get(b[j], -1) >= 0:
            other[b[j]] = -1 if b[j] in other else j
    return sorted((once[line], j) for line, j in other.items() if j >= 0)


def _automaton(a: list[int], lo: int, hi: int) -> tuple[list[dict[int, int]], list[int], list[int], list[int]]:
    """Suffix automaton of a range: steps, links, longest lengths, ends of first occurrences."""
    step: list[dict[int, int]] = [{}]
    link, size, end = [-1], [0], [lo]
    last = 0
    for i in range(lo, hi):
        new = len(step)
        step.append({})
        size.append(size[last] + 1)
        end.append(i + 1)
        link.append(0)
        at = last
        while at >= 0 and a[i] not in step[at]:
            step[at][a[i]] = new
            at = link[at]
        if at >= 0:
            to = step[at][a[i]]
            if size[to] != size[at] + 1:
                twin = len(step)
                step.append(dict(step[to]))
                size.append(size[at] + 1)
                end.append(end[to])
                link.append(link[to])
                while at >= 0 and step[at].get(a[i]) == to:
                    step[at][a[i]] = twin
                    at = link[at]
                link[to] = twin
                to = twin
            link[new] = to
        last = new
    return step, link, size, end


def _longest_common(a: list[int], lo: int, hi: int, b: list[int], left: int, right: int) -> tuple[int, int, int]:
    """Begin in a, begin in b and lines of the longest run that both ranges have."""
    both = set(a[lo:hi]).intersection(b[left:right])
    if not both:
        return lo, left, 0
    step, link, size, end = _automaton(a, lo, hi)
    best, at, n = (lo, left, 0), 0, 0
    for j in range(left, right):
        while at and b[j] not in step[at]:
            at = link[at]
            n = size[at]
        if b[j] in step[at]:
            at, n = step[at][b[j]], n + 1
        if n > best[2]:
            best = (end[at] - n, j + 1 - n, n)
    return best


def _moved(a: list[int], b: list[int], sizes: list[int], gone: set[int], least: int) -> set[int]:
    """Lines of b in runs of `least` bytes that a has as well, where an alignment, which keeps the order, left some of their lines."""
    have, stretches, start = set(a), [], None
    for j in range(len(b) + 1):
        inside = j < len(b) and b[j] in have
        if inside and start is None:
            start = j
        elif not inside and start is not None:
            if any(k not in gone for k in range(start, j)) and sum(sizes[start:j]) >= least:
                stretches.append((start, j))
            start = None
    if not stretches:
        return set()
    step, link, size, _ = _automaton(a, 0, len(a))
    sums = [0, *accumulate(sizes)]
    out, marked = set(), 0
    for start, stop in stretches:
        at, n = 0, 0
        for j in range(start, stop):
            while at and b[j] not in step[at]:
                at = link[at]
                n = size[at]
            if b[j] in step[at]:
                at, n = step[at][b[j]], n + 1
            if sums[j + 1] - sums[j + 1 - n] >= least:
                out.update(range(max(j + 1 - n, marked), j + 1))
                marked = j + 1
    return out


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence that increases in both places, by patience sorting."""
    from bisect import bisect_left

    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        back[k] = piles[at - 1] if at else -1
        tops[at : at + 1] = [j]
        piles[at : at + 1] = [k]
    out = []
    k = piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _line_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash and size of every line of each text."""
    for batch in batches:
        buf, offsets = arrow_bytes(batch.column(2))
        for lo, hi in slices(np.diff(offsets), 1 << 20):
            part = offsets[lo : hi + 1] - offsets[lo]
            text = buf[offsets[lo] : offsets[hi]]
            newline = np.flatnonzero(text == 10)
            # A text of k newlines has k + 1 lines, none if it is empty.
            full = part[:-1] < part[1:]
            starts = np.sort(np.concatenate([part[:-1][full], newline + 1]))
            ends = np.sort(np.concatenate([part[1:][full], newline]))
            hashes = range_hashes(byte_units(text), starts, ends).view(np.int64)
            count = np.zeros(hi - lo, np.int64)
            count[full] = 1
            np.add.at(count, np.searchsorted(part, newline, side="right") - 1, 1)
            cuts = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.ListArray.from_arrays(cuts, pa.array(hashes)),
                    pa.ListArray.from_arrays(cuts, pa.array((ends - starts).astype(np.int32))),
                ],
                names=["doc_id", "text_key", "lines", "sizes"],
            )


#: Odd, so that it has an inverse modulo 2^64.
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _runs(least: int):
    """Hashes of the shortest runs of lines, from each line on and up to each line, that have enough bytes."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = np.asarray(pa.compute.list_value_length(batch.column(2))).astype(np.int64)
            lines = np.asarray(batch.column(2).flatten()).view(np.uint64)
            bytes_ = np.concatenate([[0], np.cumsum(np.asarray(batch.column(3).flatten()), dtype=np.int64)])
            row = np.repeat(np.arange(len(count)), count)
            end = np.cumsum(count)[row]
            at = np.arange(len(lines))
            stop = np.searchsorted(bytes_, bytes_[:-1] + least, side="left")
            start = np.searchsorted(bytes_, bytes_[1:] - least, side="right") - 1
            on, up = stop <= end, start >= end - count[row]
            starts, stops = np.concatenate([at[on], start[up]]), np.concatenate([stop[on], at[up] + 1])
            power, back = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(lines), x)])) for x in (_BASE, inverse))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((lines ^ (lines >> np.uint64(29)) ^ _BASE) * power[:-1])])
            hashes = (sums[stops] - sums[starts]) * back[starts] + (stops - starts).astype(np.uint64) * _BASE
            rows = pa.array(np.concatenate([row[on], row[up]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(hashes.view(np.int64))], names=["doc_id", "text_key", "line"]
            )

    return run


def _edited(blocks: list[tuple[int, int, int]], sizes: list[int], other: int) -> bool:
    """Whether the blocks show an edited copy: a quarter of the bytes aligned, and as many lines between them on both sides."""
    ends = [(0, 0, 0), *blocks, (other, len(sizes), 0)]
    even = all(q[0] - p[0] == q[1] - p[1] for p, q in zip(ends, ends[1:]))
    return even and 4 * sum(sum(sizes[j : j + n]) for _, j, n in blocks) >= sum(sizes)


def _aligned(least: int):
    """Line numbers of the later document in long enough common blocks, and whether it is an edited copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, key, lines, sizes, first in zip(*(c.to_pylist() for c in batch.columns)):
                blocks = patience(first, lines)
                gone = {k for _, at, n in blocks if sum(sizes[at : at + n]) >= least for k in range(at, at + n)}
                gone |= _moved(first, lines, sizes, gone, least)
                if gone:
                    rows.append((doc, key, sorted(gone), _edited(blocks, sizes, len(first))))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "text_key", "gone", "edited"])

    return run


_RESULT = "doc_id long, text_sha256 string, n_lines long, n_removed long, kept string, kept_sha256 string, edited_copy boolean"


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, copy, gone, edited in zip(*(c.to_pylist() for c in batch.columns)):
            lines = text.split("\n") if text else []
            if copy:
                n, kept = len(lines), ""
            elif gone:
                out = set(gone)
                n, kept = len(out), "\n".join(line for i, line in enumerate(lines) if i not in out)
            else:
                n, kept = 0, text
            before, after = (hashlib.sha256(x.encode()).hexdigest() for x in (text, kept))
            rows.append((doc, before, len(lines), n, kept, after, bool(edited)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
        columns = zip(*rows) if rows else [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[c.split()[0] for c in _RESULT.split(", ")])


def aligned_line_dedup(docs: DataFrame, evidence: int = EVIDENCE, rare: int = RARE, several: int = SEVERAL, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_sha256, n_lines, n_removed, kept, kept_sha256, edited_copy) for each row of docs (doc_id, text)."""
    docs, stage = texts(docs), Stage(docs.sparkSession, "lines")
    key = F.hash("text").alias("text_key")
    known = docs.where("doc_id IS NOT NULL")
    prints = known.select("doc_id", key, F.sha2("text", 256).alias("print"))
    groups = prints.groupBy("print").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    groups = stage.write(groups.drop("last"), "groups")
    copies = stage.write(prints.join(groups.hint("merge"), "print").where("doc_id > first").select("doc_id", "text_key").distinct(), "copies")
    # What an aligned copy loses: all its lines, if they have the bytes of a block.
    own_bytes = F.octet_length("text") - F.length("text") + F.length(F.regexp_replace("text", "\n", ""))

    arrays = known.select("doc_id", key, "text").mapInArrow(_line_arrays, "doc_id long, text_key int, lines array<bigint>, sizes array<int>")
    arrays = stage.write(arrays, "arrays")
    # Joins are shuffled at every size: what is small here grows with the input.
    firsts = arrays.join(copies.hint("merge"), ["doc_id", "text_key"], "left_anti")
    long_ = F.filter(F.arrays_zip("lines", "sizes"), lambda x: x["sizes"] >= evidence)
    shown = firsts.select("doc_id", "text_key", F.explode(F.array_distinct(long_)).alias("x")).select("doc_id", "text_key", F.col("x.lines").alias("line"), F.col("x.sizes").alias("size"))
    shown = stage.write(shown, "shown")
    known_lines = shown.groupBy("line").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    known_lines = stage.write(known_lines.where("first < last").drop("last"), "known")
    met = shown.join(known_lines.hint("merge"), "line")
    few = met.where(F.col("n") <= rare).groupBy("line").agg(F.collect_list(F.struct("doc_id", "text_key")).alias("holders"))
    few = few.select("holders", F.explode("holders").alias("later")).select(F.explode(F.filter("holders", lambda x: x["doc_id"] < F.col("later.doc_id"))).alias("x"), "later")
    few = few.select(F.col("x.doc_id").alias("first"), "later.doc_id", "later.text_key")
    common = met.where((F.col("n") > rare) & (F.col("doc_id") > F.col("first"))).groupBy("first", "doc_id", "text_key")
    common = common.agg(F.count("*").alias("lines"), F.sum("size").alias("bytes")).where((F.col("lines") >= several) | (F.col("bytes") >= block))
    runs = stage.write(firsts.select("doc_id", "text_key", "lines", "sizes").mapInArrow(_runs(block), "doc_id long, text_key int, line long"), "shown-runs")
    known_runs = runs.groupBy("line").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    known_runs = stage.write(known_runs.where("first < last").drop("last"), "known-runs")
    of_runs = runs.join(known_runs.hint("merge"), "line").where("doc_id > first").select("first", "doc_id", "text_key")
    pairs = few.unionByName(common.select("first", "doc_id", "text_key")).unionByName(of_runs).distinct()
    pairs = stage.write(pairs, "pairs")
    later = pairs.hint("merge").join(arrays, ["doc_id", "text_key"])
    both = later.hint("merge").join(arrays.select(F.col("doc_id").alias("first"), F.col("lines").alias("first_lines")), "first")
    gone = both.select("doc_id", "text_key", "lines", "sizes", "first_lines").mapInArrow(_aligned(block), "doc_id long, text_key int, gone array<int>, edited boolean")
    gone = gone.groupBy("doc_id", "text_key").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"), F.max("edited").alias("edited"))
    gone = stage.write(gone, "gone")

    stage.drop("groups", "shown", "known", "shown-runs", "known-runs", "pairs")
    marks = gone.withColumn("copy", F.lit(False)).unionByName(copies.select("doc_id", "text_key", F.array().cast("array<int>").alias("gone"), F.lit(False).alias("edited"), F.lit(True).alias("copy")))
    out = docs.select("doc_id", key, "text").join(marks.hint("shuffle_hash"), ["doc_id", "text_key"], "left")
    return out.select("doc_id", "text", (F.col("copy") & (own_bytes >= block)).alias("copy"), "gone", "edited").mapInArrow(_without, _RESULT)


def op1_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the line blocks that align with an earlier document."""
    found = aligned_line_dedup(texts(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_lines", "n_removed", "kept_sha256")
