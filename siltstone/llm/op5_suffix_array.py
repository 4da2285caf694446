"""Suffix-array dedup by deep-shallow sorting over bytes.

The suffixes that start at the windows of shared regions are sorted to the
window's depth: multikey quicksort, eight bytes a step, to a shallow depth, then
blind tries for the groups that still agree.  A trie's levels are laid out from
each group's first suffix: the others branch off where they first differ from
it, and those with one branch make the next group.

Cases: a null or empty text has no bytes; a document shorter than a window stays
whole; rows with a null doc_id stay whole and remove nothing; rows of one doc_id don't
remove each other; exact copies lose all (if a window long); an empty table
gives no rows; other columns do not matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import table, texts
from .kernels import refine
from .repeats import Nodes, Rule, remove_repeats

#: Depth, in bytes, to which multikey quicksort goes.
SHALLOW = 24


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one big-endian number; zeros follow the end."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(buf) + 1, np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i : i + len(out)]
    return out


def deep_shallow(buf: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first `depth` bytes, and the heads of those that are equal so far."""
    eight = _eights(buf)
    cut = np.uint64(64 - 8 * (depth % 8)) if depth % 8 else np.uint64(0)
    steps = -(-depth // 8)

    def symbol(rows: np.ndarray, step: int) -> np.ndarray:
        found = eight[np.minimum(starts[rows] + 8 * step, len(buf))]
        return found >> cut << cut if step == steps - 1 else found

    order = np.arange(len(starts))
    heads = np.zeros(len(starts), dtype=bool)
    heads[:1] = True
    shallow = min(SHALLOW // 8, steps)
    for step in range(shallow):
        refine(order, heads, lambda rows, step=step: symbol(rows, step))

    run = np.cumsum(heads) - 1
    open_ = np.flatnonzero(np.bincount(run)[run] > 1) if len(run) else np.empty(0, np.int64)
    while len(open_) and shallow < steps:
        # One level of the blind tries of all open groups: each suffix against its group's first.
        run = np.cumsum(heads)[open_]
        first = np.concatenate([[True], run[1:] != run[:-1]])
        group = np.cumsum(first) - 1
        rows = order[open_]
        leader = rows[first][group]
        common = np.full(len(rows), depth, np.int64)
        branch = np.zeros(len(rows), np.int64)
        side = np.ones(len(rows), np.int64)
        left = np.arange(len(rows))
        for step in range(shallow, steps):
            a, b = symbol(rows[left], step), symbol(leader[left], step)
            off = np.flatnonzero(a != b)
            if len(off):
                differs = a[off] ^ b[off]
                byte = np.zeros(len(off), np.int64)
                for i in range(1, 8):
                    byte += differs < np.uint64(1) << np.uint64(8 * (8 - i))
                at = left[off]
                common[at] = 8 * step + byte
                branch[at] = (a[off] >> (np.uint64(56) - np.uint64(8) * byte.astype(np.uint64)) & np.uint64(255)).astype(np.int64)
                side[at] = np.where(a[off] < b[off], 0, 2)
                left = np.delete(left, off)
        place = np.where(side == 0, common, np.where(side == 2, 2 * depth - common, depth))
        key = (side << 48) | (place << 16) | branch
        perm = np.lexsort((key, group))
        order[open_] = rows[perm]
        key, group, side = key[perm], group[perm], side[perm]
        heads[open_[1:]] |= (group[1:] == group[:-1]) & (key[1:] != key[:-1])
        run = np.cumsum(heads)
        size = np.bincount(run)
        open_ = open_[(side != 1) & (size[run[open_]] > 1)]
    return order, heads


def deep_nodes(buf: np.ndarray, starts: np.ndarray, docs: np.ndarray, depth: int) -> Nodes:
    """The suffixes in order, their runs of `depth` equal bytes, and each run's least document."""
    order, heads = deep_shallow(buf, starts, depth)
    return order, np.cumsum(heads) - 1, np.minimum.reduceat(docs[order], np.flatnonzero(heads)) if len(order) else docs


def remove_repeated_bytes(docs: DataFrame, window: int = 50, anchor: int = 20, keep_text: bool = False, **limits: int) -> DataFrame:
    """remove_repeats over UTF-8 bytes: see there for the columns."""
    return remove_repeats(docs, Rule(False, window, anchor, deep_nodes), "bytes", keep_text, **limits)


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 50-byte strings that a smaller doc_id has."""
    found = remove_repeated_bytes(texts(table(spark, sf_dir, "documents")))
    return found.select("doc_id", found["n_units"].alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")
