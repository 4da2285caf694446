"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A text that holds an item within k edits shares at least L + 1 - q (k + 1) of
the item's L + 1 - q q-grams, all within 2 k + 1 neighbouring diagonals.  Shared
q-grams are counted in overlapping bands of diagonals, bands that meet the bound
are kept, and a banded alignment decides.  Texts are compared in lower case with
runs of white space as one space, whole.

Cases: a null or empty text holds nothing; an item of fewer than q characters
is no evidence and matches nothing; null items are none; of an item that stands several
times in a text, the best place is given; equal items and equal
texts match each on their own; an empty benchmark matches nothing; other columns
do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, table, texts
from .kernels import rolling
from .tokens import slices

#: q-gram size, and edits allowed for each character of an item.
Q, EDITS = 10, 0.08
#: Characters of benchmark that one pass compares; a larger benchmark takes several passes.
PASS_CHARS = 16 << 20
#: Shared q-grams that are counted at once.
PASS_HITS = 2 << 20
_MATCH = "doc_id long, item_id long, begin long, end long, edits int"


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def _chars(text: str) -> np.ndarray:
    if text.isascii():
        return np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _grams(chars: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams; their upper bits depend on every character."""
    return rolling(chars.astype(np.uint64) + np.uint64(1), q, mixed=False)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct key columns in order, with the sums of their counts."""
    if not keys.shape[1]:
        return keys, counts
    order = np.lexsort(keys[::-1])
    keys, counts = keys[:, order], counts[order]
    begins = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
    return keys[:, begins], np.add.reduceat(counts, begins)


class Index:
    """The q-grams of some items: their places by hash, and a bit table that most other q-grams miss."""

    def __init__(self, items: list[tuple[int, str]], q: int, edits: float):
        kept = [(i, _chars(t)) for i, t in items if len(t) >= q]
        self.q = q
        self.ids = np.array([i for i, _ in kept], np.int64)
        self.chars = [c for _, c in kept]
        size = np.array([len(c) for c in self.chars], np.int64)
        self.size = size
        self.edits = np.minimum((size * edits).astype(np.int64), (size - q) // q)
        self.least = size - q + 1 - self.edits * q
        self.width = np.maximum(1, self.edits)  # bands begin at multiples of it and are twice as wide, and one more
        grams = [_grams(c, q) for c in self.chars]
        hashes = np.concatenate([np.empty(0, np.uint64), *grams])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.empty(0, np.int64), *(np.arange(len(g)) for g in grams)])
        order = np.argsort(hashes, kind="stable")
        self.hash, self.first = np.unique(hashes[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(order)))
        self.item, self.place = item[order], place[order]
        self.bits = np.uint64(max(16, min(26, 5 + int(len(self.hash)).bit_length())))
        self.seen = np.zeros(1 << int(self.bits), dtype=bool)
        self.seen[self.hash >> (np.uint64(64) - self.bits)] = True

    def _band_keys(self, at: np.ndarray, slot: np.ndarray, text: np.ndarray) -> np.ndarray:
        """(text, item, band) of every shared q-gram, once for each band that it counts in."""
        n = self.count[slot]
        hit = np.repeat(np.arange(len(at)), n)
        post = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n) + self.first[slot][hit]
        item = self.item[post]
        diagonal = at[hit] - self.place[post]
        width = self.width[item]
        band = diagonal // width
        key = np.stack([np.tile(text[hit], 3), np.tile(item, 3), np.concatenate([band, band - 1, band - 2])])
        # A band of 2 k + 1 diagonals ends with one that begins the next but one.
        return key[:, np.concatenate([np.ones(2 * len(item), bool), diagonal == band * width])]

    def bands(self, chars: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Bands of texts (first: where each begins in chars, with the end) that meet their item's bound: text, item, lowest and highest diagonal."""
        grams = _grams(chars, self.q)
        at = np.flatnonzero(self.seen[grams >> (np.uint64(64) - self.bits)])
        slot = np.minimum(np.searchsorted(self.hash, grams[at]), len(self.hash) - 1)
        known = self.hash[slot] == grams[at]
        at, slot = at[known], slot[known]
        text = np.searchsorted(first, at, side="right") - 1
        inside = at + self.q <= first[text + 1]
        at, slot, text = at[inside], slot[inside], text[inside]
        # Counts of bands, added up over pieces of bounded size (a repetitive text can hit one item at many places).
        ends = np.cumsum(self.count[slot])
        keys, counts = np.empty((3, 0), np.int64), np.empty(0, np.int64)
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PASS_HITS, side="right")))
            more = self._band_keys(at[lo:hi] - first[text[lo:hi]], slot[lo:hi], text[lo:hi])
            keys, counts = _summed(np.concatenate([keys, more], axis=1), np.concatenate([counts, np.ones(more.shape[1], np.int64)]))
            lo = hi
        found = keys[:, counts >= self.least[keys[1]]]
        if not found.shape[1]:
            return (np.empty(0, np.int64),) * 4
        # Neighbouring bands that meet the bound are one region.
        step = np.concatenate([[True], (found[:2, 1:] != found[:2, :-1]).any(axis=0) | (found[2, 1:] > found[2, :-1] + 2)])
        begins = np.flatnonzero(step)
        ends = np.append(begins[1:], found.shape[1]) - 1
        w = self.width[found[1, begins]]
        return found[0, begins], found[1, begins], found[2, begins] * w, (found[2, ends] + 2) * w


def _find(text: np.ndarray, item: np.ndarray) -> int:
    """The first place of an exact copy, or -1."""
    whole, part, at = text.astype("<u4").tobytes(), item.astype("<u4").tobytes(), -1
    while (at := whole.find(part, at + 1)) >= 0 and at % 4:
        pass
    return at // 4 if at >= 0 else -1


def banded_alignment(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """Least edits (at most `most`) of the whole item in the text along diagonals low..high, with begin and end; else None."""
    lo, hi = max(0, low), max(0, high + len(item))
    if (at := _find(text[lo:hi], item)) >= 0:
        return 0, lo + at, lo + at + len(item)
    n = high - low + 1
    far = most + 1
    offsets = np.arange(n)
    column = low + offsets  # text place before item place 0, for each diagonal
    ok = (column >= 0) & (column <= len(text))
    cost = np.where(ok, 0, far)
    begin = np.where(ok, column, 0)
    for i, c in enumerate(item):
        column = column + 1
        ok = (column >= 0) & (column <= len(text))
        inner = (column >= 1) & (column <= len(text))
        same = np.zeros(n, bool)
        same[inner] = text[column[inner] - 1] == c
        diagonal = np.where(inner, cost + ~same, far)
        up = np.append(cost[1:] + 1, far)  # the item's character has no partner
        take_up = up < diagonal
        best = np.where(take_up, up, diagonal)
        start = np.where(take_up, np.append(begin[1:], 0), begin)
        best = np.where(ok, best, far)
        # A run of text characters without partner: the least of best + distance to the left.
        reach = np.minimum.accumulate((best - offsets) * n + offsets)
        source = reach % n
        cost = np.minimum(np.where(ok, best[source] + offsets - source, far), far)
        begin = start[source]
        if cost.min() > most:
            return None
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), low + end + len(item)


def find_items(docs: DataFrame, items: DataFrame, q: int = Q, edits: float = EDITS) -> DataFrame:
    """Matches (doc_id, item_id, begin, end, edits) of docs (doc_id, text) with items (item_id, text).

    One row for each document and item, its best region; places are in the
    normalised text.  Items whose characters are few enough are broadcast; more
    are dealt to passes of about that size, and each pass's matches are written
    before the next pass's items are taken, so neither the driver nor a task ever holds more.
    """
    spark = docs.sparkSession
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = -(-chars // PASS_CHARS) or 1

    def matches(part: DataFrame) -> DataFrame:
        known = spark.sparkContext.broadcast([(r["item_id"], normalised(r["text"])) for r in part.collect()])
        return texts(docs).mapInArrow(_matches(known, q, edits), _MATCH)

    if passes == 1:
        return matches(items)
    stage, out = Stage(spark, "benchmark"), None
    for k in range(passes):
        found = stage.write(matches(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)), f"pass-{k}")
        out = found if out is None else out.unionByName(found)
    return out


def _matches(items: Broadcast, q: int, edits: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items.value, q, edits)
        for batch in batches:
            if not len(index.ids):
                continue
            ids = batch.column(0).to_pylist()
            size = np.asarray(pa.compute.binary_length(batch.column(1))).astype(np.int64)
            for lo, hi in slices(size, 1 << 19):
                parts = [_chars(normalised(t)) for t in batch.column(1)[lo:hi].to_pylist()]
                first = np.cumsum([0, *map(len, parts)])
                best: dict[tuple[int, int], tuple] = {}
                for text, item, low, high in zip(*index.bands(np.concatenate(parts), first)):
                    most = int(index.edits[item])
                    low, high = max(int(low) - most, -int(index.size[item])), min(int(high) + most, len(parts[text]))
                    at = banded_alignment(index.chars[item], parts[text], low, high, most)
                    if at and at < best.get((text, item), (most + 1,)):
                        best[text, item] = at
                if best:
                    rows = [(ids[lo + t], int(index.ids[i]), b, e, d) for (t, i), (d, b, e) in best.items()]
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "item_id", "begin", "end", "edits"]
                    )

    return run


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold a benchmark item, with the item, its place and the edits."""
    return find_items(texts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
