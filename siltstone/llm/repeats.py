"""Removal of windows that also start in a document with a smaller id: the shared frame.

A unit is a word or a byte.  The frame is the same for both; what a group does
with its suffixes is the operator's own method.

1. The texts are written once, where they are read, in buckets of their partition's
   number.  They never cross a shuffle: what later steps find out about a text
   comes to its bucket.
2. Exact copies: texts are grouped by SHA-256; a copy of a smaller id is removed
   whole (if it has a window at all) and is no further work.
3. Sampling: the suffixes at window minima are sampled, so every window has one,
   and equal windows have it at the same place.  The sampled suffix's first k units are its
   prefix.  Only prefixes that two documents share can lead to a repeat; their
   hashes are dealt by bucket and compared there.
4. Groups: the run of windows around a sampled suffix is a region, and goes to the
   group of its prefix.  A block sends each distinct region once, for its
   smallest document; for the block's other documents the region is settled.  A
   prefix with too many regions for one task is lengthened to the whole window: its
   windows are dealt as groups of their own, of which a block sends one each.
5. A group sorts the suffixes that start at the windows of its distinct regions and
   finds, for each 50-unit string, the smallest document that has it.
6. Spans go back to their texts' buckets.

Places and spans travel as arrays, one row per pair of partitions, not one row
per document and group.

No step gathers a key's rows: hot texts, lines and passages are reduced to one row
a block before each shuffle.  Hashes only bring texts together: regions and suffixes
count as equal when their bytes or words are.  Exact copies are judged by SHA-256,
windows of lengthened prefixes by two 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, joined_by_bucket, partitions, texts
from .kernels import arrow_bytes, binary_array, byte_units, mix, range_hashes, ranges, winnow, word_bounds, word_hashes
from .tokens import slices

#: Bytes of text that one vector pass handles, sampled suffixes a block compares at once, bytes of regions a block holds.
PASS_BYTES, BLOCK_ANCHORS, BLOCK_REGION_BYTES = 2 << 20, 400_000, 24 << 20
#: Group buckets of a partition: memory per bucket is that of a partition by this number.
SUB_BUCKETS = 4
#: Suffixes that are sorted at once, and sampled suffixes of one prefix from which it is lengthened.
GROUP_SUFFIXES, HOT_PREFIX = 400_000, 50_000

Nodes = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Rule:
    """words: units are words, else bytes; a repeat has `window` units; prefixes have k units.

    deep_nodes takes units, suffix starts, their documents and a depth, and gives
    the suffixes in nodes of that depth, the node of each, and each node's least document.
    """

    words: bool
    window: int
    k: int
    deep_nodes: Callable[[np.ndarray, np.ndarray, np.ndarray, int], Nodes]


def _units(rule: Rule, buf: np.ndarray, offsets: np.ndarray):
    """Hashed units, unit offsets of the texts, and byte bounds of the units (None for bytes)."""
    if not rule.words:
        return byte_units(buf), offsets, None, None
    start, end, first = word_bounds(buf, offsets)
    return word_hashes(buf, start, end), first, start, end


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], names=list(names))


# ---- values of texts on their way to the texts' buckets

#: slot: the bucket of the texts; rows: their row numbers; counts: how many values each has; payload: the values.
_PACKED = "slot int, rows binary, counts binary, payload binary"


def _packed(rows: np.ndarray, slots: np.ndarray, values: np.ndarray) -> list[tuple]:
    """Values of texts, as one row for each slot."""
    order = np.lexsort((rows, slots))
    rows, slots, values = rows[order], slots[order], values[order]
    begins = np.flatnonzero(_heads(slots, rows))
    ends = np.append(begins[1:], len(rows))
    cuts = np.flatnonzero(_heads(slots[begins]))
    out = []
    for lo, hi in zip(cuts, np.append(cuts[1:], len(begins))):
        inside = values[begins[lo] : ends[hi - 1]].astype("<u4")
        out.append((int(slots[begins[lo]]), rows[begins[lo:hi]].tobytes(), (ends - begins)[lo:hi].astype("<u4").tobytes(), inside.tobytes()))
    return out


_GATHERED = "part int, row long, at binary"


def _gathered(width: int):
    """The values of each text of a slot, in one row; overlapping spans (width 2) are joined.

    What carries no rows (a bucket's long list of prefixes) passes through without a part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for slot, rows, counts, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if rows is None:
                    yield _batch([(None, slot, payload)], _GATHERED)
                else:
                    row = np.repeat(np.frombuffer(rows, np.int64), np.frombuffer(counts, "<u4"))
                    parts.append((row, np.frombuffer(payload, "<u4").reshape(-1, width)))
        if not parts:
            return
        rows, values = (np.concatenate(x) for x in zip(*parts))
        if width == 2:
            rows, _, values = joined_spans(rows, rows, values)
        order = np.argsort(rows, kind="stable")
        rows, values = rows[order], values[order].astype("<u4")
        begins = np.append(np.flatnonzero(_heads(rows)), len(rows))
        for lo in range(0, len(begins) - 1, 1 << 16):
            some = begins[lo : lo + (1 << 16) + 1]
            inside = values[some[0] : some[-1]]
            row = rows[some[:-1]]
            at = binary_array(np.frombuffer(inside.tobytes(), np.uint8), (some - some[0]) * 4 * width)
            yield pa.RecordBatch.from_arrays([pa.array((row >> 33).astype(np.int32)), pa.array(row), at], names=["part", "row", "at"])

    return run


def joined_spans(rows: np.ndarray, slots: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of texts, with the overlapping ones of a text joined."""
    order = np.lexsort((spans[:, 0], rows))
    rows, slots, spans = rows[order], slots[order], spans[order].astype(np.int64)
    new = _heads(rows)
    text = np.cumsum(new) - 1
    reach = np.maximum.accumulate(spans[:, 1] + (text << 34)) - (text << 34)
    begins = np.flatnonzero(np.concatenate([[True], new[1:] | (spans[1:, 0] > reach[:-1])]))
    return rows[begins], slots[begins], np.stack([spans[begins, 0], reach[np.append(begins[1:], len(rows)) - 1]], axis=1)


# ---- sampled suffixes

_SAMPLED = "bucket int, rows binary, docs binary, slots binary, text binary, hashes binary, low binary, high binary"


def _sample_rows(rows, docs, slots, text, hashes, pos, buckets: int) -> pa.RecordBatch:
    """One row per bucket: the prefixes of a block, without hashes where the block itself shows that they are shared."""
    out = []

    def add(bucket: int, at: np.ndarray, with_hash: bool) -> None:
        used, compact = np.unique(text[at], return_inverse=True)
        out.append(
            (
                bucket,
                rows[used].tobytes(),
                docs[used].tobytes(),
                slots[used].tobytes(),
                compact.astype("<u4" if len(used) > 1 << 16 else "<u2").tobytes(),
                (hashes[at] >> np.uint64(32)).astype("<u4").tobytes() if with_hash else None,
                (pos[at] & 0xFFFF).astype("<u2").tobytes(),
                (pos[at] >> 16).astype("<u2").tobytes(),
            )
        )

    order = np.argsort(hashes, kind="stable")
    d = docs[text[order]]
    head = _heads(hashes[order])
    run = np.cumsum(head) - 1
    begins = np.flatnonzero(head)
    several = np.minimum.reduceat(d, begins) != np.maximum.reduceat(d, begins)
    settled = several[run]
    local = np.sort(order[settled])
    sent = np.sort(order[~settled | head])
    bucket = (hashes[sent] % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        add(int(b), sent[by[cuts[b] : cuts[b + 1]]], True)
    if len(local):
        at = rows[text[local]] % buckets
        for b in np.unique(at):
            add(int(b), local[at == b], False)
    return _batch(out, _SAMPLED)


def _sampled(rule: Rule, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        texts_: list[tuple[np.ndarray, ...]] = []
        n = n_texts = 0

        def full() -> pa.RecordBatch:
            rows, docs, slots = (np.concatenate(x) for x in zip(*texts_))
            text, hashes, pos = (np.concatenate(x) for x in zip(*held))
            return _sample_rows(rows, docs, slots, text, hashes, pos, buckets)

        for batch in batches:
            own = [np.asarray(batch.column(i)) for i in range(3)]
            buf, offsets = arrow_bytes(batch.column(3))
            for lo, hi in slices(np.diff(offsets), PASS_BYTES):
                part = offsets[lo : hi + 1]
                units, first, _, _ = _units(rule, buf[part[0] : part[-1]], part - part[0])
                at, h, _, _, text = winnow(units, first, rule.window, rule.k)
                if len(at):
                    texts_.append(tuple(x[lo:hi] for x in own))
                    held.append((text + n_texts, h, at - first[text]))
                    n, n_texts = n + len(at), n_texts + hi - lo
                if n >= BLOCK_ANCHORS:
                    yield full()
                    held, texts_, n, n_texts = [], [], 0, 0
        if held:
            yield full()

    return run


def _shared(hot: int):
    """Of a bucket of prefixes, the places of those that two documents have, and the list of those that need to be lengthened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        sure: list[tuple[np.ndarray, ...]] = []
        out: list[tuple] = []
        for batch in batches:
            for bucket, rows, docs, slots, text, hashes, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                rows, docs, slots = np.frombuffer(rows, np.int64), np.frombuffer(docs, np.int64), np.frombuffer(slots, np.int32)
                low = np.frombuffer(low, "<u2").astype(np.uint32)
                pos = low | np.frombuffer(high, "<u2").astype(np.uint32) << np.uint32(16)
                text = np.frombuffer(text, "<u4" if len(rows) > 1 << 16 else "<u2")
                if hashes is None:
                    sure.append((rows[text], slots[text], pos))
                else:
                    held.setdefault(bucket, []).append((np.frombuffer(hashes, "<u4"), docs[text], rows[text], slots[text], pos))
        for bucket, parts in held.items():
            hashes, doc, row, slot, pos = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(hashes, kind="stable")
            d, head = doc[order], _heads(hashes[order])
            begins = np.flatnonzero(head)
            several = np.minimum.reduceat(d, begins) != np.maximum.reduceat(d, begins)
            at = order[several[np.cumsum(head) - 1]]
            sure.append((row[at], slot[at], pos[at]))
            crowded = np.diff(np.append(begins, len(order))) > hot
            if crowded.any():
                out.append((bucket, None, None, hashes[order[begins[crowded]]].tobytes()))
        if any(len(row) for row, _, _ in sure):
            row, slot, pos = (np.concatenate(x) for x in zip(*sure))
            out += _packed(row, slot, pos)
        if out:
            yield _batch(out, _PACKED)

    return run


# ---- regions

#: kind C: regions of a bucket of groups; W: windows of lengthened prefixes; S: settled spans.
_REGIONS = "kind string, bucket int, rows binary, docs binary, slots binary, starts binary, sizes binary, marks binary, counts binary, content binary"


def _same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the bytes of the given (positive) sizes at the places a and b are the same."""
    if not len(a):
        return np.empty(0, bool)
    other = buf[ranges(a, sizes)] != buf[ranges(b, sizes)]
    return ~np.logical_or.reduceat(other, np.cumsum(sizes) - sizes)


def _settled(rows, slots, spans) -> list[tuple]:
    """Spans as rows of the regions' form."""
    found = _packed(*joined_spans(rows, slots, spans)) if len(rows) else []
    return [("S", slot, r, None, None, None, None, None, c, payload) for slot, r, c, payload in found]


def _first_of_equals(buf: np.ndarray, at: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range of bytes, one of the smallest document with the same bytes (itself, if that is of its document), and its document."""
    order = np.lexsort((docs, sizes, hashes))
    head = _heads(hashes[order], sizes[order])
    first = np.empty(len(order), np.int64)
    first[order] = order[np.flatnonzero(head)][np.cumsum(head) - 1]
    rest = np.flatnonzero(first != np.arange(len(first)))
    wrong = rest[~_same_bytes(buf, at[rest], at[first[rest]], sizes[rest])]
    first[wrong] = wrong  # equal hashes, other bytes: each on its own
    return first, docs[first]


def _send_regions(rule: Rule, parts: list[tuple], buckets: int) -> Iterator[tuple]:
    """Distinct regions of a block by bucket, and spans that the block settles itself."""
    rows, docs, slots, starts, counts, hashes, marks, contents, sizes = (np.concatenate(x) for x in zip(*parts))
    at = np.cumsum(sizes) - sizes
    _, least = _first_of_equals(contents, at, sizes, hashes, docs)
    gone = np.flatnonzero(docs > least)
    yield from _settled(rows[gone], slots[gone], np.stack([starts[gone], starts[gone] + counts[gone] + rule.window - 1], axis=1))
    sent = np.flatnonzero(docs == least)
    bucket = (marks[sent] % np.uint64(buckets)).astype(np.int64)
    by = sent[np.argsort(bucket, kind="stable")]
    cuts = np.searchsorted(np.sort(bucket), np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        i = by[cuts[b] : cuts[b + 1]]
        yield (
            "C", int(b), rows[i].tobytes(), docs[i].tobytes(), slots[i].tobytes(), starts[i].astype("<u4").tobytes(), sizes[i].astype("<u4").tobytes(),
            marks[i].tobytes(), None, contents[ranges(at[i], sizes[i])].tobytes(),
        )


def _regions(rule: Rule, buckets: int):
    """From texts with the places of their shared prefixes: regions by bucket, and settled spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        part_bytes = 0
        for batch in batches:
            own = [np.asarray(batch.column(i)) for i in range(3)]
            buf, offsets = arrow_bytes(batch.column(3))
            places, cuts = arrow_bytes(batch.column(4))
            places, cuts = np.frombuffer(places.tobytes(), "<u4").astype(np.int64), cuts // 4
            for lo, hi in slices(np.diff(offsets), PASS_BYTES):
                part = offsets[lo : hi + 1]
                text_buf = buf[part[0] : part[-1]]
                units, first, start, end = _units(rule, text_buf, part - part[0])
                at, mark, left, right, text = winnow(units, first, rule.window, rule.k)
                top = np.int64(1) << 33
                wanted = places[cuts[lo] : cuts[hi]] + top * np.repeat(np.arange(hi - lo), np.diff(cuts[lo : hi + 1]))
                keep = np.isin(at - first[text] + top * text, wanted)
                mark, left, right, text = (x[keep] for x in (mark, left, right, text))
                if not len(mark):
                    continue
                stop = right + rule.window  # past the last unit of the region
                if rule.words:  # each region ends with a space, so that their words stay apart
                    begin, sizes = start[left], end[stop - 1] - start[left] + 1
                    content = np.append(text_buf, np.uint8(32))[ranges(begin, sizes)]
                    content[np.cumsum(sizes) - 1] = 32
                else:
                    sizes = stop - left
                    content = text_buf[ranges(left, sizes)]
                rows, docs, slots = (x[lo:hi][text] for x in own)
                parts.append((rows, docs, slots, left - first[text], right - left + 1, range_hashes(units, left, stop), mark, content, sizes))
                part_bytes += len(content) + 64 * len(mark)
                if part_bytes >= BLOCK_REGION_BYTES:
                    yield _batch(list(_send_regions(rule, parts, buckets)), _REGIONS)
                    parts, part_bytes = [], 0
        if parts:
            yield _batch(list(_send_regions(rule, parts, buckets)), _REGIONS)

    return run


def _lengthened(rule: Rule, buckets: int):
    """Regions of crowded prefixes as windows on their own, dealt by two hashes of the window; all other regions as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for bucket, *row, content, crowded in zip(*(c.to_pylist() for c in batch.columns)):
                kinds = (np.int64, np.int64, np.int32, "<u4", "<u4", np.uint64)
                rows, docs, slots, starts, sizes, marks = (np.frombuffer(x, t) for x, t in zip(row, kinds))
                hot = np.isin((marks >> np.uint64(32)).astype(np.uint32), np.frombuffer(crowded or b"", "<u4"))
                sizes = sizes.astype(np.int64)
                buf, at = np.frombuffer(content, np.uint8), np.cumsum(sizes) - sizes
                if not hot.all():
                    i = np.flatnonzero(~hot)
                    columns = (rows, docs, slots, starts, sizes.astype("<u4"), marks)
                    out.append(("C", bucket, *(x[i].tobytes() for x in columns), None, buf[ranges(at[i], sizes[i])].tobytes()))
                if hot.any():
                    i = np.flatnonzero(hot)
                    units, first, _, _ = _units(rule, buf[ranges(at[i], sizes[i])], np.concatenate([[0], np.cumsum(sizes[i])]))
                    n = np.diff(first) - rule.window + 1
                    begin = ranges(first[:-1], n)
                    of = np.repeat(i, n)
                    start = starts[of] + begin - np.repeat(first[:-1], n)
                    prints = np.stack([range_hashes(u, begin, begin + rule.window) for u in (units, mix(units ^ np.uint64(0x5851F42D4C957F2D)))], axis=1)
                    order = np.lexsort((docs[of], prints[:, 1], prints[:, 0]))
                    head = _heads(prints[order, 0], prints[order, 1])
                    least = docs[of[order]][np.flatnonzero(head)][np.cumsum(head) - 1]
                    own = docs[of[order]] == least
                    gone, sent = order[~own], order[own]
                    out += _settled(rows[of[gone]], slots[of[gone]], np.stack([start[gone], start[gone] + rule.window], axis=1))
                    to = (prints[sent, 0] % np.uint64(buckets)).astype(np.int64)
                    for b in np.unique(to):
                        s = sent[to == b]
                        columns = (rows[of[s]], docs[of[s]], slots[of[s]], start[s].astype("<u4"))
                        out.append(("W", int(b), *(x.tobytes() for x in columns), None, None, None, prints[s].tobytes()))
            if out:
                yield _batch(out, _REGIONS)

    return run


def _exact_units(rule: Rule, content: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units of some regions that are equal only if their bytes are, and where each region's begin."""
    if not rule.words:
        return content, np.concatenate([[0], np.cumsum(sizes)])
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    words = content.tobytes().split()
    _, _, first = word_bounds(content, np.concatenate([[0], np.cumsum(sizes)]))
    return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), first


def covered_windows(rule: Rule, docs: np.ndarray, content: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of which regions start in a smaller document too: (region, window) pairs.

    Equal regions are one: only that of the smallest document is sorted, and
    the others' windows are covered all.
    """
    at = np.cumsum(sizes) - sizes
    hashes = range_hashes(byte_units(content), at, at + sizes)
    first_of, least = _first_of_equals(content, at, sizes, hashes, docs)
    one, of = np.unique(first_of, return_inverse=True)
    units, first = _exact_units(rule, content[ranges(at[one], sizes[one])], sizes[one])
    n = np.diff(first) - rule.window + 1
    starts, owner = ranges(first[:-1], n), np.repeat(np.arange(len(one)), n)
    doc = docs[one][owner]
    leaves, node, smallest = rule.deep_nodes(units, starts, doc, rule.window)
    hit = np.zeros(len(starts), dtype=bool)
    hit[leaves] = smallest[node] < doc[leaves]
    base = np.cumsum(n) - n
    whole, some = np.flatnonzero(docs > least), np.flatnonzero(docs == least)
    index = ranges(base[of[some]], n[of[some]])
    mine, window = np.repeat(some, n[of[some]]), ranges(np.zeros(len(some), np.int64), n[of[some]])
    all_of = np.repeat(whole, n[of[whole]]), ranges(np.zeros(len(whole), np.int64), n[of[whole]])
    return np.concatenate([all_of[0], mine[hit[index]]]), np.concatenate([all_of[1], window[hit[index]]])


def _resolve(rule: Rule):
    """Spans from the regions and windows of each bucket of groups."""

    def spans(rows, slots, begin) -> tuple | None:
        return joined_spans(rows, slots, np.stack([begin, begin + rule.window], axis=1)) if len(rows) else None

    def of_regions(held: list[tuple]) -> Iterator[tuple | None]:
        kinds = (np.int64, np.int64, np.int32, "<u4", "<u4", np.uint64)
        rows, docs, slots, starts, sizes, marks = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*(h[:6] for h in held)), kinds))
        content = np.frombuffer(b"".join(h[6] for h in held), np.uint8)
        starts, sizes = starts.astype(np.int64), sizes.astype(np.int64)
        at = np.cumsum(sizes) - sizes
        # Groups are taken together up to the memory limit: prefixes are dealt, and none is cut.
        piece = mix(marks) % np.uint64(1 + len(content) // GROUP_SUFFIXES)
        for p in np.unique(piece):
            i = np.flatnonzero(piece == p)
            region, window = covered_windows(rule, docs[i], content[ranges(at[i], sizes[i])], sizes[i])
            yield spans(rows[i][region], slots[i][region], starts[i][region] + window)

    def of_windows(held: list[tuple]) -> tuple | None:
        rows, docs, slots, starts = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*(h[:4] for h in held)), (np.int64, np.int64, np.int32, "<u4")))
        prints = np.frombuffer(b"".join(h[6] for h in held), np.uint64).reshape(-1, 2)
        order = np.lexsort((docs, prints[:, 1], prints[:, 0]))
        head = _heads(prints[order, 0], prints[order, 1])
        least = docs[order][np.flatnonzero(head)][np.cumsum(head) - 1]
        gone = order[docs[order] > least]
        return spans(rows[gone], slots[gone], starts[gone].astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {"C": [], "W": []}
        found: list[tuple] = []
        now = None

        def settle() -> None:
            if held["C"]:
                found.extend(f for f in of_regions(held["C"]) if f)
            if held["W"] and (f := of_windows(held["W"])):
                found.append(f)
            held["C"], held["W"] = [], []

        for batch in batches:
            for kind, bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now:
                    settle()
                now = bucket
                held[kind].append(tuple(row))
        settle()
        if found:
            yield _batch(_packed(*(np.concatenate(x) for x in zip(*found))), _PACKED)

    return run


# ---- finished texts

_FINISHED = "doc_id long, n_units long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _finished(rule: Rule, text: bytes, copy: bool, edges: bytes | None) -> tuple:
    """Units, removed units, spans, hash and bytes of a text without its spans; a copy of a window or more loses all."""
    units = text.split() if rule.words else np.frombuffer(text, np.uint8)  # ASCII white space only, as the contract has it
    n = len(units)
    mask = None
    if copy:
        mask = np.ones(n, bool) if n >= rule.window else None
    elif edges is not None:
        begin, end = np.frombuffer(edges, "<u4").reshape(-1, 2).T
        mask = np.cumsum(np.bincount(begin, minlength=n + 1) - np.bincount(end, minlength=n + 1))[:n] > 0
    if rule.words:
        kept = b" ".join(units if mask is None else compress(units, ~mask))
    else:
        kept = text if mask is None else units[~mask].tobytes()
    if mask is None or not n:
        return n, 0, 0, kept
    return n, int(mask.sum()), int(mask[0]) + int(np.count_nonzero(mask[1:] & ~mask[:-1])), kept


def _finish(rule: Rule, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(pa.compute.binary_length(batch.column(1)))
            for lo, hi in slices(size, PASS_BYTES):
                ids, texts_, copies, edges = (c[lo:hi].to_pylist() for c in batch.columns)
                out = []
                for doc, text, copy, edge in zip(ids, texts_, copies, edges):
                    *counts, kept = _finished(rule, text, bool(copy), edge)
                    out.append((doc, *counts, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
                yield _batch(out, _FINISHED)

    return run


def remove_repeats(docs: DataFrame, rule: Rule, name: str, keep_text: bool = False, hot: int = HOT_PREFIX) -> DataFrame:
    """(doc_id, n_units, n_removed, n_spans, kept_sha256, kept) for each row of docs (doc_id, text).

    kept is the remaining text, as bytes, if keep_text is set, else null.  Rows
    with a null doc_id have no order: they stay whole and remove nothing.
    Rows of one doc_id don't remove each other.  Prefixes of more than `hot`
    sampled suffixes are lengthened.
    """
    spark = docs.sparkSession
    stage, n = Stage(spark, name), min(partitions(spark), 100_000)
    rows = texts(docs).withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", 33).cast("int"))
    bodies = stage.write_bucketed(rows, "bodies", n, "part")
    slot = F.pmod(F.hash("part"), F.lit(n)).cast("int").alias("slot")  # the bucket that Spark puts a part in

    prints = stage.write(bodies.where("doc_id IS NOT NULL").select("part", "row", "doc_id", F.sha2("text", 256).alias("print")), "prints")
    groups = prints.groupBy("print").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    groups = stage.write(groups.drop("last"), "groups")  # written, so that the join may split a hot print's rows
    copies = stage.write(prints.join(groups.hint("merge"), "print").where("doc_id > first").select("part", "row"), "copies")

    with joined_by_bucket(spark):
        known = bodies.where("doc_id IS NOT NULL").join(copies.hint("shuffle_hash"), ["part", "row"], "left_anti")
        sampled = known.select("row", "doc_id", slot, "text").mapInArrow(_sampled(rule, n), _SAMPLED)
        shared = sampled.repartitionById(n, F.col("bucket")).mapInArrow(_shared(hot), _PACKED)
        places = stage.write_bucketed(shared.repartitionById(n, F.col("slot")).mapInArrow(_gathered(1), _GATHERED), "places", n, "part")

        met = bodies.join(places.where("part IS NOT NULL").hint("shuffle_hash"), ["part", "row"])
        found = stage.write(met.select("row", "doc_id", slot, "text", "at").mapInArrow(_regions(rule, n * SUB_BUCKETS), _REGIONS), "regions")
        crowded = places.where("part IS NULL").select(F.col("row").cast("int").alias("base"), F.col("at").alias("crowded"))
        if not crowded.isEmpty():
            regions = found.where("kind = 'C'").withColumn("base", F.col("bucket") % n).join(crowded, "base", "left")
            regions = regions.select("bucket", "rows", "docs", "slots", "starts", "sizes", "marks", "content", "crowded")
            regions = regions.mapInArrow(_lengthened(rule, n * SUB_BUCKETS), _REGIONS)
            found = stage.write(regions.unionByName(found.where("kind = 'S'")), "lengthened")

        groups = found.where("kind != 'S'").select("kind", "bucket", "rows", "docs", "slots", "starts", "sizes", "marks", "content")
        groups = groups.repartitionById(n, F.col("bucket") % n).sortWithinPartitions("bucket")
        settled = found.where("kind = 'S'").select(F.col("bucket").alias("slot"), "rows", "counts", F.col("content").alias("payload"))
        spans = groups.mapInArrow(_resolve(rule), _PACKED).unionByName(settled)
        spans = stage.write_bucketed(spans.repartitionById(n, F.col("slot")).mapInArrow(_gathered(2), _GATHERED), "spans", n, "part")
        stage.drop("prints", "groups", "places", "regions", "lengthened")

        rest = bodies.join(spans.hint("shuffle_hash"), ["part", "row"], "left").join(
            copies.withColumn("copy", F.lit(True)).hint("shuffle_hash"), ["part", "row"], "left"
        )
        rest = rest.select("doc_id", F.encode("text", "UTF-8"), "copy", "at").mapInArrow(_finish(rule, keep_text), _FINISHED)
        out = stage.write(rest, "finished")
    stage.drop("bodies", "copies", "spans")
    return out
