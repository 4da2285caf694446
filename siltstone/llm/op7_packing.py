"""Best-fit packing after Martello-Toth dominance reduction.

Documents become tokenised pieces of at most one sequence.  Only the histogram
of piece lengths (as many entries as a sequence has tokens) reaches the driver:
the reduction and best-fit work on whole classes of equal lengths and give
patterns with multiplicities.  The pieces then find their places on the
executors: a piece's rank among those of its length decides pattern, sequence
and offset.

Cases: a null or empty text is the end id alone; repeated texts and ids are
separate pieces; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage, partitions, table, texts
from .tokens import encoder, slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenised_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Lengths and checksums of every document's pieces, without the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, "drop")
        end = np.array([end_id], dtype="<u4")
        try:
            for batch in batches:
                ids, text = batch.column(0).to_pylist(), batch.column(1)
                for lo, hi in slices(np.asarray(pa.compute.binary_length(text)).astype(np.int64), 4 << 20):
                    rows: list[tuple] = []
                    for doc, found in zip(ids[lo:hi], encode(text[lo:hi].to_pylist())):
                        all_ids = np.concatenate([np.frombuffer(found, encode.dtype).astype("<u4"), end])
                        for piece, at in enumerate(range(0, len(all_ids), capacity)):
                            part = all_ids[at : at + capacity]
                            rows.append((doc, piece, at, len(part), zlib.crc32(part)))
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                        names=["doc_id", "piece", "start", "length", "ids_crc32"],
                    )
        finally:
            encode.forget()

    return docs.mapInArrow(run, PIECES)


def reduce_by_dominance(count: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Fix, for all multiplicities at once, sequences that dominate every alternative.

    For the largest open length j: alone, if nothing fits beside it; with one
    partner of capacity - j, which no other set can beat; or with the largest
    fitting partner, if no two pieces fit beside j.  `count` loses what is fixed.
    Returns (items as (length, number), times).
    """
    fixed: list[tuple[list[tuple[int, int]], int]] = []

    def take(items: list[tuple[int, int]], times: int) -> None:
        for size, m in items:
            count[size] -= m * times
        fixed.append((items, times))

    if count[capacity]:
        take([(capacity, 1)], int(count[capacity]))
    changed = True
    while changed:
        changed = False
        for j in range(capacity - 1, 0, -1):
            while count[j]:
                room = capacity - j
                if room == j and count[j] >= 2:
                    take([(j, 2)], int(count[j]) // 2)
                    changed = True
                    continue
                if room != j and count[room]:
                    take([(j, 1), (room, 1)], int(min(count[j], count[room])))
                    changed = True
                    continue
                count[j] -= 1  # the partners are others than j itself
                present = np.flatnonzero(count[: room + 1])
                count[j] += 1
                if not len(present):
                    # Nothing fits beside one of them, so nothing ever fits beside any of them.
                    take([(j, 1)], int(count[j]))
                    changed = True
                    continue
                first = int(present[0])
                own = int(count[first]) - (first == j)
                second = first if own >= 2 else int(present[1]) if len(present) > 1 else capacity
                best = int(present[-1])
                if first + second > room and best < j:
                    take([(j, 1), (best, 1)], int(min(count[j], count[best])))
                    changed = True
                    continue
                break
    return fixed


def best_fit(count: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing over classes of equal lengths; `count` is used up."""
    rooms: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    order: list[int] = []

    def put(room: int, items: list[tuple[int, int]], times: int) -> None:
        if times:
            if room not in rooms:
                insort(order, room)
                rooms[room] = []
            rooms[room].append((items, times))

    for size in range(capacity, 0, -1):
        left = int(count[size])
        count[size] = 0
        while left:
            at = bisect_left(order, size)
            if at < len(order):
                room = order[at]
                items, times = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    order.pop(at)
            else:
                room, items, times = capacity, [], left
            each = room // size
            full = min(times, left // each)
            put(room - each * size, [*items, (size, each)], full)
            left -= full * each
            rest = times - full
            if rest and left and left < each:
                put(room - left * size, [*items, (size, left)], 1)
                left, rest = 0, rest - 1
            if items:
                put(room, items, rest)
    return [pattern for found in rooms.values() for pattern in found]


def places(patterns: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """Rank intervals by length: where the pieces of each length go, ordered by (length, first rank).

    The size is bounded by the patterns, and these by the lengths: each pattern
    uses up a class of lengths or of rooms.
    """
    rows, used, base = [], {}, 0
    for items, times in patterns:
        offset = 0
        for size, m in items:
            rank = used.get(size, 0)
            rows.append((size, rank, m, base, offset))
            used[size] = rank + m * times
            offset += size * m
        base += times
    table_ = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("size", "rank", "each", "base", "offset"), table_.T.copy()))


def pack(pieces: DataFrame, capacity: int, length_col: str = "length", order_cols: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add sequence_id and offset to pieces of 1..capacity units.

    `pieces` should be a written table: it is read for the histogram and again
    for the ranks.  Ranks are taken within (length, block) and shifted by the
    counts of earlier blocks, so a length that a third of all rows share is
    ranked by as many tasks as there are blocks.
    """
    spark = pieces.sparkSession
    blocks = partitions(spark)
    cut = pieces.withColumn("_block", F.pmod(F.xxhash64(*order_cols), F.lit(blocks)).cast("int"))
    sizes = cut.groupBy(F.col(length_col).alias("_size"), "_block").agg(F.count("*").alias("_n"))
    histogram = sizes.groupBy("_size").agg(F.sum("_n").alias("n")).collect()
    count = np.zeros(capacity + 1, dtype=np.int64)
    for row in histogram:
        count[row["_size"]] = row["n"]
    left = count.copy()
    where = places(reduce_by_dominance(left, capacity) + best_fit(left, capacity))

    earlier = Window.partitionBy("_size").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("_size", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(length_col, "_block").orderBy(*order_cols)
    ranked = cut.withColumn("_rank", F.row_number().over(inside).cast("long") - 1)
    ranked = ranked.join(
        first.withColumnRenamed("_block", "_b"), (F.col(length_col) == F.col("_size")) & (F.col("_block") == F.col("_b")), "left"
    )
    ranked = ranked.select(*pieces.columns, (F.col("_rank") + F.col("_first")).alias("_rank"))
    shift = np.int64(1) << 42
    keys = where["size"] * shift + where["rank"]
    at_size, at_rank = pieces.columns.index(length_col), len(pieces.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(batch.column(at_size)).astype(np.int64)
            rank = np.asarray(batch.column(at_rank)).astype(np.int64)
            k = np.searchsorted(keys, size * shift + rank, side="right") - 1
            past = rank - where["rank"][k]
            sequence = where["base"][k] + past // where["each"][k]
            offset = where["offset"][k] + past % where["each"][k] * size
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"]
            )

    kinds = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenised, in sequences of at most 4096 tokens."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1, 4096)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Tokenise documents (doc_id, text) with a word-end BPE and pack their pieces."""
    stage = Stage(docs.sparkSession, "packing")
    return pack(stage.write(tokenised_pieces(texts(docs), tokenizer, end_id, capacity), "pieces"), capacity)
