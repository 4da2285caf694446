"""Embedding near-dedup by sorted projection passes.

A pass orders the vectors lexicographically by concatenated random hashes (signs
of random projections) and compares each with a bounded window of neighbours;
verified pairs of all passes are united.

Windows alone would miss pairs of a crowd that is larger than a window.  So the
passes first gather crowds into cells: a cell's vectors lie so near its leader
that any two of them are linked.  Then cells whose leaders link with one leader
among them form groups: crowds whose members link but lie too far apart for a
cell.  One verified pair between two groups makes them neighbours; each group is
compared whole with itself and its neighbours, in blocks, with links counted and
not listed.

Gathering takes rounds until no row joins.  In a round, rows that have no
neighbour of a lower rank lead (ranks are scattered ids), and all rows near a
leader join one.

Cases: null, empty or zero vectors, and vectors with null, NaN or infinite parts,
link with nothing; vectors of different lengths link with nothing of another
length; equal vectors are one for the search and linked with each other; rows of one vec_id are
one node of the graph, each with its own vector, and n_links is the most that one of the
vectors has; rows with a null vec_id link with nothing and are kept; an empty table gives no
rows; other columns do not matter.

A distinct vector has a number of its own for the search, so that several vectors of one
vec_id stay apart; links are between vec_ids again at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, partitions, table
from .components import components

#: Neighbours on either side, hash bits of a pass, passes at least, recall at the threshold that the passes aim at.
WINDOW, BITS, LEAST_PASSES, RECALL = 64, 62, 8, 0.98
#: Rows of a block of a group.
BLOCK = 1024


def passes(n: int, threshold: float, window: int = WINDOW) -> int:
    """Passes after which a pair at the threshold has been neighbours once, with the aimed probability."""
    same = 1 - math.acos(threshold) / math.pi
    once = same ** max(1.0, math.log2(max(2.0, n / window)))
    return max(LEAST_PASSES, math.ceil(math.log(1 - RECALL) / math.log(1 - min(once, 1 - 1e-9))))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, as unit rows in double precision."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = values.reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _hashed(times: int, seed: int):
    """A row for each vector and pass, with its key in that order; vectors keep their own precision on the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pa.compute.list_value_length(batch.column(2)))
            for size in np.unique(sizes):
                rows = batch.filter(pa.array(sizes == size))
                vectors = _matrix(rows.column(2))
                for p in range(times):
                    plane = np.random.default_rng([seed, p, int(size)]).standard_normal((int(size), BITS))
                    key = ((vectors @ plane) > 0) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), p, np.int32)), pa.array(np.full(len(rows), size, np.int32)), pa.array(key), *rows.columns],
                        names=["pass", "size", "key", *rows.schema.names],
                    )

    return run


def _windows(batches: Iterator[pa.RecordBatch], handle) -> Iterator[pa.RecordBatch]:
    """Blocks of an order with the window before them: calls handle(ids, cells, cosines, band) for pairs of rows."""
    ids = np.empty(0, np.int64)
    cells = np.empty(0, np.int64)
    vectors, now = None, None
    for batch in batches:
        order, size = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        cut = np.flatnonzero((order[1:] != order[:-1]) | (size[1:] != size[:-1])) + 1
        for lo, hi in zip([0, *cut], [*cut, len(order)]):
            part = batch.slice(lo, hi - lo)
            if (order[lo], size[lo]) != now:
                now, vectors = (order[lo], size[lo]), None
            for at in range(0, hi - lo, 512):
                block = part.slice(at, 512)
                new = _matrix(block.column(5))
                new_ids, new_cells = np.asarray(block.column(3)), np.asarray(block.column(4))
                if vectors is None:
                    ids, cells, vectors = new_ids[:0], new_cells[:0], new[:0]
                h = len(ids)
                ids, cells, vectors = np.concatenate([ids, new_ids]), np.concatenate([cells, new_cells]), np.concatenate([vectors, new])
                cosines = new @ vectors.T
                i, j = np.arange(len(new))[:, None] + h, np.arange(len(ids))[None, :]
                found = handle(ids, cells, h, cosines, (j < i) & (i - j <= WINDOW))
                if found is not None:
                    yield found
                ids, cells, vectors = ids[-WINDOW:], cells[-WINDOW:], vectors[-WINDOW:]


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _rank(ids: np.ndarray) -> np.ndarray:
    """Ids scattered over all 64-bit numbers, one to one."""
    return ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _ranked(limit: float):
    """Each vector of a window that has a neighbour within the limit, and 1 if one of them has a lower rank, else 0."""

    def handle(ids, cells, h, cosines, band):
        i, j = np.nonzero(band & (cosines >= limit))
        if not len(i):
            return None
        i = i + h
        rank = _rank(ids)
        lower = rank[j] < rank[i]
        beaten = np.zeros(len(ids), np.int64)
        beaten[i[lower]] = 1
        beaten[j[~lower]] = 1
        at = np.unique(np.concatenate([i, j]))
        return _pairs(ids[at], beaten[at])

    return lambda batches: _windows(batches, handle)


def _nearest_leader(limit: float):
    """For each vector of a window that does not lead (cell 0), the least leader (cell 1) within the limit."""

    def handle(ids, cells, h, cosines, band):
        i, j = np.nonzero(band & (cosines >= limit))
        i = i + h
        i, j = np.concatenate([i, j]), np.concatenate([j, i])
        led = (cells[i] == 0) & (cells[j] == 1)
        i, j = i[led], j[led]
        if not len(i):
            return None
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, i, ids[j])
        at = np.unique(i)
        return _pairs(ids[at], least[at])

    return lambda batches: _windows(batches, handle)


def _linked_cells(threshold: float):
    def handle(ids, cells, h, cosines, band):
        i, j = np.nonzero(band & (cosines >= threshold))
        a, b = cells[i + h], cells[j]
        other = a != b
        if not other.any():
            return None
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[other], axis=0)
        return _pairs(both[:, 0], both[:, 1])

    return lambda batches: _windows(batches, handle)


def _ordered(vectors: DataFrame, times: int, seed: int) -> DataFrame:
    """All passes' orders, cut into partitions by ranges of (pass, key): a crowd of near keys spreads over several."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    keyed = vectors.select("vec_id", "cell", "embedding").mapInArrow(_hashed(times, seed), f"pass int, size int, key long, vec_id long, cell long, embedding {kind}")
    order = ["pass", "size", "key", "vec_id"]
    return keyed.repartitionByRange(partitions(vectors.sparkSession), *order).sortWithinPartitions(*order)


def _gather(rows: DataFrame, limit: float, seed: int, stage: Stage, name: str) -> DataFrame:
    """(a, b): rows of (vec_id, embedding) that joined leader b, which lies within the limit of each."""
    free, settled, k = rows.select("vec_id", "embedding", F.lit(0).cast("long").alias("cell")), None, 0
    while True:
        k += 1
        ranked = _ordered(free, LEAST_PASSES, seed + k).mapInArrow(_ranked(limit), "a long, b long").groupBy("a").agg(F.max("b").alias("b"))
        ranked = stage.write(ranked, f"{name}-ranked-{k}")
        # Rows without a neighbour are done.
        near = free.join(ranked, F.col("vec_id") == F.col("a")).select("vec_id", "embedding", (1 - F.col("b")).alias("cell"))
        near = stage.write(near, f"{name}-near-{k}")
        joined = _ordered(near, LEAST_PASSES, seed + k).mapInArrow(_nearest_leader(limit), "a long, b long").groupBy("a").agg(F.min("b").alias("b"))
        joined = stage.write(joined, f"{name}-joined-{k}")
        settled = joined if settled is None else settled.unionByName(joined)
        if joined.isEmpty():
            return stage.write(settled, f"{name}-settled")
        left = near.where("cell = 0").join(joined.select(F.col("a").alias("vec_id")), "vec_id", "left_anti")
        free = stage.write(left, f"{name}-free-{k}")


def _count_links(threshold: float):
    """Links of each vector of a block with the vectors of other cells in another block: counts of copies, without a list of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for row in range(len(batch)):
                same = batch.column(0)[row].as_py()
                left, left_n, left_cell, left_v, right, right_n, right_cell, right_v = (c[row].values for c in batch.columns[1:])
                x, y = _matrix(left_v), _matrix(right_v)
                if x.shape[1] != y.shape[1]:
                    continue
                hit = ((x @ y.T) >= threshold) & (np.asarray(left_cell)[:, None] != np.asarray(right_cell)[None, :])
                ids.append(np.asarray(left))
                n.append(hit @ np.asarray(right_n))
                if not same:
                    ids.append(np.asarray(right))
                    n.append(hit.T @ np.asarray(left_n))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids), pa.int64()), pa.array(np.concatenate(n), pa.int64())], names=["vec_id", "n"])

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.9, seed: int = 90) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    stage = Stage(spark, "projections")
    floats = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "array<float>" if floats else "array<double>"  # floats are compared in double precision, but travel as they are
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    good = rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(finite)
    unique = good.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.max("vec_id").alias("last"), F.count("*").alias("n"))
    unique = stage.write(unique.withColumn("number", F.monotonically_increasing_id()), "unique")
    several = stage.write(unique.where("n > 1").select("first", "number", "embedding"), "several")
    copies = stage.write(good.join(several, "embedding").where("vec_id != first").select("vec_id", "first", "number").distinct(), "copies")
    named = stage.write(unique.select(F.col("number"), F.col("first")), "named")
    unique = unique.select(F.col("number").alias("vec_id"), "n", "embedding")

    n = unique.count()
    times = passes(n, threshold)
    half = math.cos(math.acos(threshold) / 2 - 1e-7)  # two vectors so near a leader are within the threshold of each other
    settled = _gather(unique, half, seed, stage, "cells")
    celled = unique.join(settled.select(F.col("a").alias("vec_id"), F.col("b").alias("cell")), "vec_id", "left")
    celled = stage.write(celled.select("vec_id", "n", "embedding", F.coalesce("cell", "vec_id").alias("cell")), "celled")
    led = _gather(celled.where("vec_id = cell"), threshold, seed + 1000, stage, "groups")
    grouped = celled.join(led.select(F.col("a").alias("cell"), F.col("b").alias("group")), "cell", "left")
    grouped = stage.write(grouped.select("vec_id", "n", "embedding", "cell", F.coalesce("group", "cell").alias("group")), "grouped")

    pairs = _ordered(grouped.select("vec_id", "embedding", F.col("group").alias("cell")), times, seed)
    pairs = stage.write(pairs.mapInArrow(_linked_cells(threshold), "a long, b long").distinct(), "group-pairs")
    sizes = grouped.groupBy("group", "cell").agg(F.sum("n").alias("all"), F.count("*").alias("members"))
    sizes = stage.write(sizes, "sizes")
    small = F.col("members") < BLOCK
    groups = sizes.groupBy("group").agg(F.count("*").alias("cells"), F.sum(F.when(small, F.col("members")).otherwise(0)).alias("small"))
    wanted = pairs.select(F.col("a").alias("group")).union(pairs.select(F.col("b").alias("group"))).union(groups.where("cells > 1").select("group")).distinct()
    dealt = grouped.join(sizes, ["group", "cell"])
    # A cell of a block or more has blocks of its own, which are not compared with each other; the others share blocks.
    big = F.when(~small, F.col("cell"))
    part = F.when(small, F.pmod(F.xxhash64("cell"), F.ceil(F.col("small") / BLOCK))).otherwise(F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("members") / BLOCK)))
    blocks = dealt.join(wanted, "group", "left_semi").join(groups, "group").select("vec_id", "n", "cell", "embedding", "group", big.alias("big"), part.alias("part"))
    blocks = blocks.groupBy("group", "big", "part", F.size("embedding").alias("size")).agg(
        F.collect_list("vec_id").alias("ids"), F.collect_list("n").alias("ns"), F.collect_list("cell").alias("cells"), F.collect_list("embedding").alias("vs")
    )
    blocks = blocks.withColumn("block", F.concat_ws("/", "group", F.coalesce(F.col("big").cast("string"), F.lit("")), "part", "size"))
    blocks = stage.write(blocks, "blocks", "uncompressed")
    head = lambda c: blocks.select(F.col("group").alias(c), F.col("big").alias(f"{c}_big"), F.col("size").alias(f"{c}_size"), F.col("block").alias(f"{c}_block"))
    own_pairs = head("a").join(head("b"), (F.col("a") == F.col("b")) & (F.col("a_block") <= F.col("b_block")) & ~F.coalesce(F.col("a_big") == F.col("b_big"), F.lit(False)))
    near_pairs = pairs.join(head("a"), "a").join(head("b"), "b")
    block_pairs = own_pairs.select("a_block", "b_block", "a_size", "b_size").unionByName(near_pairs.select("a_block", "b_block", "a_size", "b_size"))
    block_pairs = stage.write(block_pairs.where("a_size = b_size").select("a_block", "b_block"), "block-pairs")
    side = lambda c: blocks.select(F.col("block").alias(f"{c}_block"), *[F.col(k).alias(f"{c}_{k}") for k in ("ids", "ns", "cells", "vs")])
    met = block_pairs.join(side("a"), "a_block").join(side("b"), "b_block")
    met = met.select(F.col("a_block") == F.col("b_block"), *[f"{c}_{k}" for c in "ab" for k in ("ids", "ns", "cells", "vs")])
    outside = met.mapInArrow(_count_links(threshold), "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("outside"))
    inside = dealt.select("vec_id", "n", (F.col("all") - 1).alias("inside"))
    counted = inside.join(outside, "vec_id", "left").select("vec_id", (F.col("inside") + F.coalesce("outside", F.lit(0))).alias("n_links"))
    counted = stage.write(counted.groupBy("vec_id").agg(F.max("n_links").alias("n_links")), "counted")

    edges = grouped.select(F.col("cell").alias("a"), F.col("vec_id").alias("b")).unionByName(pairs)
    edges = edges.unionByName(sizes.where("group != cell").select(F.col("group").alias("a"), F.col("cell").alias("b"))).where("a != b")
    name = lambda end: named.select(F.col("number").alias(end), F.col("first").alias(f"{end}_id"))
    edges = edges.join(name("a"), "a").join(name("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    final = components(edges.unionByName(copies.select(F.col("first").alias("a"), F.col("vec_id").alias("b"))), stage, "links")
    counted = counted.withColumnRenamed("vec_id", "number")
    holders = named.select(F.col("first").alias("vec_id"), "number").unionByName(copies.select("vec_id", "number"))
    own = holders.join(counted, "number").groupBy("vec_id").agg(F.max("n_links").alias("n_links"))
    out = rows.select("vec_id").join(own, "vec_id", "left").join(final, F.col("vec_id") == F.col("node"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept")
    )


def op10_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all embeddings: cosine of 0.9 or more."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
