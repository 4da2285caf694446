"""MinHash near-dedup by an LSH forest.

Each tree is an order of all documents, sorted by a rotation of their signatures: four
values, then the next four, and four more.  Neighbours in the order have long
common prefixes; a run of documents with one prefix is a region.  Regions begin at
the first depth, four values.  The documents of a small region are candidates of each other.
Where a region is crowded, each document is a candidate of the least id of its run
at every depth.  Crowded regions that the confirmed links leave in several components
make families, by the documents that they share; a family's documents outside its
largest component are compared with the whole family, in bounded units.  Where such documents are
too many, the family's documents go deeper: a forest of their own, of more trees, whose regions
begin at eight values and then at twelve, so that each depth finds a linked pair as surely as the
first, and crowds come apart.  At the last depth all families are compared.

An order is cut into partitions by ranges of the whole key, so a region in a third of all
documents is many tasks; pieces of a region that a cut has parted are put together after.

Links are confirmed on the full sets of shingle hashes.

Documents with equal sets are one class and only its least id is searched.

Cases: a null or empty text has no words, no shingles and no links; fewer words
than a shingle are one shingle; rows of one doc_id are one node of the graph,
each with its own set; rows with a null doc_id have no links, a null component and
are kept; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, joined_by_bucket, partitions, table, texts
from .components import components
from .kernels import arrow_bytes, binary_array, mix, range_hashes, ranges, rolling, word_bounds, word_hashes
from .tokens import slices

VALUES = 128
#: Values of one step of a prefix; trees of the forest whose regions begin at one, two and three steps.
STEP, TREES = 4, (32, 128, 512)
#: Documents from which a region is crowded, and documents outside a family's largest component from which it goes deeper.
CROWD, MANY = 8, 8192

#: Documents of a block, and of a chunk, of the second round.
UNIT = 512

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and where each text's begin (with the end)."""
    buf = _LOWER[buf]
    start, end, first = word_bounds(buf, offsets)
    hashes = word_hashes(buf, start, end)
    count = np.diff(first)
    long_, short = np.flatnonzero(count >= words), np.flatnonzero((count > 0) & (count < words))
    n = count[long_] - words + 1
    text = np.concatenate([np.repeat(long_, n), short])
    found = np.concatenate([rolling(hashes, words)[ranges(first[long_], n)], range_hashes(hashes, first[short], first[short + 1])])
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    found, text = found[new], text[new]
    return found, np.searchsorted(text, np.arange(len(count) + 1))


def signatures(found: np.ndarray, first: np.ndarray, values: int = VALUES) -> np.ndarray:
    """MinHash values of the non-empty sets, one row each."""
    rng = np.random.default_rng(611 + values)
    factor = (rng.integers(0, 1 << 31, values, dtype=np.int64) * 2 + 1).astype(np.uint32)
    shift = rng.integers(0, 1 << 32, values, dtype=np.int64).astype(np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    begins = first[:-1][np.diff(first) > 0]
    out = np.empty((len(begins), values), dtype=np.uint32)
    for i in range(values):
        out[:, i] = np.minimum.reduceat(short * factor[i] + shift[i], begins)
    return out


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = arrow_bytes(batch.column(1))
            for lo, hi in slices(np.diff(offsets), 1 << 20):
                part = offsets[lo : hi + 1]
                found, first = shingle_sets(buf[part[0] : part[-1]], part - part[0], words)
                size = np.diff(first)
                full = size > 0
                prints = np.zeros((2, hi - lo), np.uint64)
                sig = np.zeros((hi - lo, VALUES), np.uint32)
                if full.any():
                    begins = first[:-1][full]
                    prints[0, full] = np.add.reduceat(found, begins)
                    prints[1, full] = np.add.reduceat(mix(found ^ np.uint64(0x5851F42D4C957F2D)), begins)
                    sig[full] = signatures(found, first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[lo:hi], pa.array(size, pa.int64()), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)),
                        binary_array(sig.view(np.uint8).ravel(), np.arange(hi - lo + 1) * VALUES * 4), *(c[lo:hi] for c in batch.columns[2:]),
                    ],
                    names=["doc_id", "n_shingles", "print_a", "print_b", "signature", "part", "row"],
                )

    return run


_FOREST = "tree int, top long, rest long, doc_id long"


def _trees(ids: np.ndarray, sig: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each document and tree: the first step of its order, and the two steps after it as halves of one number."""
    trees = sig.shape[1] // STEP
    steps = np.zeros((len(ids), trees), np.uint64)
    for i in range(STEP):
        steps = mix(steps * np.uint64(0x9E3779B97F4A7C15) + sig[:, i::STEP].astype(np.uint64) + np.uint64(1))
    high, low = np.uint64(0xFFFFFFFF00000000), np.uint64(32)
    for tree in range(trees):
        rest = (steps[:, (tree + 1) % trees] & high) | (steps[:, (tree + 2) % trees] >> low)
        columns = [pa.array(np.full(len(ids), tree, np.int32)), pa.array(steps[:, tree].view(np.int64)), pa.array(rest.view(np.int64)), pa.array(ids)]
        yield pa.RecordBatch.from_arrays(columns, names=["tree", "top", "rest", "doc_id"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees of the written signatures."""
    for batch in batches:
        buf, _ = arrow_bytes(batch.column(1))
        yield from _trees(np.asarray(batch.column(0)), np.frombuffer(buf.tobytes(), np.uint32).reshape(len(batch), VALUES))


def _larger_forest(trees: int):
    """Trees of longer signatures, from the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = arrow_bytes(batch.column(1))
            for lo, hi in slices(np.diff(offsets), 1 << 20):
                part = offsets[lo : hi + 1]
                found = np.frombuffer(buf[part[0] : part[-1]].tobytes(), np.uint64)
                yield from _trees(np.asarray(batch.column(0))[lo:hi], signatures(found, (part - part[0]) // 8, trees * STEP))

    return run


#: kind 0: a candidate pair; 1: b is a document of the crowded region; 2: a piece of a region at an edge of a partition (n documents, a the least; ids if few).
_NEIGHBOURS = "kind int, region long, a long, b long, n long, ids array<bigint>"


def _neighbours(depth: int):
    """Of a stretch of the orders, the candidates in regions of `depth` steps or more."""

    def rows(kind: int, size: int, **columns) -> pa.RecordBatch:
        kinds = {"kind": pa.int32(), "region": pa.int64(), "a": pa.int64(), "b": pa.int64(), "n": pa.int64(), "ids": pa.list_(pa.int64())}
        given = {"kind": np.full(size, kind, np.int32)} | columns
        return pa.RecordBatch.from_arrays([pa.array(given.get(c, [None] * size), t) for c, t in kinds.items()], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [tuple(np.asarray(c) for c in batch.columns) for batch in batches if len(batch)]
        if not parts:
            return
        tree, top, rest, ids = (np.concatenate(x) for x in zip(*parts))
        prefixes = [top, top ^ (rest >> 32) * 0x2545F491, top ^ rest * 0x2545F491]
        new = [np.ones(len(ids), bool) for _ in prefixes]
        # Common steps with the row before, in this order.
        new[0][1:] = (tree[1:] != tree[:-1]) | (top[1:] != top[:-1])
        new[1][1:] = new[0][1:] | (rest[1:] >> 32 != rest[:-1] >> 32)
        new[2][1:] = new[0][1:] | (rest[1:] != rest[:-1])
        begins = np.flatnonzero(new[depth - 1])
        size = np.diff(np.append(begins, len(ids)))
        region = mix((prefixes[depth - 1][begins].view(np.uint64)) ^ mix(tree[begins].astype(np.uint64) + np.uint64(7))).view(np.int64)
        of = np.repeat(np.arange(len(begins)), size)
        least = np.minimum.reduceat(ids, begins)
        edge = np.zeros(len(begins), bool)
        edge[[0, -1]] = True

        pairs: list[np.ndarray] = []
        few = (size <= CROWD) & ~edge
        place = np.arange(len(ids)) - begins[of]
        for k in range(1, CROWD):
            i = np.flatnonzero(few[of] & (place + k < size[of]))
            pairs.append(np.stack([ids[i], ids[i + k]]))
        crowded = (size > CROWD)[of]
        for head in new[depth - 1 :]:
            first = np.flatnonzero(head)
            hub = np.minimum.reduceat(ids, first)[np.cumsum(head) - 1]
            pairs.append(np.stack([hub[crowded], ids[crowded]]))
        both = np.concatenate(pairs, axis=1)
        both = np.unique(np.sort(both[:, both[0] != both[1]], axis=0), axis=1)
        yield rows(0, both.shape[1], a=both[0], b=both[1])
        yield rows(1, int(crowded.sum()), region=region[of[crowded]], b=ids[crowded])
        e = np.flatnonzero(edge)
        listed = [ids[begins[i] : begins[i] + size[i]].tolist() if size[i] <= CROWD else None for i in e]
        yield rows(2, len(e), region=region[e], a=least[e], n=size[e], ids=listed)

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = arrow_bytes(batch.column(1))
            for lo, hi in slices(np.diff(offsets), 1 << 20):
                part = offsets[lo : hi + 1]
                found, first = shingle_sets(buf[part[0] : part[-1]], part - part[0], words)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], binary_array(found.view(np.uint8), first * 8)], names=["doc_id", "shingles"])

    return run


def _confirm(percent: int):
    """Pairs whose sets meet 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = (c.to_pylist() for c in batch.columns)
            keep = []
            for x, y in zip(left, right):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(both) - common))
            at = np.flatnonzero(keep)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in at], pa.int64()), pa.array([b[i] for i in at], pa.int64())], names=["a", "b"])

    return run


def _block_links(percent: int):
    """Links between the sets of a block and those of a chunk in other components, by one product of incidence matrices."""

    def run(unit: pa.Table) -> pa.Table:
        ids, component = np.asarray(unit["doc_id"]), np.asarray(unit["component"])
        left = np.asarray(unit["side"]) == 0
        sets = [np.frombuffer(s, np.uint64) for s in unit["shingles"].to_pylist()]
        size = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), size)
        tokens, column = np.unique(np.concatenate(sets), return_inverse=True)
        # Only tokens that both sides have can be common.
        here, there = np.zeros((2, len(tokens)), bool)
        here[column[left[owner]]] = True
        there[column[~left[owner]]] = True
        both = here & there
        number = np.cumsum(both) - 1
        keep = both[column]
        common = np.zeros((int(left.sum()), int((~left).sum())), np.float32)
        row = np.empty(len(sets), np.int64)
        row[left], row[~left] = np.arange(left.sum()), np.arange((~left).sum())
        for lo in range(0, int(both.sum()), 4096):
            x, y = np.zeros((common.shape[0], 4096), np.float32), np.zeros((common.shape[1], 4096), np.float32)
            at = np.flatnonzero(keep & (number[column] >= lo) & (number[column] < lo + 4096))
            for side, matrix in ((left, x), (~left, y)):
                mine = at[side[owner[at]]]
                matrix[row[owner[mine]], number[column[mine]] - lo] = 1
            common += x @ y.T
        union = size[left][:, None] + size[~left][None, :] - common
        i, j = np.nonzero((100 * common >= percent * union) & (component[left][:, None] != component[~left][None, :]))
        a, b = ids[left][i], ids[~left][j]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _across_components(crowds: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the components of each family (family, doc_id, component, n, most, main).

    A family's largest component is settled; every other document is compared
    with the whole family, in units of a bounded block and a bounded chunk, so a
    large family is many tasks and its pairs are never rows.
    """
    rows = crowds
    blocks, chunks = F.ceil(F.col("n") / UNIT).cast("int"), F.ceil((F.col("n") - F.col("most")) / UNIT).cast("int")
    spread = lambda n: F.sequence(F.lit(0), n - 1)
    own = F.xxhash64("doc_id")
    wide = rows.select("family", "doc_id", "component", F.lit(0).alias("side"), F.pmod(own, blocks).cast("int").alias("block"), F.explode(spread(chunks)).alias("chunk"))
    few = rows.where("component != main").select(
        "family", "doc_id", "component", F.lit(1).alias("side"), F.explode(spread(blocks)).alias("block"), F.pmod(own, chunks).cast("int").alias("chunk")
    )
    units = wide.unionByName(few.select(wide.columns)).join(sets, "doc_id")
    return units.groupBy("family", "block", "chunk").applyInArrow(_block_links(percent), "a long, b long").distinct()


def _candidates(forest: DataFrame, depth: int, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b), and the documents (region, doc_id) of crowded regions, of a forest."""
    order = ["tree", "top", "rest", "doc_id"]
    ordered = forest.repartitionByRange(partitions(forest.sparkSession), *order).sortWithinPartitions(*order)
    found = stage.write(ordered.mapInArrow(_neighbours(depth), _NEIGHBOURS), f"neighbours-{depth}")
    # Regions that a cut of the orders has parted, put together: a row for each partition at most.
    pieces = found.where("kind = 2").groupBy("region").agg(
        F.sum("n").alias("n"), F.min("a").alias("least"), F.collect_list("a").alias("firsts"), F.flatten(F.collect_list("ids")).alias("ids")
    )
    whole = pieces.where(F.col("n") <= CROWD).select(F.explode("ids").alias("a"), "ids").select("a", F.explode("ids").alias("b")).where("a < b")
    parted = pieces.where(F.col("n") > CROWD)
    star = parted.select(F.col("least").alias("a"), F.explode(F.array_union("firsts", "ids")).alias("b")).where("a < b")
    pairs = found.where("kind = 0").select("a", "b").unionByName(whole).unionByName(star).distinct()
    crowded = found.where("kind = 1").select("region", F.col("b").alias("doc_id")).unionByName(parted.select("region", F.explode("ids").alias("doc_id")))
    return pairs, crowded


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, class_id) for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    stage, n = Stage(spark, "forest"), min(partitions(spark), 100_000)
    # Texts are written where they are read, in buckets of their partition's number, and never shuffled.
    bodies = texts(docs).withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", 33).cast("int"))
    bodies = stage.write_bucketed(bodies, "bodies", n, "part")
    columns = "doc_id long, n_shingles long, print_a long, print_b long, signature binary, part int, row long"
    sketch = stage.write(bodies.select("doc_id", "text", "part", "row").mapInArrow(_sketches(words), columns), "sketch", "uncompressed")
    prints = ["n_shingles", "print_a", "print_b"]
    full = sketch.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = full.groupBy(*prints).agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    classes = stage.write(classes, "classes")
    copies = full.select("doc_id", *prints).join(classes, prints).where("doc_id != class_id")
    copies = stage.write(copies.select("doc_id", *prints, "class_id"), "copies")
    firsts = full.join(copies.select("doc_id", *prints).distinct(), ["doc_id", *prints], "left_anti")
    firsts = firsts.dropDuplicates(["doc_id", *prints])

    forest = firsts.select("doc_id", "signature").mapInArrow(_forest, _FOREST)
    links = copies.select(F.col("class_id").alias("a"), F.col("doc_id").alias("b"))
    sets = None

    def confirmed(pairs: DataFrame) -> DataFrame:
        right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right"))
        left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left"))
        both = pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right")
        return both.mapInArrow(_confirm(percent), "a long, b long")

    for depth, trees in enumerate(TREES, 1):
        if depth > 1:  # the documents of families that go deeper
            deeper = sets.join(crowds.select("doc_id").distinct(), "doc_id", "left_semi")
            forest = deeper.mapInArrow(_larger_forest(trees), _FOREST)
        pairs, crowded = _candidates(forest, depth, stage)
        pairs = stage.write(pairs, f"pairs-{depth}")
        if sets is None:
            # Sets of candidates only; a document that has several rows has several sets, all of which are compared.
            wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
            found = full.select("doc_id", "part", "row").join(wanted, "doc_id").select("part", "row")
            with joined_by_bucket(spark):
                texts_ = bodies.join(found.hint("shuffle_hash"), ["part", "row"], "left_semi").select("doc_id", "text")
                sets = stage.write(texts_.mapInArrow(_sets(words), "doc_id long, shingles binary"), "sets", "uncompressed")
            stage.drop("bodies")
        links = links.unionByName(stage.write(confirmed(pairs), f"links-{depth}"))
        final = components(links, stage, f"round-{depth}")
        known = crowded.distinct().join(final, F.col("doc_id") == F.col("node"), "left")
        known = stage.write(known.select("region", "doc_id", F.coalesce("component", "doc_id").alias("component")), f"crowded-{depth}")
        apart = known.groupBy("region").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.min("doc_id").alias("hub")).where("least < most")
        apart = stage.write(apart.select("region", "hub"), f"apart-{depth}")
        if apart.isEmpty():
            break
        joined = known.join(apart, "region").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
        families = components(joined, stage, f"families-{depth}").withColumnRenamed("component", "family")
        members = families.join(final, "node", "left").select("family", F.col("node").alias("doc_id"), F.coalesce("component", "node").alias("component"))
        sizes = members.groupBy("family", "component").agg(F.count("*").alias("n")).groupBy("family")
        sizes = sizes.agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("main")).where("n > most")
        crowds = stage.write(members.join(sizes, "family"), f"crowds-{depth}")
        deep = (F.col("n") - F.col("most") > MANY) & F.lit(depth < len(TREES))
        more = stage.write(_across_components(crowds.where(~deep), sets, percent), f"more-{depth}")
        if not more.isEmpty():
            links = links.unionByName(more)
            final = components(links, stage, f"joined-{depth}")
        crowds = crowds.where(deep)
        stage.drop(f"neighbours-{depth}", f"pairs-{depth}", f"crowded-{depth}", f"apart-{depth}")
        if crowds.isEmpty():
            break
    same = copies.groupBy("doc_id", *prints).agg(F.min("class_id").alias("class_id"))
    stage.drop("sets")
    out = sketch.drop("signature", "part", "row").join(final, sketch["doc_id"] == final["node"], "left")
    out = out.join(same, ["doc_id", *prints], "left")
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
    )


def op6_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: five-word shingles, similarity of 0.75 or more."""
    return near_duplicates(texts(table(spark, sf_dir, "documents")))
