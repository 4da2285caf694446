"""Token-id output in blocks of a static range asymmetric numeral system.

One frequency table, counted over all documents, is shared by all blocks.  A
block holds whole documents in ascending doc_id order, is coded on its own by
interleaved lanes, and carries checkpoints (word position and lane states) from
which its segments decode in parallel, and checksums of payload and ids.

The file format is a folder: `table` (token, frequency of 2^20) and `blocks`,
one row per block, both as Parquet, so Spark's committers, retries and parallel
readers serve it.

Cases: a null or empty text is the end id alone; a null doc_id sorts first;
repeated ids and texts are separate documents; an empty table gives an empty
table of blocks; other columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, partitions, table, texts
from .tokens import encoder, slices

BITS, LOW = 20, np.uint64(1 << 31)
LANES, BLOCK_IDS, CHECK_STEPS = 2048, 1 << 20, 256
_PACK = "part int, seq int, before long, doc_ids array<bigint>, sizes array<int>, ids binary, tally binary"
_BLOCK = (
    "block long, start long, doc_ids array<bigint>, sizes array<int>, n_ids int, payload binary, payload_crc32 long, "
    "ids_crc32 long, check_words array<int>, check_states binary"
)


def normalise(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Frequencies of sum 2^BITS, each at least 1, near the counts."""
    total = 1 << BITS
    if len(tokens) > total:
        raise ValueError("more distinct ids than frequency slots")
    freq = np.maximum(1, np.floor(counts / counts.sum() * total).astype(np.int64))
    order = np.argsort(-freq, kind="stable")
    off = total - int(freq.sum())
    if off > 0:
        freq[order[0]] += off
    while off < 0:
        cut = np.minimum(freq[order] - 1, np.maximum(1, freq[order] * -off // total))
        cut = np.minimum(cut, np.maximum(0, -off - (np.cumsum(cut) - cut)))
        freq[order] -= cut
        off += int(cut.sum())
    return freq


class Table:
    """Lookup arrays of the shared frequencies, in token order."""

    def __init__(self, tokens: np.ndarray, freq: np.ndarray):
        self.freq = np.zeros(int(tokens.max(initial=0)) + 1, dtype=np.uint64)
        self.freq[tokens] = freq
        self.base = np.cumsum(self.freq) - self.freq
        self.token_at = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))


def encode_block(ids: np.ndarray, t: Table, lanes: int = LANES, every: int = CHECK_STEPS) -> tuple[bytes, list[int], bytes]:
    """Payload, word positions of the checkpoints, and their lane states."""
    bits, low32 = np.uint64(BITS), np.uint64(0xFFFFFFFF)
    steps = -(-len(ids) // lanes)
    freq, base = t.freq[ids], t.base[ids]
    state = np.full(lanes, LOW, dtype=np.uint64)
    words: list[np.ndarray] = [np.empty(0, np.uint32)] * steps
    saved: dict[int, np.ndarray] = {}
    for step in range(steps - 1, -1, -1):
        f, b = freq[step * lanes : (step + 1) * lanes], base[step * lanes : (step + 1) * lanes]
        x = state[: len(f)]
        out = x >= f << np.uint64(31 - BITS + 32)
        words[step] = (x[out] & low32).astype("<u4")
        x = np.where(out, x >> np.uint64(32), x)
        q = x // f
        state[: len(f)] = (q << bits) + (x - q * f) + b
        if step % every == 0:
            saved[step] = state.copy()
    ends = np.cumsum([0, *map(len, words)])
    marks = sorted(saved)
    return np.concatenate(words).astype("<u4").tobytes(), [int(ends[s]) for s in marks], b"".join(saved[s].tobytes() for s in marks)


def decode_segment(payload: np.ndarray, at: int, state: np.ndarray, n: int, t: Table) -> np.ndarray:
    """n ids from one checkpoint on."""
    bits, mask, lanes = np.uint64(BITS), np.uint64((1 << BITS) - 1), len(state)
    out = np.empty(n, dtype=np.uint32)
    state = state.copy()
    for lo in range(0, n, lanes):
        x = state[: min(lanes, n - lo)]
        slot = x & mask
        ids = t.token_at[slot]
        out[lo : lo + len(x)] = ids
        x = t.freq[ids] * (x >> bits) + slot - t.base[ids]
        need = x < LOW
        k = int(np.count_nonzero(need))
        x[need] = (x[need] << np.uint64(32)) | payload[at : at + k]
        at += k
        state[: len(x)] = x
    return out


def decode_block(payload: bytes, n: int, marks: list[int], states: bytes, t: Table, lanes: int = LANES, every: int = CHECK_STEPS) -> np.ndarray:
    """All ids of a block; the segments are independent of each other."""
    words = np.frombuffer(payload, "<u4").astype(np.uint64)
    starts = np.frombuffer(states, np.uint64).reshape(-1, lanes)
    span = lanes * every
    parts = [decode_segment(words, m, s, min(span, n - i * span), t) for i, (m, s) in enumerate(zip(marks, starts))]
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def _squeeze(ids: np.ndarray) -> bytes:
    """The width of the ids and the ids: the intermediate form between tokenizer and coder."""
    return bytes([ids.dtype.itemsize]) + ids.tobytes()


def _loosen(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1)


def _record(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))


_PACK_ARROW = {
    "part": pa.int32(), "seq": pa.int32(), "before": pa.int64(), "doc_ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "ids": pa.binary(), "tally": pa.binary(),
}


def tokenised_packs(docs: DataFrame, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Packs of whole documents, in doc_id order within each partition; the last has the partition's counts of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, "lead")
        end = np.array([end_id], encode.dtype).tobytes()
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        docs_, sizes, parts, n = [], [], [], 0
        tally = np.zeros(encode.model.get_vocab_size(), np.int64)

        def full(last: bool = False) -> pa.RecordBatch:
            nonlocal seq, before, docs_, sizes, parts, n, tally
            ids = np.frombuffer(b"".join(parts), encode.dtype)
            more = np.bincount(ids, minlength=len(tally))
            more[: len(tally)] += tally
            tally = more
            row = (part, seq, before, docs_, sizes, _squeeze(ids), tally.tobytes() if last else None)
            seq, before = seq + 1, before + n
            docs_, sizes, parts, n = [], [], [], 0
            return _record([row], _PACK_ARROW)

        for batch in batches:
            ids, text = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in slices(np.asarray(pa.compute.binary_length(text)).astype(np.int64), 4 << 20):
                for doc, found in zip(ids[lo:hi], encode(text[lo:hi].to_pylist())):
                    k = len(found) // encode.dtype.itemsize + 1
                    docs_.append(doc), sizes.append(k), parts.extend((found, end))
                    n += k
                    if n >= block_ids:
                        yield full()
        if docs_ or seq:
            yield full(last=True)

    return docs.mapInArrow(run, _PACK)


def _repacked(packs: DataFrame, spark: SparkSession) -> DataFrame:
    """Packs in global doc_id order, where the input's partitions overlap: documents are dealt by ranges of doc_id."""
    single = {"doc_id": pa.int64(), "size": pa.int32(), "ids": pa.binary()}

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, sizes, packed in zip(*(batch.column(n).to_pylist() for n in ("doc_ids", "sizes", "ids"))):
                if not docs:
                    continue
                ids = _loosen(packed)
                cuts = np.cumsum(sizes)[:-1]
                yield _record([(d, s, x.tobytes()) for d, s, x in zip(docs, sizes, np.split(ids, cuts))], single)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before, rows, n = TaskContext.get().partitionId(), 0, 0, [], 0

        def full() -> pa.RecordBatch:
            nonlocal seq, before, rows, n
            docs, sizes, ids = map(list, zip(*rows))
            width = len(ids[0]) // sizes[0]
            row = (part, seq, before, docs, sizes, _squeeze(np.frombuffer(b"".join(ids), f"<u{width}")), None)
            seq, before, rows, n = seq + 1, before + n, [], 0
            return _record([row], _PACK_ARROW)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append(row)
                n += row[1]
                if n >= BLOCK_IDS:
                    yield full()
        if rows:
            yield full()

    docs = packs.mapInArrow(apart, "doc_id long, size int, ids binary")
    parts = partitions(spark)
    only_ids = packs.select(F.explode("doc_ids").alias("doc_id"))
    bounds = sorted(set(only_ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.002)))
    known = F.array(*[F.lit(b) for b in bounds]).cast("array<double>")
    at = F.size(F.filter(known, lambda b: b < F.col("doc_id").cast("double")))
    docs = docs.withColumn("at", F.when(F.col("doc_id").isNull(), 0).otherwise(at))
    return docs.repartitionById(len(bounds) + 1, F.col("at")).sortWithinPartitions("doc_id").drop("at").mapInArrow(again, _PACK)


def write_rans(docs: DataFrame, tokenizer: str, end_id: int, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """Tokenise (doc_id, text), write table and blocks, and return both as read back."""
    spark = docs.sparkSession
    packs = stage.write(tokenised_packs(texts(docs).sortWithinPartitions("doc_id"), tokenizer, end_id), "packs", "uncompressed")

    counted = packs.where("tally IS NOT NULL").select("tally")

    def spans(df: DataFrame) -> list:
        """One row per partition: its range of ids and its size."""
        ends = df.groupBy("part").agg(
            F.min(F.array_min("doc_ids")).alias("first"),
            F.max(F.array_max("doc_ids")).alias("last"),
            F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, s: a + s)).alias("n"),
            F.max(F.exists("doc_ids", lambda d: d.isNull())).alias("nulls"),
        )
        return sorted(ends.collect(), key=lambda r: (not r["nulls"], r["first"] or 0, r["part"]))

    found = spans(packs)
    if any(b["nulls"] or (a["last"] or 0) > b["first"] for a, b in zip(found, found[1:])):
        packs = stage.write(_repacked(packs, spark), "repacked", "uncompressed")
        found = sorted(spans(packs), key=lambda r: r["part"])
    starts = np.cumsum([0, *(r["n"] for r in found)])
    rank = {r["part"]: (i, int(starts[i])) for i, r in enumerate(found)}

    def tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                more = np.frombuffer(packed.as_py(), np.int64).copy()
                more[: len(counts)] += counts
                counts = more
        token = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(counts[token])], names=["token", "n"])

    counts = counted.mapInArrow(tallies, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = sorted(counts.collect())  # as many as the vocabulary has entries, at most
    tokens = np.array([r[0] for r in rows], np.int64)
    freq = normalise(tokens, np.array([r[1] for r in rows], np.int64)) if rows else np.empty(0, np.int64)
    stage.write(spark.createDataFrame([*zip(tokens.tolist(), freq.tolist())], "token long, frequency long").coalesce(1), "table")
    kinds = {
        "block": pa.int64(), "start": pa.int64(), "doc_ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "n_ids": pa.int32(),
        "payload": pa.binary(), "payload_crc32": pa.int64(), "ids_crc32": pa.int64(), "check_words": pa.list_(pa.int32()), "check_states": pa.binary(),
    }

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = Table(tokens, freq)
        for batch in batches:
            for part, seq, before, docs_, sizes, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if not docs_:
                    continue
                ids = _loosen(packed)
                payload, marks, states = encode_block(ids, shared)
                at, start = rank[part]
                row = ((at << 32) | seq, start + before, docs_, sizes, len(ids), payload, zlib.crc32(payload), zlib.crc32(ids.astype("<u4")), marks, states)
                yield _record([row], kinds)

    stage.write(packs.drop("tally").mapInArrow(code, _BLOCK), "blocks", "uncompressed")
    return read_rans(spark, stage.root)


def read_rans(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The frequency table and the blocks of a written folder."""
    return spark.read.schema("token long, frequency long").parquet(f"{folder}/table"), spark.read.schema(_BLOCK).parquet(f"{folder}/blocks")


def decoded_documents(frequencies: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every document's place, size and checksum, from decoded blocks whose checksums hold."""
    rows = sorted(frequencies.collect())  # bounded by the vocabulary
    tokens, freq = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = Table(tokens, freq)
        for batch in batches:
            for block, start, docs_, sizes, n, payload, crc, ids_crc, marks, states in zip(*(c.to_pylist() for c in batch.columns)):
                if zlib.crc32(payload) != crc:
                    raise ValueError(f"block {block}: damaged payload")
                ids = decode_block(payload, n, marks, states, shared).astype("<u4")
                if zlib.crc32(ids) != ids_crc:
                    raise ValueError(f"block {block}: decoded ids differ")
                ends = np.cumsum(sizes)
                yield _record(
                    [(d, start + int(e) - s, s, zlib.crc32(ids[e - s : e])) for d, s, e in zip(docs_, sizes, ends)], kinds
                )

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokenise all documents, write them as rANS blocks and read every document back."""
    import public_tokenizers

    stage = Stage(spark, "rans")
    written = write_rans(texts(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.json"), 2, stage)
    return decoded_documents(*written)
