"""Where a plan is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the cluster's checkpoint folder, so that lost executors cost no second run.

    A local session without ``spark.checkpoint.dir`` gets a folder of its own; a cluster must name a shared one.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
            shared = tempfile.mkdtemp(prefix="siltstone-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        context.setCheckpointDir(shared)
    # Kept while it is written, or the rows would be computed once for the action and once for the files.
    kept = df.persist()
    out = kept.checkpoint()
    kept.unpersist()
    return out


def settled(df: DataFrame, *columns: Column | str) -> DataFrame:
    """The columns, computed once a row: conditions and joins on them don't compute them again further down."""
    chosen = df.select(*columns)
    return chosen.select(F.stack(F.lit(1), *map(F.col, chosen.columns)).alias(*chosen.columns)) if len(chosen.columns) > 1 else chosen.select(F.stack(F.lit(1), F.col(chosen.columns[0])).alias(chosen.columns[0]))


#: Rows and characters of texts that a task's Python holds as objects at once; a longer text comes alone.
SLICE_ROWS, SLICE_CHARS = 256, 1 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches in order, cut so that none has more than SLICE_ROWS rows or, but for one text, SLICE_CHARS bytes of a column."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for k, size in enumerate(sizes):
            if k > start and (k - start >= SLICE_ROWS or held + size > SLICE_CHARS):
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)
