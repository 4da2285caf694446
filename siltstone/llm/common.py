"""Shared Spark plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster for written intermediates.

    It is the session's ``spark.checkpoint.dir``.  Only a local session without
    that setting gets a temporary folder; on a cluster the setting is required,
    because executors do not see each other's disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


class Stage:
    """Written intermediates of one job, with names of their own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write a table to the shared folder and read it back: lineage ends there."""
        path = f"{self.root}/{name}"
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_bucketed(self, df: DataFrame, name: str, buckets: int, column: str) -> DataFrame:
        """Write a table in hash buckets of a column and read it back: joins by that column don't shuffle it again.

        The catalogue knows the table only until its files and buckets are resolved.
        """
        known = f"siltstone_{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd").option("path", f"{self.root}/{name}")
        writer.bucketBy(buckets, column).saveAsTable(known)
        found = self.spark.table(known)
        found.columns  # noqa: B018
        self.spark.sql(f"DROP TABLE {known}")
        return found

    def drop(self, *names: str) -> None:
        """Delete intermediates that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


@contextmanager
def joined_by_bucket(spark: SparkSession) -> Iterator[None]:
    """In it, a join by a bucketed column and further columns uses the buckets as they are."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text of a table; a null text is an empty one."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
