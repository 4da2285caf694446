"""The corpus pipeline: five stages over documents, each written and read again.

toxicity -> line dedup -> near-dedup -> benchmark decontamination -> packing.
Every stage works on all rows that the one before kept.  All but the last return
the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import op1_line_alignment, op6_lsh_forest, op7_packing, op8_toxicity, op9_decontamination
from siltstone.llm.common import Stage, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under one half; the model learns from the labels of sf_dir."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = op8_toxicity.learn(docs, labels)
    toxic = op8_toxicity.score(docs, model).where("predicted = 1 AND doc_id IS NOT NULL")
    return docs.join(toxic.select("doc_id").distinct(), "doc_id", "left_anti").select(_columns(docs))


def _own_name(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have."""
    have = {c.lower() for c in docs.columns}
    while name in have:
        name = "_" + name
    return name


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without line blocks of earlier ones; those of which nothing is left go.

    Edited copies stay whole: the next stage judges them by their whole texts, and
    would not know them by the changed lines alone.
    """
    key, kept = _own_name(docs, "_text_sha256"), _own_name(docs, "_kept")
    found = op1_line_alignment.aligned_line_dedup(docs).where("n_removed > 0 AND NOT edited_copy AND doc_id IS NOT NULL")
    # Rows of one doc_id are told apart by their texts; equal ones are alike here.
    found = found.select("doc_id", F.col("text_sha256").alias(key), F.col("kept").alias(kept)).dropDuplicates(["doc_id", key])
    found = Stage(spark, "line-dedup").write(found, "changed")
    keyed = docs.withColumn(key, F.sha2(F.coalesce("text", F.lit("")), 256))
    joined = keyed.join(found.hint("shuffle_hash"), ["doc_id", key], "left").where(F.col(kept).isNull() | (F.col(kept) != ""))
    changed = {"text": F.coalesce(kept, "text"), "n_chars": F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length(kept))}
    return joined.withColumns(changed).select(_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near duplicates."""
    gone = op6_lsh_forest.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(_columns(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = op9_decontamination.find_items(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.where("doc_id IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_anti").select(_columns(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents with their places in sequences of 4096 tokens."""
    import public_tokenizers

    return op7_packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 1, 4096)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express the learned lexicon, the alignments or the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each one's rows written to the shared folder and read again."""
    stage = Stage(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, function) in enumerate(STAGES):
        docs = stage.write(function(spark, docs, sf_dir), f"{k}-{name.replace(' ', '-')}")
    return docs
