"""Substring dedup by prefix-partitioned suffix trees over words.

Suffixes are split by variable-length prefixes into groups that fit in memory: by
the first words at the window's sampled suffix, and by the whole window where one
such prefix has too many.  Each group's subtree is built top down: a node's children
are the runs of suffixes that agree in the next words; a node below which only one
document stands can hold no repeat and is not built further.  The internal nodes that
reach the window's depth are the repeats, and the smallest document below such
a node keeps them.

Cases: a null or empty text has no words; a document of fewer words than a
window stays whole; rows with a null doc_id stay whole and remove nothing; rows of one
doc_id don't remove each other; exact copies lose all (if a window long); an
empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import table, texts
from .kernels import rolling
from .repeats import Nodes, Rule, remove_repeats

#: Words by which an edge of the tree goes down.
EDGE_WORDS = 8


def deep_nodes(units: np.ndarray, starts: np.ndarray, docs: np.ndarray, depth: int) -> Nodes:
    """The suffixes below internal nodes of a depth, the node of each, and each node's least document.

    units are numbers of words, equal only for equal words; docs are the suffixes' documents.
    """
    leaves = np.arange(len(starts))
    node, least = np.zeros(len(starts), np.int64), np.zeros(1, np.int64)
    for at in range(0, depth, EDGE_WORDS):
        edge = min(EDGE_WORDS, depth - at)
        if not len(leaves):
            break
        words = [starts[leaves] + at + i for i in range(edge)]
        label = rolling(units.astype(np.uint64) + np.uint64(1), edge)[words[0]]
        order = np.lexsort((label, node))
        differs = np.logical_or.reduce([units[w[order[1:]]] != units[w[order[:-1]]] for w in words])
        same_label = (label[order[1:]] == label[order[:-1]]) & (node[order[1:]] == node[order[:-1]])
        if (differs & same_label).any():  # two edges of one hash: their words decide
            order = np.lexsort((*(units[w] for w in reversed(words)), node))
            differs = np.logical_or.reduce([units[w[order[1:]]] != units[w[order[:-1]]] for w in words])
        leaves, node = leaves[order], node[order]
        child = np.concatenate([[True], differs | (node[1:] != node[:-1])])
        begins, number = np.flatnonzero(child), np.cumsum(child) - 1
        least, most = np.minimum.reduceat(docs[leaves], begins), np.maximum.reduceat(docs[leaves], begins)
        inner = least < most
        leaves, node = leaves[inner[number]], (np.cumsum(inner) - 1)[number[inner[number]]]
        least = least[inner]
    return leaves, node, least


def remove_repeated_words(docs: DataFrame, window: int = 50, anchor: int = 8, keep_text: bool = False, **limits: int) -> DataFrame:
    """remove_repeats over words: see there for the columns."""
    return remove_repeats(docs, Rule(True, window, anchor, deep_nodes), "words", keep_text, **limits)


def op4_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 50-word windows that a smaller doc_id has."""
    found = remove_repeated_words(texts(table(spark, sf_dir, "documents")))
    return found.select("doc_id", found["n_units"].alias("n_words"), "n_removed", "kept_sha256", "n_spans")
