"""Names of a dictionary in free text: whole words, longest term first, aliases, context rules.

A dictionary is a table (term, name, rule).  Several terms may stand for one name.
Rules: null or ``any`` counts everywhere, in any case; ``exact`` only as written;
``exact-word`` also not before a hyphen ("Go" but not "Go-live"); ``listed`` only where
the term names the thing: alone as an entry of a list, right beside a word of ``beside``,
or on a line with a name of ``companions``.

Words are runs of ASCII letters, digits and underscores; every other character is a
word of its own, so "C++" and "CI/CD" are terms like others.  A text is read once,
from word to word, by a tree over the terms' words; where several terms begin at a
word the longest counts, and the next term begins after it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import slices

WORDS = re.compile(r"[A-Za-z0-9_]+|[^A-Za-z0-9_]")
RULES = ("any", "exact", "exact-word", "listed")
#: Terms of one tree.  A larger dictionary is cut into several, whose finds are put together by text.
TREE_TERMS = 50_000
#: What ends an entry of a list; a colon closes a label, which is no entry.
ENTRY_END = re.compile(r'([,;:|/()\[\]"•·])')
#: Key of what ends at a node; no word is empty.
_END = ""


@dataclass
class Tree:
    """Terms by their lower-case words; at an end, the (name, rule, term) that end there."""

    beside: frozenset[str] = frozenset()
    companions: frozenset[str] = frozenset()
    root: dict = field(default_factory=dict)

    def add(self, term: str, name: str, rule: str | None) -> None:
        rule = rule or "any"
        if rule not in RULES:
            raise ValueError(f"unknown rule {rule!r} of {term!r}")
        node = self.root
        for word in WORDS.findall(term.lower()):
            node = node.setdefault(word, {})
        if node is not self.root:
            node.setdefault(_END, []).append((name, rule, term))

    def candidates(self, text: str) -> Iterator[tuple[int, int, str, str]]:
        """(begin, end, name, rule) at each word where a term begins: the longest whose case fits."""
        words = WORDS.findall(text)
        lower, at = [w.lower() for w in words], 0
        for k, word in enumerate(lower):
            node = self.root.get(word)
            if node is not None:
                best, n, end = None, 1, at + len(word)
                while node is not None:
                    for name, rule, term in node.get(_END, ()):
                        follows = text[end : end + 1]
                        if rule in ("any", "listed") or (text[at:end] == term and not (rule == "exact-word" and follows == "-")):
                            best = (at, end, name, rule)
                    if k + n >= len(lower):
                        break
                    node, end, n = node.get(lower[k + n]), end + len(words[k + n]), n + 1
                if best:
                    yield best
            at += len(words[k])

    def lists(self, line: str, term: str) -> bool:
        """Whether the term is an entry of its own on a line, give or take a bullet, emphasis and a full stop."""
        parts = ENTRY_END.split(line)
        entry = re.compile(r"(?:[-*+]\s+)?[*_]*" + re.escape(term) + r"[*_.]*", re.IGNORECASE)
        return any(entry.fullmatch(parts[i].strip()) and (parts[i + 1 : i + 2] or [""])[0] != ":" for i in range(0, len(parts), 2))

    def names_it(self, text: str, begin: int, end: int, name: str, found: list[tuple[int, int, str, str]]) -> bool:
        """The rule ``listed`` for one place."""
        start = text.rfind("\n", 0, begin) + 1
        stop = text.find("\n", end)
        stop = len(text) if stop < 0 else stop
        before = re.search(r"([A-Za-z0-9_]+)\s+\Z", text[start:begin])
        after = re.match(r"\s+(?:of\s+)?([A-Za-z0-9_]+)", text[end:stop])
        if any(m and m[1].lower() in self.beside for m in (before, after)):
            return True
        return any(x[2] in self.companions and start <= x[0] < stop for x in found) or self.lists(text[start:stop], text[begin:end])


def resolved(candidates: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Of overlapping finds the first, and of those that begin together the longest."""
    out, reached = [], 0
    for found in sorted(candidates, key=lambda x: (x[0], -x[1], x[2])):
        if found[0] >= reached:
            out.append(found)
            reached = found[1]
    return out


def _kept(tree: Tree, text: str, candidates: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str]]:
    found = resolved(candidates)
    return [x[:3] for x in found if x[3] != "listed" or tree.names_it(text, *x[:3], [y for y in found if y[3] != "listed"])]


def _finds(tree: Tree, settled: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: list[list] = [[], [], [], [], []]
            for k, text in enumerate(batch.column("text").to_pylist()):
                found = list(tree.candidates(text)) if text else []
                if settled:
                    found = [(*x, "") for x in _kept(tree, text, found)] if found else []
                for x in found:
                    for column, value in zip(rows, (k, *x)):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            at, *columns = (pa.array(c, kind) for c, kind in zip(rows, kinds))
            names = [f.name for f in batch.schema if f.name != "text" or not settled]
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(at) for n in names), *columns], names=[*names, "begin", "end", "name", "rule"])

    return run


_PLACES = [T.StructField(c, T.LongType()) for c in ("begin", "end")] + [T.StructField(c, T.StringType()) for c in ("name", "rule")]


def find_names(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str, beside: tuple[str, ...] = (), companions: tuple[str, ...] = ()) -> DataFrame:
    """(id, begin, end, name): the dictionary's names in every text, places in characters from 0.

    The dictionary is read by the driver in trees of TREE_TERMS terms.  With one tree a
    text is settled where it is read; with several, each finds its terms, and the
    finds of a text meet with it once.  Null texts have none; null terms and names don't count.
    """
    rows = terms.where("term IS NOT NULL AND name IS NOT NULL").select("term", "name", "rule").distinct().orderBy("term", "name", "rule")
    trees, tree = [], None
    for k, row in enumerate(rows.toLocalIterator()):
        if k % TREE_TERMS == 0:
            tree = Tree(frozenset(w.lower() for w in beside), frozenset(companions))
            trees.append(tree)
        tree.add(*row)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    place = T.StructType([base.schema["id"], *_PLACES])
    if len(trees) <= 1:
        return base.mapInArrow(_finds(trees[0] if trees else Tree(), True), place).drop("rule")
    whole = T.StructType([base.schema["id"], base.schema["text"], *_PLACES])
    finds = base.mapInArrow(_finds(trees[0], False), whole)
    for tree in trees[1:]:
        finds = finds.unionByName(base.mapInArrow(_finds(tree, False), whole))

    def settle(rows: pa.Table) -> pa.Table:
        text = rows["text"][0].as_py()
        found = [tuple(r[c] for c in ("begin", "end", "name", "rule")) for r in rows.select(["begin", "end", "name", "rule"]).to_pylist()]
        kept = _kept(trees[0], text, found)
        columns = [pa.array([x[i] for x in kept], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
        ids = rows["id"].combine_chunks().take(pa.array([0] * len(kept), pa.int64()))
        return pa.Table.from_arrays([ids, *columns, pa.array([""] * len(kept), pa.string())], names=["id", "begin", "end", "name", "rule"])

    return finds.groupBy("id", "text").applyInArrow(settle, place).drop("rule")


def names_by_text(finds: DataFrame) -> DataFrame:
    """(id, names): each text's distinct names, sorted."""
    return finds.groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("names"))


def gaps(wanted: DataFrame, known: DataFrame, group: str, limit: int = 8) -> DataFrame:
    """What is asked for and not known: the first `limit` names of each group by texts that ask.

    ``wanted`` is (group, id, name), ``known`` (name).  Rows: group, place, name, texts,
    and caveat: ``no-known-names`` where nothing is known, so nothing was taken off;
    ``thin-coverage`` where fewer than half of the group's texts ask for anything;
    both joined by a comma; empty otherwise.
    """
    have = known.where("name IS NOT NULL").select("name").distinct()
    asked = wanted.where("name IS NOT NULL").groupBy(group, "name").agg(F.countDistinct("id").alias("texts"))
    ids = wanted.groupBy(group).agg(F.countDistinct("id").alias("read"), F.countDistinct(F.when(F.col("name").isNotNull(), F.col("id"))).alias("asking"))
    some = have.limit(1).agg((F.count("*") == 0).alias("nothing"))
    order = Window.partitionBy(group).orderBy(F.desc("texts"), "name")
    first = asked.join(have, "name", "left_anti").withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    joined = first.join(ids.withColumnRenamed(group, "_group"), F.col(group).eqNullSafe(F.col("_group"))).crossJoin(F.broadcast(some))
    caveat = F.concat_ws(",", F.when(F.col("nothing"), "no-known-names"), F.when(F.col("asking") * 2 < F.col("read"), "thin-coverage"))
    return joined.select(group, "place", "name", "texts", caveat.alias("caveat"))
