"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lowers case, composes compatibility forms, drops invisible characters,
joins letters that are split by signs or spaces, and maps look-alike letters and
digit substitutions inside words to Latin letters.  The lexicon (words, and
beginnings of words of 4 to 10 letters) and its weights are learned from labelled texts by
smoothed log odds.  So are the exception phrases: a hit with the word before or
after it, where that pair of words stands in clean texts and hardly in toxic ones; hits inside
them don't count.  Weights are summed, normalised by length, and calibrated.

Cases: a null or empty text has no hits and the score of a clean text; labels
other than 0 and 1, and null labels or ids, are not learned from; a document with both labels
counts as toxic; equal texts are learned from once; without labels of both
classes all scores are 0; other columns do not matter.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, table, texts

#: Labelled rows that learning may use; beyond it a share of them, by a hash of the id, is taken.
TRAIN_ROWS = 30_000
#: Share of toxic texts (and least number) that must have an entry, least log odds of an entry, shortest and longest word beginning.
SUPPORT, LEAST_SUPPORT, LEAST_ODDS, SHORTEST, LONGEST = 0.02, 3, 3.0, 4, 10
#: Least log odds of an exception.
LEAST_EXCUSE = 1.5
#: Candidate entries that a task counts before it passes its counts on.
HELD_ENTRIES = 150_000

# Letters that look like Latin ones (fixed values).
_LOOKALIKES = str.maketrans("авеёіїјкмнорсѕтухһԁԛԝαβεικνορτυχω", "abeeiijkmhopcstyxhdqwabeiknoptuxw")
# Digits and signs that stand for letters (fixed values).
_DIGITS = str.maketrans("0134578@$", "oieastbas")
_SCRIPTS = re.compile(r"[Ͱ-ԯ]")
_MIXED = re.compile(r"[^\W\d_][0-9@$]|[0-9@$][^\W\d_]")
_TOKEN = re.compile(r"[\w@$]*[0-9@$][\w@$]*")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_WORD = re.compile(r"[^\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")
# A word and one space before a hit; the rest of a hit word, and one space and the next word.
_BEFORE, _AFTER = re.compile(r"(?<![^\W\d_])[^\W\d_]{1,30} $"), re.compile(r"([^\W\d_]*)( [^\W\d_]+)?")
# Four single letters or more with one and the same sign or space between them.
_SPLIT = re.compile(r"(?<![^\W_])[^\W\d_]([ .*_-])[^\W\d_](?:\1[^\W\d_]){2,}(?![^\W_])")


def _unmask(match: re.Match) -> str:
    """Digits and signs of a token with letters, as the letters they stand for; signs at its end only end it."""
    token = match[0]
    core = token.rstrip("@$")
    return core.translate(_DIGITS) + " " * (len(token) - len(core)) if _LETTER.search(core) else token


def _lookalike(match: re.Match) -> str:
    """A word that mixes scripts, or has look-alikes only, in Latin letters."""
    word = match[0]
    latin = word.translate(_LOOKALIKES)
    return latin if latin.isascii() or any(c.isascii() for c in word) else word


def fold(text: str) -> str:
    text = _SPLIT.sub(lambda m: m[0].replace(m[1], ""), text.lower())
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        if _HIDDEN.search(text):
            text = _HIDDEN.sub("", text)
        if _SCRIPTS.search(text):
            text = re.sub(r"\w+", _lookalike, text)
    return _TOKEN.sub(_unmask, text) if _MIXED.search(text) else text


@dataclass(frozen=True)
class Model:
    """entries: (text, weight, whole word); coef: bias and factors of the features."""

    entries: tuple[tuple[str, float, bool], ...]
    exceptions: tuple[str, ...]
    coef: tuple[float, ...]

    def matcher(self):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for text, weight, whole in self.entries:
            automaton.add_word(text, (len(text), weight, whole))
        for phrase in self.exceptions:
            automaton.add_word(phrase, (len(phrase), None, True))  # an entry that is an exception is none
        if len(automaton):
            automaton.make_automaton()
        return automaton


def _hits(text: str, automaton) -> Iterator[tuple[int, int, float | None]]:
    """Begin, end and weight (None: an exception) of the entries in a folded text."""
    for end, (size, weight, whole) in automaton.iter(text):
        begin = end - size + 1
        if not (begin and text[begin - 1].isalpha() or whole and end + 1 < len(text) and text[end + 1].isalpha()):
            yield begin, end, weight


def features(text: str, automaton) -> tuple[float, float, float]:
    """Of a folded text: log of the weight of its hits, that weight by the root of its words, and log of its hits."""
    if not len(automaton) or not text:
        return 0.0, 0.0, 0.0
    hits, reach = [], -1
    found = list(_hits(text, automaton))
    # Exceptions in order of their beginnings; a hit is excused if one that begins no later ends no earlier.
    excused = iter(sorted((b, e) for b, e, weight in found if weight is None))
    ahead = next(excused, None)
    for begin, end, weight in sorted(h for h in found if h[2] is not None):
        while ahead and ahead[0] <= begin:
            reach, ahead = max(reach, ahead[1]), next(excused, None)
        if end > reach:
            hits.append(weight)
    total = sum(hits)
    return math.log1p(total), total / math.sqrt(text.count(" ") + 10), math.log1p(len(hits))


def _around(text: str, automaton) -> set[str]:
    """The words hit in a folded text, each with the word before it and with the word after it."""
    out = set()
    for begin, end, _ in _hits(text, automaton):
        before, after = _BEFORE.search(text, max(0, begin - 40), begin), _AFTER.match(text, end + 1)
        rest = after[1]
        out.update([before[0] + text[begin : end + 1] + rest] if before else [])
        out.update([text[begin : end + 1] + rest + after[2]] if after[2] else [])
    return out


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with and without the label that have each word and word beginning, as partial counts of bounded memory."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def full() -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[1].keys())
        out = pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([counts[1][n] for n in names], pa.int64()), pa.array([counts[0][n] for n in names], pa.int64())],
            names=["entry", "pos", "neg"],
        )
        for c in counts:
            c.clear()
        return out

    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = set()
            for word in set(_WORD.findall(fold(text))):
                found.add(word + " ")
                found.update(word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1))
            counts[label].update(found)
            if len(counts[0]) + len(counts[1]) > HELD_ENTRIES:
                yield full()
    if counts[0] or counts[1]:
        yield full()


def _lexicon(rows: list, pos: int, neg: int) -> list[tuple[str, float, bool]]:
    """The entries that tell most texts apart, none the beginning of another."""
    scored = []
    for r in rows:
        weight = math.log((r["pos"] + 0.5) / (pos + 1)) - math.log((r["neg"] + 0.5) / (neg + 1))
        if weight >= LEAST_ODDS:
            scored.append((r["pos"] * weight, len(r["entry"]), r["entry"], weight))
    # Of entries that tell about as many texts apart, the longest says most exactly what it means.
    scored.sort(key=lambda x: (-round(20 * math.log(x[0])), -x[1], x[2]))
    taken: list[tuple[str, float, bool]] = []
    parts: set[str] = set()
    whole: set[str] = set()
    for _, _, entry, weight in scored:
        text = entry.strip()
        if text in parts or any(text[:k] in whole for k in range(1, len(text) + 1)):
            continue
        whole.add(text)
        parts.update(text[:k] for k in range(1, len(text) + 1))
        taken.append((text, round(weight, 6), entry.endswith(" ")))
    return taken


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Newton's method, with a small penalty on the factors; the classes weigh alike."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[penalty] * (x.shape[1] - 1)]) * len(y) / 100
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (w * p * (1 - p))[:, None]) + ridge, x.T @ (w * (y - p)) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def held_out(doc_id: F.Column) -> F.Column:
    """Ids kept from learning: crc32 of the id as text is 0 modulo 5; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = (), rows: int = TRAIN_ROWS) -> Model:
    """Lexicon, exceptions and calibration from labels (doc_id, label 0 or 1) of docs (doc_id, text).

    `exceptions` are known beforehand.  An entry stands in a given share of the toxic
    texts, so their number is bounded by the entries of an average text.
    """
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).distinct()
    share = rows / max(1, labels.count())
    if share < 1:
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # The labels are about `rows` at most, so the texts stay where they are; the sample is written, as three passes read it.
    sample = texts(docs).join(F.broadcast(labels), "doc_id")
    sample = sample.groupBy(F.sha2("text", 256)).agg(F.max("label").alias("label"), F.first("text").alias("text")).select("label", "text")
    sample = Stage(docs.sparkSession, "toxicity").write(sample, "sample")
    sizes = dict(sample.groupBy("label").count().collect())
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return Model((), tuple(exceptions), (-math.inf, 0.0, 0.0, 0.0))
    support = max(LEAST_SUPPORT, SUPPORT * pos)
    counted = sample.mapInArrow(_candidates, "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # log odds of LEAST_ODDS bound neg by pos, so what is collected is bounded by the sample.
    entries = _lexicon(counted.where(F.col("pos") >= support).where("neg < pos").collect(), pos, neg)
    bare = Model(tuple(entries), (), (0.0, 0.0, 0.0, 0.0))

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = bare.matcher()
        for batch in batches:
            if not len(automaton):
                continue
            found = [(phrase, label) for label, text in zip(*(c.to_pylist() for c in batch.columns)) for phrase in _around(fold(text), automaton)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([x for _, x in found], pa.int32())], names=["phrase", "label"])

    harmless = sample.mapInArrow(phrases, "phrase string, label int").groupBy("phrase").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    odds = F.log((F.col("neg") + 0.5) / (F.col("pos") + 0.5))  # by documents as they are: most hits stand in toxic ones
    harmless = harmless.where((F.col("neg") >= LEAST_SUPPORT) & (odds >= LEAST_EXCUSE)).orderBy("phrase")
    learned = [r["phrase"] for r in harmless.collect()]  # bounded by the sample
    model = Model(bare.entries, tuple(sorted({*learned, *exceptions})), bare.coef)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.matcher()
        for batch in batches:
            found = [features(fold(t), automaton) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in zip(*found))], names=["label", "a", "b", "c"])

    data = np.array(sample.mapInArrow(measured, "label int, a double, b double, c double").collect(), dtype=float)
    return Model(model.entries, model.exceptions, tuple(_logistic(data[:, 1:], data[:, 0])))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_hits) of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.matcher()
        bias, *factors = model.coef
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = np.array([features(fold(t), automaton) for t in batch.column(1).to_pylist()]).reshape(-1, 3)
            p = 1 / (1 + np.exp(-np.clip(bias + found @ np.array(factors), -700, 700))) * np.isfinite(bias)
            out = [d is None or zlib.crc32(str(d).encode()) % 5 == 0 for d in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(np.rint(np.expm1(found[:, 2])).astype(np.int64))],
                names=["doc_id", "held_out", "score", "predicted", "n_hits"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_hits long")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from the labelled ones that are not held out."""
    docs = texts(table(spark, sf_dir, "documents"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return score(docs, learn(docs, labels))
