"""Collocations against plain counting with Python's integers."""

import collections
import re

import pytest

from siltstone.llm import op11_collocations as op11


def plain(docs, least, top):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    longest = collections.Counter()
    for (lang, words), a in f.items():
        if len(words) == 3 and a >= least:
            for part in (words[:2], words[1:]):
                longest[lang, part] = max(longest[lang, part], a)
    out = collections.defaultdict(list)
    for (lang, words), a in f.items():
        if len(words) > 1 and a >= least and 100 * longest[lang, words] < 50 * a:
            score, k = min((1000000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words)))
            out[lang].append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return {(lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)}


def rows(spark, docs):
    found = op11.collocations(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return {tuple(r) for r in found.collect()}


DOCS = [
    (k, text, lang)
    for k, (text, lang) in enumerate(
        [("New York city, new york CITY. New York", "en")] * 7
        + [("new  york\tis far; x x x x x x x", None), ("É É a\x0bb É É\x0cA b", "fr"), (None, "en"), ("", "de"), (" \t., ;", "en"), ("one word\r\nper line\x00 é", "en")] * 4
        + [(f"rare{k} new york pizza pie pizza pie", "en") for k in range(9)]
        + [("of the " * 3000 + "end", "en")]
    )
]


def test_plain_counts(spark):
    got = rows(spark, DOCS)
    assert got == plain(DOCS, 10, 2000)
    assert {r[2] for r in got} >= {"of the of", "pizza pie"}


def test_small_chunks_and_top(spark, monkeypatch):
    """Windows sent in chunks, and a cut at the first three of each language."""
    monkeypatch.setattr(op11, "TOP", 3)
    monkeypatch.setattr(op11, "WORDS_AT_ONCE", 5)
    assert rows(spark, DOCS) == plain(DOCS, 10, 3)


def test_out_of_core(monkeypatch):
    """A bucket far over duckdb's memory limit spills to the task's folder and still counts all."""
    import pyarrow as pa

    monkeypatch.setattr(op11, "MEMORY_MB", 40)
    n = 60_000
    pieces = [f"word-number-{k} and-another-long-word-{k} last" for k in range(n)]
    rows = pa.RecordBatch.from_arrays([pa.array(["en"] * n), pa.array(pieces), pa.array([3] * n, pa.int64())], names=["lang", "piece", "m"])
    parcels = list(op11.windows_of(iter([rows] * 5), 1))
    got = pa.Table.from_batches(op11.count_bucket(iter(parcels)))
    assert got.num_rows == 1 + 2 * n + 1 + 2 * n + n
    assert set(got["f"].to_pylist()) == {15, 15 * n, 45 * n}


def test_exact_beyond_64_bits(spark, monkeypatch):
    """Counts whose products pass 64 bits."""
    huge = [("en", 1, "a", 4 * 10**12), ("en", 1, "b", 3 * 10**12 + 1), ("en", 2, "a b", 2 * 10**12 + 1), ("en", 0, "", 9 * 10**12)]
    monkeypatch.setattr(op11, "phrase_counts", lambda docs: spark.createDataFrame(huge, op11.COUNT))
    (got,) = op11.collocations(spark.createDataFrame([], "text string, lang string")).collect()
    assert got.score == 1000000 * (2 * 10**12 + 1) ** 2 // (4 * 10**12 * (3 * 10**12 + 1))


@pytest.mark.parametrize("kind", ["odd", "none"])
def test_odd_tables(spark, request, kind):
    docs = request.getfixturevalue(kind)
    docs = docs.selectExpr("doc_id", "text", "text_key AS lang", "bucket AS m", "bucket AS head")
    assert op11.collocations(docs).collect() == []
