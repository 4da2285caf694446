"""Phrase collocations per language: exact counts of 1- to 3-word phrases and their scores.

1. Texts are lower-cased (A-Z), split into pieces, and equal pieces of a language become one
   with a multiplicity, so copies cost one piece.
2. Each task turns its pieces into windows, a word with the two words after it, adds up the
   weights of equal ones, and sends each distinct window once, in one compressed parcel for
   each bucket.  A window's bucket is the hash of its language and first two words.
3. Each bucket is counted in duckdb under a memory limit; what doesn't fit goes to a folder of
   the task, which goes with it.  Counts of LEAST and more are written; a phrase's parts are
   at least as frequent as the phrase, so all that is ever looked up is there.
4. Each cut of a candidate asks for its two parts: the requests are shuffled to the counts.
   Candidates inside a longer one that keeps half of their occurrences go; each language's
   first TOP remain.

Scores are exact: decimals of 38 digits, which hold 1000000 * a * a up to a = 10**15.

Edge cases: a null text is empty, a null language is ``und``; repeated rows count as often as
they are there; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import io
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage, partitions, table

#: Least occurrences of a candidate.
LEAST = 10
#: Rows of each language.
TOP = 2000
#: A longer candidate with this share (per cent) of the occurrences replaces a shorter one.
SHARE = 50
#: Words whose windows a task counts at once before it sends them.
WORDS_AT_ONCE = 600_000
#: Memory of duckdb in one task, in MB; more goes to the task's folder.
MEMORY_MB = 200
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

PARCEL = "bucket int, windows binary"
COUNT = "lang string, words int, phrase string, f long"
_PARCEL = pa.schema([("bucket", pa.int32()), ("windows", pa.binary())])
_COUNT = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, m): distinct pieces, their words joined by one space, and how often each is there."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _UPPER.lower())
    found = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(text, r"[.,;:!?\x0A-\x0D]")).alias("piece"))
    found = found.withColumn("piece", F.trim(F.regexp_replace("piece", r"[\x20\x09]+", " ")))
    return found.where("piece != ''").groupBy("lang", "piece").agg(F.count("*").alias("m"))


class _Duck:
    """A duckdb in this task, with a folder of its own for what exceeds its memory."""

    def __enter__(self):
        import duckdb

        self.folder = tempfile.TemporaryDirectory(prefix="counts-")
        config = {"memory_limit": f"{MEMORY_MB}MB", "threads": 1, "temp_directory": self.folder.name, "preserve_insertion_order": False}
        self.connection = duckdb.connect(config=config)
        return self.connection

    def __exit__(self, *_):
        self.connection.close()
        self.folder.cleanup()


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes in the order of the values, the distinct values, and a hash of each that all tasks agree on."""
    coded = pc.dictionary_encode(values)
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    distinct = coded.dictionary.take(pa.array(order))
    hashes = pd.util.hash_array(distinct.to_numpy(zero_copy_only=False), categorize=False)
    return rank[coded.indices.to_numpy(zero_copy_only=False)], distinct, hashes


def _bucket_of(lang: np.ndarray, first: np.ndarray, second: np.ndarray, buckets: int) -> np.ndarray:
    mixed = lang + first * np.uint64(0x9E3779B97F4A7C15) + (second ^ (second >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(buckets)).astype(np.int32)


def _parcels(bucket: np.ndarray, columns: dict[str, tuple[np.ndarray, pa.Array] | np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One compressed parcel for each bucket; rows are sorted by bucket."""
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for start, stop in zip(cuts[:-1], cuts[1:]):
        arrays = {}
        for name, column in columns.items():
            if isinstance(column, tuple):
                codes, values = column[0][start:stop], column[1]
                arrays[name] = values.take(pa.array(codes, mask=codes < 0))
            else:
                arrays[name] = pa.array(column[start:stop], pa.int64())
        sink = io.BytesIO()
        table_ = pa.table(arrays)
        with pa.ipc.new_stream(sink, table_.schema, options=options) as writer:
            writer.write_table(table_)
        yield pa.RecordBatch.from_arrays([pa.array([bucket[start]], pa.int32()), pa.array([sink.getvalue()], pa.binary())], schema=_PARCEL)


def _counted(rows: list[pa.RecordBatch], duck, buckets: int) -> Iterator[pa.RecordBatch]:
    """Distinct windows of some pieces with the sums of their weights, in parcels by bucket."""
    found = pa.Table.from_batches(rows).combine_chunks()
    words = pc.split_pattern(found["piece"], " ").combine_chunks()
    if isinstance(words, pa.ChunkedArray):
        words = words.chunk(0)
    sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    word, vocabulary, hashes = _codes(words.flatten())
    lang, langs, lang_hashes = _codes(found["lang"])
    lang, weight = np.repeat(lang, sizes), np.repeat(found["m"].to_numpy(), sizes)
    left = (np.repeat(np.cumsum(sizes), sizes) - np.arange(len(word))).astype(np.int32)  # words up to the piece's end, this one included
    after = lambda k: np.where(left > k, np.concatenate([word[k:], np.zeros(min(k, len(word)), np.int32)]), np.int32(-1))
    second = after(1)
    pair = second >= 0
    l, a, b, c, m = lang[pair], word[pair], second[pair], after(2)[pair], weight[pair]
    windows = pa.table({"bucket": _bucket_of(lang_hashes[l], hashes[a], hashes[b], buckets), "l": l, "a": a, "b": b, "c": c, "m": m})
    duck.register("windows", windows)
    sums = duck.sql("SELECT bucket, l, a, b, c, CAST(sum(m) AS bigint) AS m FROM windows GROUP BY ALL ORDER BY bucket, l, a, b, c").fetchnumpy()
    duck.unregister("windows")
    del windows, left, second, pair, l, a, b, c, m
    yield from _parcels(sums["bucket"], {"lang": (sums["l"], langs), "a": (sums["a"], vocabulary), "b": (sums["b"], vocabulary), "c": (sums["c"], vocabulary), "m": sums["m"]})
    del sums
    key, place = np.unique(lang.astype(np.int64) * len(vocabulary) + word, return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, place, weight)
    l, a = np.divmod(key, len(vocabulary))
    bucket = _bucket_of(lang_hashes[l], hashes[a], np.zeros(len(a), np.uint64), buckets)
    order = np.argsort(bucket, kind="stable")
    none = (np.full(len(order), -1), vocabulary)
    yield from _parcels(bucket[order], {"lang": (l[order], langs), "a": (a[order], vocabulary), "b": none, "c": none, "m": total[order]})


def windows_of(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Parcels of the windows of a task's pieces, WORDS_AT_ONCE at a time."""
    with _Duck() as duck:
        held, words = [], 0
        for batch in batches:
            held.append(batch)
            words += pc.sum(pc.count_substring(batch.column("piece"), " ")).as_py() or 0
            words += batch.num_rows
            if words >= WORDS_AT_ONCE:
                yield from _counted(held, duck, buckets)
                held, words = [], 0
        if words:
            yield from _counted(held, duck, buckets)


def count_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of one bucket: phrases of LEAST and more occurrences, and words 0, the occurrences of all words."""
    with _Duck() as duck:
        duck.execute("CREATE TABLE windows (lang varchar, a varchar, b varchar, c varchar, m bigint)")
        for batch in batches:
            for parcel in batch.column("windows"):
                duck.register("parcel", pa.ipc.open_stream(parcel.as_buffer()).read_all())
                duck.execute("INSERT INTO windows SELECT lang, a, b, c, m FROM parcel")
                duck.unregister("parcel")

        def sums(words: int, phrase: str, by: str, where: str, least: int) -> str:
            return f"SELECT lang, CAST({words} AS int) AS words, {phrase} AS phrase, CAST(sum(m) AS bigint) AS f FROM windows WHERE {where} GROUP BY {by} HAVING sum(m) >= {least}"

        for sql in (
            sums(0, "''", "lang", "b IS NULL", 0),
            sums(1, "a", "lang, a", "b IS NULL", LEAST),
            sums(2, "a || ' ' || b", "lang, a, b", "b IS NOT NULL", LEAST),
            sums(3, "a || ' ' || b || ' ' || c", "lang, a, b, c", "c IS NOT NULL", LEAST),
        ):
            for batch in duck.sql(sql).to_arrow_reader(100_000):
                yield batch.cast(_COUNT)


def phrase_counts(docs: DataFrame) -> DataFrame:
    """(lang, words, phrase, f): all phrases of 1 to 3 words with f >= LEAST; rows of words 0 add up to a language's words."""
    buckets = partitions(docs.sparkSession)
    parcels = pieces(docs).mapInArrow(lambda batches: windows_of(batches, buckets), PARCEL)
    return parcels.repartitionById(buckets, F.col("bucket")).mapInArrow(count_bucket, COUNT)


def collocations(docs: DataFrame, stage: Stage | None = None) -> DataFrame:
    """The first TOP phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    stage = stage or Stage(docs.sparkSession, "collocations")
    counts = stage.write(phrase_counts(docs), "counts")
    word = F.split("phrase", " ")
    part = lambda start, n: F.array_join(F.slice(word, start, n), " ")
    candidates = counts.where("words > 1").withColumnRenamed("f", "a")
    asked = lambda k, side, text: F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), text.alias("part"))
    cut = lambda k, n: [asked(k, "l", part(1, k)), asked(k, "r", part(k + 1, n - k))]
    cuts = F.when(F.col("words") == 2, F.array(*cut(1, 2))).otherwise(F.array(*cut(1, 3), *cut(2, 3)))
    requests = candidates.select("lang", "phrase", "a", F.explode(cuts).alias("x")).select("lang", "phrase", "a", "x.*")
    answers = counts.where("words IN (1, 2)").select("lang", F.col("phrase").alias("part"), "f")
    met = requests.join(answers, ["lang", "part"])
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("f"))).alias(s)
    score = F.expr("CAST(1000000 AS decimal(7,0)) * CAST(a AS decimal(15,0)) * CAST(a AS decimal(15,0)) div (CAST(l AS decimal(18,0)) * CAST(r AS decimal(18,0)))")
    each = met.groupBy("lang", "phrase", "a", "k").agg(side("l"), side("r")).withColumn("score", score)
    lowest = each.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    longer = counts.where("words = 3").select("lang", F.explode(F.array(part(1, 2), part(2, 2))).alias("phrase"), F.col("f").alias("f"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(f"longest IS NULL OR 100 * longest < {SHARE} * a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    kept = kept.select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    total = counts.where("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's strongest phrases of two and three words, over all documents."""
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = f"""
WITH p AS (SELECT lang, row_number() OVER () AS id, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
words AS (SELECT lang, id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM p),
next AS (SELECT lang, a, lead(a) OVER (PARTITION BY id ORDER BY i) AS b, lead(a, 2) OVER (PARTITION BY id ORDER BY i) AS c FROM words),
grams AS (SELECT lang, 1 AS words, a AS phrase FROM next UNION ALL SELECT lang, 2, a || ' ' || b FROM next WHERE b IS NOT NULL UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c FROM next WHERE c IS NOT NULL),
f AS (SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE words = 1 GROUP BY lang),
cand AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND f >= {LEAST}),
cuts AS (SELECT *, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 : words], ' ') AS rest FROM cand, (VALUES (1), (2)) v(k) WHERE k < words),
scored AS (SELECT c.lang, c.words, c.phrase, c.a, k, x.f AS l, y.f AS r, CAST((CAST(1000000 AS hugeint) * c.a * c.a) // (CAST(x.f AS hugeint) * y.f) AS bigint) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = head JOIN f y ON y.lang = c.lang AND y.phrase = rest),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, phrase, max(a) AS longest FROM (SELECT lang, array_to_string(w[s : s + 1], ' ') AS phrase, a FROM cand, (VALUES (1), (2)) v(s) WHERE words = 3) GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN longer USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < {SHARE} * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS bigint) AS n, score FROM ranked JOIN n USING (lang) WHERE rank <= {TOP}
"""
