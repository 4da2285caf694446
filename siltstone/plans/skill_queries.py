"""Queries over names, phrases, terms and annotated sentences, on whole texts.

The dictionary of these queries has thousands of entries: the longer words of the benchmark,
each under the name of its first six letters, and its pairs of neighbouring words.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotations, dictionary, phrases
from . import tables as t

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def _dictionary(spark, sf_dir):
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+|[^a-z0-9_]"), F.lit(0))
    rows = t.read(spark, sf_dir, "benchmark").select(tokens.alias("w"))
    at = F.sequence(F.lit(0), F.size("w") - 1)
    word = lambda i: F.coalesce(F.get("w", i), F.lit(""))
    rows = rows.where(F.size("w") > 0).select(F.explode(F.transform(at, lambda i: F.struct(word(i).alias("a"), word(i + 1).alias("gap"), word(i + 2).alias("b")))).alias("x")).select("x.*")
    single = rows.where("a RLIKE '^[a-z0-9_]{5,}$'").select(F.col("a").alias("term"), F.substring("a", 1, 6).alias("name"))
    pairs = rows.where("a RLIKE '^[a-z0-9_]{2,}$' AND gap = ' ' AND b RLIKE '^[a-z0-9_]{2,}$'").select(F.concat_ws(" ", "a", "b").alias("term"))
    return single.unionByName(pairs.withColumn("name", F.col("term"))).distinct().withColumn("rule", F.lit(None).cast("string"))


_DICTIONARY = """bw AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_]+|[^a-z0-9_]') AS w FROM benchmark),
bt AS (SELECT w[i] AS a, coalesce(w[i + 1], '') AS gap, coalesce(w[i + 2], '') AS b FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM bw)),
dict AS (SELECT DISTINCT a AS term, substr(a, 1, 6) AS name, 1 AS n FROM bt WHERE regexp_full_match(a, '[a-z0-9_]{5,}')
  UNION SELECT DISTINCT a || ' ' || b, a || ' ' || b, 3 FROM bt WHERE gap = ' ' AND regexp_full_match(a, '[a-z0-9_]{2,}') AND regexp_full_match(b, '[a-z0-9_]{2,}'))"""


def _finds(prefix: str, table: str, key: str) -> str:
    """SQL of the names in a table's texts: at each word the longest term, and none that begins within the one before."""
    return f"""{prefix}w AS (SELECT {key} AS id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+|[^A-Za-z0-9_]')) AS w, generate_subscripts(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+|[^A-Za-z0-9_]'), 1) AS i FROM {table}),
{prefix}l AS (SELECT id, i, lower(w) AS a, lower(w || lead(w) OVER o || lead(w, 2) OVER o) AS b FROM {prefix}w WINDOW o AS (PARTITION BY id ORDER BY i)),
{prefix}c AS (SELECT id, i, coalesce(y.n, x.n) AS n, coalesce(y.name, x.name) AS name FROM {prefix}l LEFT JOIN dict x ON x.n = 1 AND x.term = a LEFT JOIN dict y ON y.n = 3 AND y.term = b WHERE x.n IS NOT NULL OR y.n IS NOT NULL),
{prefix}r AS (SELECT id, list_reduce(list({{'reached': i + n, 'names': [name]}} ORDER BY i), lambda acc, x: CASE WHEN x.reached - CASE WHEN contains(x.names[1], ' ') THEN 3 ELSE 1 END >= acc.reached
  THEN {{'reached': x.reached, 'names': acc.names || x.names}} ELSE acc END) AS r FROM {prefix}c GROUP BY id),
{prefix}found AS (SELECT DISTINCT id, unnest(r.names) AS name FROM {prefix}r)"""


def _named(spark, sf_dir, table, key):
    return dictionary.find_names(t.read(spark, sf_dir, table), _dictionary(spark, sf_dir), key, "text")


@query(f"WITH {_DICTIONARY}, {_finds('d', 'documents', 'doc_id')} SELECT id, string_agg(name, '|' ORDER BY name) AS names FROM dfound GROUP BY id")
def skills_by_document(spark, sf_dir):
    """The dictionary's names in every document."""
    return dictionary.names_by_text(_named(spark, sf_dir, "documents", "doc_id")).select("id", F.array_join("names", "|").alias("names"))


@query(f"""WITH {_DICTIONARY}, {_finds('d', 'documents', 'doc_id')}, {_finds('k', "(SELECT conv_id * 1000 + turn AS turn_id, text FROM conversations WHERE role = 'user')", 'turn_id')},
known AS (SELECT DISTINCT name FROM kfound), asked AS (SELECT source, doc_id, name FROM documents LEFT JOIN dfound ON id = doc_id),
sums AS (SELECT source, name, count(DISTINCT doc_id) AS texts FROM asked WHERE name IS NOT NULL AND name NOT IN (SELECT name FROM known) GROUP BY source, name),
sizes AS (SELECT source, count(DISTINCT doc_id) AS read, count(DISTINCT CASE WHEN name IS NOT NULL THEN doc_id END) AS asking FROM asked GROUP BY source)
SELECT source, row_number() OVER (PARTITION BY source ORDER BY texts DESC, name) AS place, name, texts,
concat_ws(',', CASE WHEN (SELECT count(*) FROM known) = 0 THEN 'no-known-names' END, CASE WHEN asking * 2 < read THEN 'thin-coverage' END) AS caveat FROM sums JOIN sizes USING (source) QUALIFY place <= 8""")
def skill_gaps(spark, sf_dir):
    """What each source's documents name most that users' turns don't."""
    users = t.read(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text")
    terms = _dictionary(spark, sf_dir)
    docs = t.read(spark, sf_dir, "documents")
    known = dictionary.find_names(users, terms, "turn_id", "text")
    found = dictionary.find_names(docs, terms, "doc_id", "text").select("id", "name").distinct()
    return dictionary.gaps(docs.select("source", F.col("doc_id").alias("id")).join(found, "id", "left"), known, "source")


_WORDS = "regexp_extract_all(lower({}), '" + phrases.WORD + "')"


@query(f"""WITH b AS (SELECT {_WORDS.format("text")} AS w FROM benchmark), p AS (SELECT DISTINCT w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS phrase FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM b WHERE len(w) >= 3)),
d AS (SELECT doc_id, unnest({_WORDS.format("text")}) AS w, generate_subscripts({_WORDS.format("text")}, 1) AS i FROM documents),
g AS (SELECT doc_id, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS phrase FROM d WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT phrase, count(DISTINCT doc_id) AS texts, count(*) AS places, min(doc_id) AS first_id FROM g WHERE phrase IN (SELECT phrase FROM p) GROUP BY phrase)
SELECT phrase, coalesce(texts, 0) AS texts, coalesce(places, 0) AS places, first_id FROM p LEFT JOIN s USING (phrase)""")
def phrase_coverage(spark, sf_dir):
    """In how many documents, and where first, each three words in a row of the benchmark stand."""
    w = phrases.words(F.col("text"))
    rows = t.read(spark, sf_dir, "benchmark").select(w.alias("w")).where(F.size("w") >= 3)
    start = F.sequence(F.lit(1), F.size("w") - 2)
    wanted = rows.select(F.explode(F.transform(start, lambda i: F.array_join(F.slice("w", i, 3), " "))).alias("phrase"))
    return phrases.phrase_coverage(t.read(spark, sf_dir, "documents"), wanted, "doc_id", "text")


_LIST = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_TERMS = f"""clean AS (SELECT doc_id, lower(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?s)<!--.*?(?:-->|\\z)', ' ', 'g'), 'https?://\\S+', ' ', 'g'), '[`*_>#|]', ' ', 'g')) AS t FROM documents),
parts AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(t, '[.!?]+(\\s|\\z)', chr(10), 'g'), '[\\n;:,()\\[\\]{{}}"]+')) AS part FROM clean),
numbered AS (SELECT doc_id, row_number() OVER () AS s, regexp_extract_all(part, '{phrases.WORD}') AS w FROM parts),
tok AS (SELECT doc_id, s, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM numbered),
ok AS (SELECT *, length(a) >= 2 AND NOT regexp_full_match(a, '[0-9.,-]+') AND a NOT IN {_LIST(phrases.STOP_WORDS)} AND a NOT IN {_LIST(phrases.BOILERPLATE)} AS good FROM tok),
pair AS (SELECT doc_id, a, good, lead(a) OVER o AS b, lead(good) OVER o AS good_b FROM ok WINDOW o AS (PARTITION BY s ORDER BY i)),
term AS (SELECT doc_id, a AS term, 'word' AS kind FROM pair WHERE good UNION SELECT doc_id, a || ' ' || b, 'phrase' FROM pair WHERE good AND good_b)"""


@query(f"WITH {_TERMS} SELECT term, kind, count(*) AS texts FROM term GROUP BY term, kind HAVING count(*) >= 10")
def frequent_terms(spark, sf_dir):
    """Words, and pairs of one sentence, of ten documents or more."""
    return phrases.terms(t.read(spark, sf_dir, "documents"), "doc_id", "text", 10)


@query(f"""WITH {_TERMS}, lab AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id), size AS (SELECT count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS b FROM documents JOIN lab USING (doc_id)),
entry AS (SELECT DISTINCT w[1] || ' ' || w[2] AS e FROM (SELECT {_WORDS.format("text")} AS w FROM benchmark) WHERE len(w) >= 2),
sums AS (SELECT term, any_value(kind) AS kind, count(*) FILTER (quality = 1) AS positive, count(*) FILTER (quality = 0) AS baseline FROM term JOIN lab USING (doc_id) GROUP BY term),
lifted AS (SELECT term, kind, positive, baseline, log2(((positive + 1) / (p + 2)) / ((baseline + 1) / (b + 2))) AS raw FROM sums, size WHERE positive >= 3 AND term NOT IN (SELECT e FROM entry))
SELECT term, kind, positive, baseline, round(raw, 2) AS lift FROM lifted WHERE raw > 0 ORDER BY lift DESC, positive DESC, term LIMIT 25""")
def telling_terms(spark, sf_dir):
    """The 25 terms that set good documents apart from others, without those that a list of phrases covers already."""
    labels = t.read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = t.read(spark, sf_dir, "documents").join(labels, "doc_id")
    w = phrases.words(F.col("text"))
    entries = t.read(spark, sf_dir, "benchmark").where(F.size(w) >= 2).select(F.array_join(F.slice(w, 1, 2), " ").alias("phrase"))
    return phrases.telling_terms(docs.where("quality = 1"), docs.where("quality = 0"), entries, "doc_id", "text")


#: What documents of these tables say, by detector; patterns that both engines read alike.
DETECTORS = {
    "of-the": annotations.Detector(r"(?i)\b(?:of|in)\s+the\b"),
    "that": annotations.Detector(r"(?i)\bthat\b"),
    "that-it": annotations.Detector(r"(?i)\bthat\b", (r"(?i)\bit\b",)),
    "with-as": annotations.Detector(r"(?i)\bwith\b", near=r"(?i)\bas\b"),
    "licence": annotations.Detector(r"(?i)\blicen[cs]ed?\s+under\b|\bGNU\b"),
    "secret": annotations.Detector(r"(?i)\b(?:password|token|api_key)\s*[=:]"),
}
POINTS = {
    "place": annotations.Point(("of-the",), many=2),
    "claim": annotations.Point(("that-it",), ("that", "with-as")),
    "terms": annotations.Point(("licence", "of-the"), ()),
    "secrets": annotations.Point(("secret",)),
}
_SENTENCES = """lines AS (SELECT doc_id AS id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS l FROM documents),
pieces AS (SELECT id, l, unnest(string_split(regexp_replace(line, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10))) AS piece, generate_subscripts(string_split(regexp_replace(line, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), 1) AS k FROM lines),
sent AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY l, k) - 1 AS sentence, trim(piece, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM pieces WHERE trim(piece, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '')"""


def _hits(name: str, d: annotations.Detector) -> str:
    near = f" AND regexp_matches(substr(text, length(before) + 1, length(found) + {d.reach}), '{d.near}')" if d.near else ""
    also = "".join(f" AND regexp_matches(text, '{p}')" for p in d.also)
    flags, body = d.focus[:4], d.focus[4:]
    inner = f"SELECT *, regexp_extract(text, '{d.focus}') AS found, regexp_extract(text, '(?is)^(.*?)(?:{body})', 1) AS before FROM sent WHERE regexp_matches(text, '{d.focus}'){also}"
    assert flags == "(?i)"
    return f"SELECT id, sentence, '{name}' AS detector, length(before) + 1 AS place, length(found) AS len, text FROM ({inner}) WHERE true{near}"


_ROOM = f"greatest(0, {annotations.EVIDENCE} - least(len, {annotations.EVIDENCE}))"
_ANNOTATED = f"""{_SENTENCES}, hits AS ({" UNION ALL ".join(_hits(n, d) for n, d in DETECTORS.items())}),
quoted AS (SELECT id, sentence, detector, CASE WHEN length(text) <= {annotations.EVIDENCE} THEN text
  ELSE substr(text, CAST(least(greatest(0, place - 1 - floor({_ROOM} / 2)), length(text) - {annotations.EVIDENCE}) + 1 AS bigint), {annotations.EVIDENCE}) END AS evidence FROM hits),
n AS (SELECT id, detector, count(*) AS n FROM quoted GROUP BY id, detector)"""


@query(f"WITH {_ANNOTATED} SELECT id, sentence, detector, evidence FROM quoted")
def sentence_annotations(spark, sf_dir):
    """Every sentence that a detector accepts, with its quote."""
    found = annotations.annotate(annotations.sentences(t.read(spark, sf_dir, "documents"), "doc_id", "text"), DETECTORS)
    return found.select("id", "sentence", "detector", "evidence")


def _status(name: str, p: annotations.Point) -> str:
    has = lambda d, k=1: f"coalesce(max(n) FILTER (detector = '{d}'), 0) >= {k}"
    strong = " AND ".join(has(d, p.many if k == 0 else 1) for k, d in enumerate(p.strong))
    any_ = " OR ".join(has(d) for d in (*p.strong, *p.weak))
    return f"SELECT doc_id AS id, '{name}' AS point, CASE WHEN {strong} THEN 'present' WHEN {any_} THEN 'partial' ELSE 'missing' END AS status FROM documents LEFT JOIN n ON n.id = doc_id GROUP BY doc_id"


_STATUS = f"{_ANNOTATED}, status AS ({' UNION ALL '.join(_status(n, p) for n, p in POINTS.items())})"


@query(f"WITH {_STATUS} SELECT id, point, status FROM status")
def document_points(spark, sf_dir):
    """Whether each point is present, partial or missing in every document."""
    docs = t.read(spark, sf_dir, "documents")
    found = annotations.annotate(annotations.sentences(docs, "doc_id", "text"), DETECTORS)
    return annotations.points(found, docs.select(F.col("doc_id").alias("id")), POINTS).select("id", "point", "status")


@query(f"""WITH {_STATUS} SELECT id, count(*) FILTER (status = 'present') AS present, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'missing') AS missing,
count(*) FILTER (status = 'missing') >= 3 AS ask FROM status GROUP BY id""")
def document_point_counts(spark, sf_dir):
    docs = t.read(spark, sf_dir, "documents")
    found = annotations.annotate(annotations.sentences(docs, "doc_id", "text"), DETECTORS)
    return annotations.point_counts(annotations.points(found, docs.select(F.col("doc_id").alias("id")), POINTS))
