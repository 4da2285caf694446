"""SQL of the operators that it can express (run by DuckDB over the same tables)."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_REACH = """reach(a, b) AS (SELECT {id} AS a, {id} AS b FROM {nodes} UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
component AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)"""

OP4_SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
starts AS (SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY key) AS first FROM starts) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM hits, range(0, 50) r(k)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n, count(*) FILTER (new) AS spans FROM (SELECT doc_id, pos, coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <> pos - 1, true) AS new FROM gone) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS bigint) AS n_words, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP5_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
places AS (SELECT doc_id, unnest(list_transform(range(1, length(h) // 2 + 1), lambda i: substr(h, 2 * i - 1, 2))) AS byte, unnest(range(1, length(h) // 2 + 1)) AS pos FROM h),
starts AS (SELECT doc_id, unnest(list_transform(range(1, length(h) // 2 - 48), lambda i: md5_number(substr(h, 2 * i - 1, 100)))) AS key, unnest(range(1, length(h) // 2 - 48)) AS pos FROM h WHERE length(h) >= 100),
hits AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY key) AS first FROM starts) WHERE first < doc_id),
marked AS (SELECT p.doc_id, p.pos, p.byte,
  max(CASE WHEN x.pos IS NULL THEN -1000 ELSE p.pos END) OVER (PARTITION BY p.doc_id ORDER BY p.pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS gone FROM places p LEFT JOIN hits x ON x.doc_id = p.doc_id AND x.pos = p.pos),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM marked),
sums AS (SELECT doc_id, count(*) FILTER (gone) AS n, count(*) FILTER (opens) AS spans, string_agg(byte, '' ORDER BY pos) FILTER (NOT gone) AS kept FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS bigint) AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM h LEFT JOIN sums USING (doc_id)
"""

OP6_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, key FROM (
  SELECT doc_id, array_to_string(w[i : i + 4], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.key = b.key AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
{_REACH.format(id="doc_id", nodes="documents")},
classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sets) AS class_id FROM (SELECT doc_id, list(key ORDER BY key) AS sets FROM s GROUP BY doc_id))
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept, coalesce(class_id, d.doc_id) AS class_id
FROM documents d JOIN component ON a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN classes k ON k.doc_id = d.doc_id
"""

OP10_SQL = f"""
WITH RECURSIVE good AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS double)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM good p JOIN good q ON p.vec_id < q.vec_id AND len(p.v) = len(q.v) AND list_cosine_similarity(p.v, q.v) >= 0.9),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
{_REACH.format(id="vec_id", nodes="embeddings")},
n AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN component c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
