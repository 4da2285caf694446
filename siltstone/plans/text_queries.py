"""Queries over documents, pages, labels and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import joins, mining, similarity
from ..operators.lineage import checkpointed
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


def _docs(spark, sf_dir):
    return t.read(spark, sf_dir, "documents")


# The normalised description, for an engine without look-around.
_NORM = """trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '<[^>]*>', ' ', 'g'), '&[a-z#0-9]+;', ' ', 'g'),
  'https?://\\S+', ' ', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' {2,}', ' ', 'g'))"""
_SIM = f"""norm AS (SELECT doc_id AS id, {_NORM} AS body FROM documents), words AS (SELECT id, string_split(body, ' ') AS w FROM norm WHERE length(body) >= 200),
sh AS (SELECT id, ('0x' || substr(sha1(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]), 1, 16))::ubigint AS h FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)),
bits AS (SELECT id, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN 1 ELSE -1 END) AS s FROM sh, range(0, 64) r(b) GROUP BY id, b),
prints AS (SELECT id, CAST(sum(CASE WHEN s > 0 THEN CASE WHEN b = 63 THEN -9223372036854775808::hugeint ELSE (1::hugeint << b) END ELSE 0 END) AS bigint) AS fingerprint FROM bits GROUP BY id)"""


@query(f"WITH {_SIM} SELECT id, fingerprint FROM prints")
def simhash64(spark, sf_dir):
    return similarity.simhash64(_docs(spark, sf_dir), "doc_id", "text")


@query(f"""WITH {_SIM} , d AS (SELECT id, fingerprint, source FROM prints JOIN documents ON doc_id = id)
SELECT a.id AS left_id, b.id AS right_id, CAST(bit_count(xor(a.fingerprint, b.fingerprint)) AS int) AS distance, 1 - bit_count(xor(a.fingerprint, b.fingerprint)) / 64 AS similarity
FROM d a JOIN d b ON a.id < b.id AND a.source IS DISTINCT FROM b.source AND bit_count(xor(a.fingerprint, b.fingerprint)) <= 5""")
def crosslist_pairs(spark, sf_dir):
    """Listings of different sources with nearly one text, over all documents."""
    docs = _docs(spark, sf_dir)
    prints = checkpointed(similarity.simhash64(docs, "doc_id", "text").join(docs.select(F.col("doc_id").alias("id"), "source"), "id"))
    return similarity.hamming_join(prints, prints, similarity.most_distance(0.92), ("source",)).where("left_id < right_id")


@query("""SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1""")
def exact_duplicate_groups(spark, sf_dir):
    groups = _docs(spark, sf_dir).groupBy("text").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    return groups.where("copies > 1").select(F.md5("text").alias("digest"), "copies", "first_id")


_STOP = "(" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + ")"
_TOKENS = f"""tok AS (SELECT doc_id, token FROM (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}+#./-]+')), '^[./-]+|[./-]+$', '', 'g') AS token FROM documents)
  WHERE token <> '' AND (length(token) > 1 OR regexp_matches(token, '[0-9]')) AND token NOT IN {_STOP} GROUP BY doc_id, token)"""


@query(f"WITH {_TOKENS} SELECT token AS term, count(*) AS df, count(*) / (SELECT count(*) FROM documents) AS share FROM tok GROUP BY token ORDER BY df DESC, term LIMIT 15")
def common_terms(spark, sf_dir):
    return mining.document_frequency(_docs(spark, sf_dir), "text", top=15)


@query(f"""WITH {_TOKENS}, lab AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id), n AS (SELECT count(*) FILTER (quality = 1) AS np, count(*) FILTER (quality = 0) AS nb FROM documents JOIN lab USING (doc_id)),
c AS (SELECT token AS term, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality = 0) AS base FROM tok JOIN lab USING (doc_id) GROUP BY token)
SELECT term, pos, base, round(log2(((pos + 1) / (np + 2)) / ((base + 1) / (nb + 2))), 6) AS lift FROM c, n WHERE pos >= 3""")
def term_lift(spark, sf_dir):
    labels = t.read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = _docs(spark, sf_dir).join(labels, "doc_id")
    return mining.term_lift(docs.where("quality = 1"), docs.where("quality = 0"), "text")


@query(f"""WITH {_TOKENS}, size AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id),
class AS (SELECT min(doc_id) AS id, count(*) AS copies FROM (SELECT doc_id, list(token ORDER BY token) AS tokens FROM tok GROUP BY doc_id) GROUP BY tokens),
own AS (SELECT doc_id, token FROM tok JOIN class ON id = doc_id),
met AS (SELECT a.doc_id AS l, b.doc_id AS r, count(*) AS c FROM own a JOIN own b ON a.token = b.token AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT l AS left_id, r AS right_id, c / (x.n + y.n - c) AS similarity, p.copies AS left_copies, q.copies AS right_copies FROM met JOIN size x ON x.doc_id = l JOIN size y ON y.doc_id = r
JOIN class p ON p.id = l JOIN class q ON q.id = r WHERE c / (x.n + y.n - c) >= 0.8""")
def jaccard_pairs(spark, sf_dir):
    """Classes of equal token sets over all documents, and the pairs of classes that are alike."""
    return similarity.jaccard_classes(_docs(spark, sf_dir), 0.8, "doc_id", "text")


@query("""SELECT doc_id, CAST(ceil(length(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) / 4) AS bigint) AS tokens FROM documents""")
def token_estimates(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


_URL = """u AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query FROM pages),
n AS (SELECT *, list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(lower(string_split(p, '=')[1]), '""" + urls.TRACKING + """'))) AS kept FROM u),
k AS (SELECT page_id, url, host, 'https://' || host || CASE WHEN path = '' THEN '/' WHEN length(path) > 1 THEN regexp_replace(path, '/$', '') ELSE path END ||
  CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END AS key FROM n)"""


@query(f"WITH {_URL} SELECT page_id, key FROM k")
def url_normalize(spark, sf_dir):
    return t.read(spark, sf_dir, "pages").select("page_id", urls.normalized_url(F.col("url")).alias("key"))


_APPS = {"job": "#/job/", "jobs": "#!/jobs/", "section": "#part-", "port": ""}


@query(f"""WITH {_URL}, parts AS (SELECT page_id, host, CASE WHEN path_ = '' THEN '/' WHEN length(path_) > 1 THEN regexp_replace(path_, '/$', '') ELSE path_ END AS path, kept FROM
  (SELECT n.page_id, n.host, n.path AS path_, n.kept FROM n)),
kinds AS (SELECT page_id, kind, 'https://' || host || CASE WHEN kind = 'port' THEN ':8443' ELSE '' END || path AS front,
  list_sort(CASE WHEN kind IN ('job', 'jobs') THEN kept || ['fragment_job_id=J ' || CAST(page_id AS varchar)] ELSE kept END) AS all_ FROM parts, (VALUES ('job'), ('jobs'), ('section'), ('port')) v(kind))
SELECT page_id, kind, front || CASE WHEN len(all_) = 0 THEN '' ELSE '?' || array_to_string(all_, '&') END AS key FROM kinds""")
def app_url_keys(spark, sf_dir):
    """Keys of pages within pages: a job's id in the fragment counts, other fragments don't, a port does."""
    pages = t.read(spark, sf_dir, "pages").where("url IS NOT NULL")
    plain = F.regexp_replace("url", "#.*$", "")
    ported = F.regexp_replace(plain, "^([A-Za-z]+://[^/?#]+)", "$1:8443")
    spelt = [F.when(F.col("kind") == k, F.concat(plain, F.lit(mark), F.lit("J%20"), F.col("page_id").cast("string"))) for k, mark in _APPS.items() if mark]
    rows = pages.select("page_id", "url", F.explode(F.array(*map(F.lit, _APPS))).alias("kind"))
    return rows.select("page_id", "kind", urls.normalized_url(F.coalesce(*spelt, ported)).alias("key"))


@query(f"WITH {_URL} SELECT key, min(page_id) AS page_id, min_by(url, page_id) AS url FROM k GROUP BY key")
def first_page_per_url(spark, sf_dir):
    rows = t.read(spark, sf_dir, "pages").select("page_id", "url", urls.normalized_url(F.col("url")).alias("key"))
    return joins.first_per_key(rows.select("key", "page_id", "url"), "key", F.col("page_id"))


@query(f"""WITH {_URL}, r AS (SELECT *, CASE page_id % 3 WHEN 0 THEN 'history' WHEN 1 THEN 'inbox' ELSE 'tracker' END AS source, 'c' || CAST(page_id % 23 AS varchar) AS company FROM k)
SELECT host, count(*) AS rows, count(DISTINCT key) AS postings, count(DISTINCT company) AS companies, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM r GROUP BY host""")
def same_host_postings(spark, sf_dir):
    source = F.expr("CASE page_id % 3 WHEN 0 THEN 'history' WHEN 1 THEN 'inbox' ELSE 'tracker' END")
    rows = t.read(spark, sf_dir, "pages").select(
        "url", urls.normalized_url(F.col("url")).alias("key"), F.concat(F.lit("c"), (F.col("page_id") % 23).cast("string")).alias("company"), source.alias("source")
    )
    return joins.same_host(rows, urls.host(F.col("url")))


@query("""SELECT page_id, 'listing_v1_' || sha256('["listing-fingerprint",1,"greenhouse","b' || CAST(page_id % 9 AS varchar) || '","' || CAST(page_id AS varchar) || '"]') AS listing_key FROM pages""")
def listing_keys(spark, sf_dir):
    board = F.concat(F.lit(" B"), (F.col("page_id") % 9).cast("string"))
    return t.read(spark, sf_dir, "pages").select("page_id", urls.listing_key(F.lit("Greenhouse"), board, F.col("page_id").cast("string")).alias("listing_key"))


_SUSPICIOUS = ["spam-farm.example.org", "cheap-pills.example.net", "cheap-pills.example.com"]
_MATCH = "contains(host, slug) OR (length(slug) >= 3 AND contains(host, slug))"


@query(f"""WITH {_URL}, c AS (SELECT *, CASE page_id % 4 WHEN 0 THEN '' ELSE 'Thth' END AS company FROM k),
f AS (SELECT *, CASE WHEN company = '' THEN 40 ELSE 0 END AS a, CASE WHEN {" OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in _SUSPICIOUS)} THEN 25 ELSE 0 END AS b,
  CASE WHEN company <> '' AND contains(host, 'thth') THEN 0 ELSE 15 END AS d FROM c)
SELECT page_id, CAST(100 - a - b - d AS int) AS score, CASE WHEN 100 - a - b - d >= 90 THEN 'high' WHEN 100 - a - b - d >= 60 THEN 'medium' ELSE 'low' END AS level,
concat_ws(',', CASE WHEN a > 0 THEN 'missing_fields' END, CASE WHEN b > 0 THEN 'suspicious_domain' END, CASE WHEN d > 0 THEN 'company_domain_mismatch' END) AS flags FROM f""")
def trust_score(spark, sf_dir):
    company = F.expr("CASE page_id % 4 WHEN 0 THEN '' ELSE 'Thth' END")
    found = urls.trust(F.lit("Role"), company, F.col("url"), _SUSPICIOUS)
    return t.read(spark, sf_dir, "pages").select("page_id", found.alias("t")).select("page_id", "t.score", "t.level", "t.flags")


@query("""SELECT conv_id, turn FROM conversations WHERE ((contains(lower(text), 'tion') AND contains(lower(text), 'then')) OR regexp_matches(lower(text), '(^|[^\\p{L}\\p{M}\\p{N}_])reat'))
AND NOT regexp_matches(lower(text), '(^|[^\\p{L}\\p{M}\\p{N}_])erst')""")
def title_filter(spark, sf_dir):
    rows = t.read(spark, sf_dir, "conversations")
    return rows.where(text.title_filter(F.col("text"), ["tion + then", "stem:reat"], ["stem:erst"])).select("conv_id", "turn")


@query("""SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{M}\\p{N}_])ed($|[^\\p{L}\\p{M}\\p{N}_])') AND contains(lower(text), 'tion')""")
def keyword_match(spark, sf_dir):
    return _docs(spark, sf_dir).where(text.keyword_group(F.col("text"), "ed + tion")).select("doc_id")


@query("""SELECT quality, toxic, count(*) AS n, round(avg(abs(quality - toxic)), 6) AS mean_difference, round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM labels GROUP BY quality, toxic""")
def golden_agreement(spark, sf_dir):
    rows = t.read(spark, sf_dir, "labels")
    same = F.when(F.col("quality") == F.col("toxic"), 1.0).otherwise(0.0)
    return rows.groupBy("quality", "toxic").agg(
        F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("quality") - F.col("toxic"))), 6).alias("mean_difference"), F.round(F.avg(same), 6).alias("agreement")
    )


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '^''*[=+\\-@]') THEN '''' || text ELSE text END AS cell FROM conversations""")
def formula_guard(spark, sf_dir):
    return t.read(spark, sf_dir, "conversations").select("conv_id", "turn", text.formula_escape(F.col("text")).alias("cell"))
