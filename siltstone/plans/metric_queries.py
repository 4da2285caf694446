"""Queries over the tracker, the ledger and the discard log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text, values
from ..operators import joins, ledger, metrics
from . import tables as t

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Register a query under its own name, with its SQL."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


_ALIASES = ", ".join(f"('{a}', '{s}')" for a, s in text.ALIAS_PAIRS)
CANON = f"""
alias(name, stage) AS (VALUES {_ALIASES}),
keyed AS (SELECT *, lower(trim(replace(coalesce(status, ''), '**', ''))) AS key FROM tracker),
canon AS (SELECT keyed.* EXCLUDE (key), CASE WHEN key IN ('', '—', '-') THEN 'DISCARDED' ELSE coalesce(stage, upper(key)) END AS stage
  FROM keyed LEFT JOIN alias ON alias.name = key)
"""
T = f"WITH {t.TRACKER_SQL}"
TC = f"WITH {t.TRACKER_SQL}, {CANON}"
_IN = {k: "(" + ", ".join(f"'{s}'" for s in v) + ")" for k, v in metrics.FUNNEL.items()}


def _funnel_sql() -> str:
    sums = ", ".join(f"count(*) FILTER (stage IN {s}) AS n{i}" for i, s in enumerate(_IN.values(), 1))
    rows = " UNION ALL ".join(
        f"SELECT {i} AS position, '{label}' AS label, n{i} AS count, CASE WHEN {base} > 0 THEN n{i} / {base} * 100 ELSE 0.0 END AS pct FROM totals"
        for i, (label, base) in enumerate((("Tracked", "n0"), ("Applied", "n0"), ("Responded", "n1"), ("Interview", "n1"), ("Offer", "n1")))
    )
    return f"{TC}, totals AS (SELECT count(*) AS n0, {sums} FROM canon) {rows}"


@query(_funnel_sql())
def funnel_cumulative(spark, sf_dir):
    return metrics.funnel(t.tracker(spark, sf_dir, roles=False))


@query(f"""{TC}, totals AS (SELECT {", ".join(f"count(*) FILTER (stage IN {s}) AS {k.lower()}" for k, s in _IN.items())} FROM canon)
SELECT applied, CASE WHEN applied > 0 THEN responded / applied * 100 END AS response_rate, CASE WHEN applied > 0 THEN interview / applied * 100 END AS interview_rate,
CASE WHEN applied > 0 THEN offer / applied * 100 END AS offer_rate, applied < 10 AS small_sample FROM totals""")
def funnel_rates(spark, sf_dir):
    return metrics.rates(t.tracker(spark, sf_dir, roles=False))


@query(f"""{TC} SELECT count(*) AS tracked, coalesce(round(avg(score) FILTER (score > 0), 6), 0.0) AS avg_score, coalesce(max(score) FILTER (score > 0), 0.0) AS top_score,
count(*) FILTER (stage IN {metrics.ACTIVE}) AS active, count(*) FILTER (stage IN ('OFFER', 'HIRED')) AS offers FROM canon""")
def progress_metrics(spark, sf_dir):
    return metrics.progress(t.tracker(spark, sf_dir, roles=False))


@query(f"""{T}, b(position, lo, hi, label) AS (VALUES {", ".join(f"({i}, {lo}, {hi}, '{label}')" for i, (lo, hi, label) in enumerate(metrics.SCORE_BUCKETS))}),
s AS (SELECT score FROM tracker WHERE score > 0)
SELECT position, label, count(score) AS count, CASE WHEN (SELECT count(*) FROM s) > 0 THEN count(score) / (SELECT count(*) FROM s) * 100 ELSE 0.0 END AS pct
FROM b LEFT JOIN s ON score >= lo AND score < hi GROUP BY position, label""")
def score_histogram(spark, sf_dir):
    return metrics.score_histogram(t.tracker(spark, sf_dir, roles=False))


@query(f"""{T} SELECT strftime(day, '%G-W%V') AS week, count(*) AS count FROM tracker GROUP BY 1 ORDER BY 1 DESC LIMIT 8""")
def weekly_activity(spark, sf_dir):
    return metrics.weekly_activity(t.tracker(spark, sf_dir, roles=False), "day")


def _breakdown(label: str, where: str = "true", limit: str = "", source: str = T) -> str:
    return f"""{source}, r AS (SELECT {label} AS label FROM {"canon" if source is TC else "tracker"} WHERE {where}), c AS (SELECT label, count(*) AS count FROM r WHERE label <> '' GROUP BY label)
SELECT label, count, count / (SELECT sum(count) FROM c) * 100 AS pct FROM c {limit}"""


def _rules(rules: list[tuple[str, str]], value: str, otherwise: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({value}, '{p}') THEN '{label}'" for p, label in rules)
    return f"CASE {cases} ELSE '{otherwise}' END"


_SENIORITY = [(rf"\b({words})\b", label) for label, words in text.SENIORITY.items()]


@query(_breakdown(_rules(_SENIORITY, "lower(role)", "Mid-Level")))
def stats_seniority(spark, sf_dir):
    return metrics.breakdown(t.tracker(spark, sf_dir), text.seniority(F.col("role")))


@query(_breakdown(_rules(text.ARCHETYPE_RULES, "lower(trim(role))", "Other / Cross-Functional")))
def stats_archetype(spark, sf_dir):
    return metrics.breakdown(t.tracker(spark, sf_dir), text.archetype(F.col("role")))


_PLACES = {"Wien, AT": "Vienna", "singapore": "Singapore", "new york, ny": "New York, NY", "münchen": "Munich", "Kuala Lumpur, Malaysia": "Kuala Lumpur", "Idaho Falls, ID": "Idaho Falls, ID", "paris": "Paris"}


@query(_breakdown(t._case(_PLACES, "place"), "place IS NOT NULL", "ORDER BY count DESC, label LIMIT 8"))
def stats_locations_top8(spark, sf_dir):
    return metrics.breakdown(t.tracker(spark, sf_dir, roles=False), text.location(F.col("place")), 8)


@query(_breakdown("CASE " + " ".join(f"WHEN score >= {lo} THEN '{label}'" for lo, label in metrics.QUALITY) + " END", "score > 0"))
def quality_tiers(spark, sf_dir):
    return metrics.quality_tiers(t.tracker(spark, sf_dir, roles=False))


@query(f"""{T}, p AS (SELECT * FROM tracker WHERE pay > 0) SELECT count(*) AS count, count(*) FILTER (upper(pay_source) = 'POSTED') AS posted,
count(*) FILTER (lower(pay_source) = 'est') AS estimated, round(avg(pay), 4) AS avg_pay, median(pay) AS median_pay, max(pay) AS max_pay FROM p""")
def pay_summary(spark, sf_dir):
    return metrics.pay_summary(t.tracker(spark, sf_dir, roles=False))


@query(_breakdown("CASE WHEN pay < 100000 THEN '< $100K' WHEN pay <= 140000 THEN '$100K - $140K' WHEN pay <= 180000 THEN '$140K - $180K' WHEN pay <= 220000 THEN '$180K - $220K' ELSE '$220K+' END", "pay > 0"))
def pay_bands(spark, sf_dir):
    rows = t.tracker(spark, sf_dir, roles=False).where("pay > 0")
    return metrics.breakdown(rows, metrics.pay_band(F.col("pay")))


@query(f"{TC} SELECT status, stage, count(*) AS count FROM canon GROUP BY status, stage")
def status_canonical(spark, sf_dir):
    rows = t.tracker(spark, sf_dir, roles=False)
    return rows.groupBy("status", text.canonical_status(F.col("status")).alias("stage")).agg(F.count("*").alias("count"))


@query(f"{TC} SELECT CASE WHEN stage IN ('EVALUATED', 'APPLIED', 'INTERVIEW', 'OFFER') THEN stage ELSE 'OTHER' END AS tab, count(*) AS count FROM canon GROUP BY 1")
def tab_counts(spark, sf_dir):
    return metrics.tab_counts(t.tracker(spark, sf_dir, roles=False), ("EVALUATED", "APPLIED", "INTERVIEW", "OFFER"))


# The ledger fold in SQL: a row survives unless a later '-' pops it; without corrections (the SQL query drops them) that is a matching of
# brackets, found by the depth of the stack after each row.
_NO_CORRECTIONS = f"""{t.LOG_SQL}, good AS (SELECT *, row_number() OVER (PARTITION BY num ORDER BY seq) AS pos FROM log WHERE source <> 'correction'),
walk AS (SELECT *, sum(CASE WHEN target = '-' THEN -1 ELSE 1 END) OVER (PARTITION BY num ORDER BY pos) AS raw FROM good),
depth AS (SELECT *, raw - least(0, min(raw) OVER (PARTITION BY num ORDER BY pos)) AS d FROM walk),
kept AS (SELECT *, min(d) OVER (PARTITION BY num ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM depth)"""


@query(f"WITH {_NO_CORRECTIONS} SELECT num, CAST(max(date) AS varchar) AS latest FROM kept WHERE target <> '-' AND coalesce(later, d) >= d GROUP BY num")
def ledger_latest(spark, sf_dir):
    found = ledger.latest(ledger.fold(t.status_log(spark, sf_dir).where("source != 'correction'")))
    return found.select("num", F.col("latest").cast("string").alias("latest"))


# The whole fold: entry after entry, with the surviving observations as a list.
_ENTRY = "{'date': g.date, 'origin': CASE WHEN upper(g.origin) = upper(void) THEN '-' ELSE g.origin END, 'target': g.target}"
_LAST = "(len(seen) - list_position(list_reverse(list_transform(seen, lambda x: x.target)), g.target) + 1)"
_FOLDED = f"""{t.LOG_SQL}, good AS (SELECT *, row_number() OVER (PARTITION BY num ORDER BY seq) AS pos FROM log),
walk(num, pos, seen, void) AS (
  SELECT DISTINCT num, CAST(0 AS bigint), CAST([] AS STRUCT(date DATE, origin VARCHAR, target VARCHAR)[]), CAST(NULL AS varchar) FROM good
  UNION ALL SELECT g.num, g.pos,
    CASE WHEN g.target = '-' THEN seen[1 : len(seen) - 1]
      WHEN g.source = 'correction' AND list_contains(list_transform(seen, lambda x: x.target), g.target)
      THEN list_concat(list_append(seen[1 : {_LAST} - 1], {_ENTRY}), seen[{_LAST} + 1 : len(seen)])
      ELSE list_append(seen, {_ENTRY}) END,
    CASE WHEN g.target = '-' THEN CASE WHEN len(seen) > 0 THEN seen[len(seen)].target ELSE void END END
  FROM walk w JOIN good g ON g.num = w.num AND g.pos = w.pos + 1),
ends AS (SELECT num, max_by(seen, pos) AS seen FROM walk GROUP BY num),
folded AS (SELECT num, position - 1 AS position, x.date AS date, x.origin AS origin, x.target AS target
  FROM (SELECT num, unnest(seen) AS x, unnest(range(1, len(seen) + 1)) AS position FROM ends))"""
_RANK = lambda c: f"coalesce(CASE upper({c}) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in text.STAGE_RANK.items()) + " END, 0)"
_RECOVERED = f"""{t.TRACKER_SQL}, {CANON}, {_FOLDED}, past AS (SELECT num, max(greatest({_RANK("origin")}, {_RANK("target")})) AS past FROM folded GROUP BY num),
recovered AS (SELECT n, max(greatest({_RANK("stage")}, coalesce(past, 0))) AS rank FROM canon LEFT JOIN past ON num = n WHERE stage <> 'SKIP' GROUP BY n)"""
_EPISODES = f"""{_FOLDED}, starts AS (SELECT num, position, date AS applied, lead(position) OVER (PARTITION BY num ORDER BY position) AS next FROM folded WHERE upper(target) = 'APPLIED'),
spans AS (SELECT o.outcome, s.num, s.position, applied, min(f.date) AS answered FROM (VALUES ('RESPONDED'), ('OFFER')) o(outcome) JOIN starts s ON true
  LEFT JOIN folded f ON f.num = s.num AND upper(f.target) = o.outcome AND f.position > s.position AND (next IS NULL OR f.position < next) GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_FOLDED} SELECT num, CAST(position AS int) AS position, CAST(date AS varchar) AS date, origin, target FROM folded")
def ledger_fold(spark, sf_dir):
    return ledger.fold(t.status_log(spark, sf_dir)).withColumn("date", F.col("date").cast("string"))


@query(f"WITH RECURSIVE {_RECOVERED} SELECT n, CAST(rank AS int) AS rank FROM recovered")
def stage_recovery(spark, sf_dir):
    return ledger.recovered_stages(t.tracker(spark, sf_dir, roles=False), ledger.fold(t.status_log(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_RECOVERED} SELECT count(*) FILTER (rank >= 1) AS applied, count(*) FILTER (rank >= 2) AS responded, count(*) FILTER (rank >= 4) AS interview,
count(*) FILTER (rank >= 5) AS offer FROM recovered""")
def stage_tiles(spark, sf_dir):
    return ledger.stage_tiles(ledger.recovered_stages(t.tracker(spark, sf_dir, roles=False), ledger.fold(t.status_log(spark, sf_dir))))


@query(f"""WITH RECURSIVE {_EPISODES} SELECT outcome, median(date_diff('day', applied, answered)) AS median_days, count(answered) AS n, count(*) - count(answered) AS censored
FROM spans GROUP BY outcome""")
def ledger_velocity(spark, sf_dir):
    folded = ledger.fold(t.status_log(spark, sf_dir))
    return ledger.velocity(folded, "RESPONDED").withColumn("outcome", F.lit("RESPONDED")).unionByName(ledger.velocity(folded, "OFFER").withColumn("outcome", F.lit("OFFER")))


_LEAVES = {"SKIP": "skip", "EVALUATED": "evaluated", "SPECULATIVE": "speculative", "APPLIED": "waiting", "RESPONDED": "screening", "ASSESSMENT": "assessment", "INTERVIEW": "interview", "OFFER": "offer", "HIRED": "hired"}
_SANKEY = f"""{TC}, {t.LOG_SQL},
seen AS (SELECT num, bool_or(target IN ('Interview', 'Offer')) AS interviewed, true AS submitted FROM log WHERE target <> '-' GROUP BY num),
leaves AS (SELECT CASE WHEN stage = 'REJECTED' THEN CASE WHEN coalesce(interviewed, false) THEN 'rejectedInterview' ELSE 'rejectedApply' END
  WHEN stage = 'DISCARDED' THEN CASE WHEN coalesce(interviewed, false) THEN 'discardedInterview' WHEN coalesce(submitted, false) THEN 'discarded' ELSE 'discardedEarly' END
  ELSE coalesce({t._case(_LEAVES, "stage")}, 'other') END AS node FROM canon LEFT JOIN seen ON num = n),
parents(node, parent) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in metrics.SANKEY_PARENT.items())}),
ups AS (SELECT node FROM leaves UNION ALL SELECT parent FROM leaves JOIN parents USING (node)
  UNION ALL SELECT q.parent FROM leaves l JOIN parents p USING (node) JOIN parents q ON q.node = p.parent
  UNION ALL SELECT r.parent FROM leaves l JOIN parents p USING (node) JOIN parents q ON q.node = p.parent JOIN parents r ON r.node = q.parent),
nodes AS (SELECT node, count(*) AS value FROM ups GROUP BY node)"""


def _seen(spark, sf_dir):
    return t.status_log(spark, sf_dir).where("target != '-'").select("num", text.canonical_status(F.col("target")).alias("stage"))


@query(f"{_SANKEY} SELECT * FROM nodes")
def sankey_nodes(spark, sf_dir):
    return metrics.sankey_nodes(t.tracker(spark, sf_dir, roles=False), _seen(spark, sf_dir))


@query(f"{_SANKEY} SELECT parent AS source, node AS target, value FROM nodes JOIN parents USING (node)")
def sankey_links(spark, sf_dir):
    return metrics.sankey_links(metrics.sankey_nodes(t.tracker(spark, sf_dir, roles=False), _seen(spark, sf_dir)))


@query(f"WITH {t.DISCARD_SQL} SELECT reason, count(*) AS count FROM discards GROUP BY reason")
def discard_by_reason(spark, sf_dir):
    return metrics.discards_by_reason(t.discards(spark, sf_dir))


@query(f"WITH {t.DISCARD_SQL} SELECT url, count(*) AS count, max_by(reason, {{'stamp': stamp, 'seq': seq}}) AS latest_reason FROM discards GROUP BY url")
def discard_by_url(spark, sf_dir):
    return metrics.discards_by_url(t.discards(spark, sf_dir))


_KEYWORDS = ("senior", "data", "ai", "mlops", "quantization", "manager")
_KEY_TEST = {k: f"regexp_matches(lower(role), '(^|[^a-z0-9_]){k}($|[^a-z0-9_])')" if len(k) < 4 else f"contains(lower(role), '{k}')" for k in _KEYWORDS}


@query(f"""{T}, hits AS (SELECT n, score, keyword, count(*) OVER (PARTITION BY n) AS k FROM (
  {" UNION ALL ".join(f"SELECT n, score, '{k}' AS keyword FROM tracker WHERE {test}" for k, test in _KEY_TEST.items())})),
names(keyword) AS (VALUES {", ".join(f"('{k}')" for k in _KEYWORDS)}),
c AS (SELECT keyword, count(n) AS hits, count(*) FILTER (k = 1) AS unique_hits, count(score) AS scored, round(avg(score), 6) AS avg_score FROM names LEFT JOIN hits USING (keyword) GROUP BY keyword)
SELECT *, CASE WHEN hits = 0 THEN 'dead' WHEN hits >= 5 AND avg_score < 2.5 THEN 'noisy' WHEN unique_hits = 0 THEN 'redundant' ELSE 'ok' END AS verdict FROM c""")
def filter_audit(spark, sf_dir):
    return metrics.filter_audit(t.tracker(spark, sf_dir), {k: text.keyword(F.col("role"), k) for k in _KEYWORDS}, F.col("score"))


@query(f"""{T}, r AS (SELECT CASE WHEN n % 7 = 0 THEN 'via ' || coalesce(pay_source, 'direct') ELSE company END AS company, CASE WHEN n % 4 = 0 THEN 'ghosted' END AS reason FROM tracker)
SELECT company, count(*) AS total, count(reason) AS tagged, round(count(reason) / count(*), 2) AS rate FROM r GROUP BY company""")
def process_friction(spark, sf_dir):
    rows = t.tracker(spark, sf_dir).select(F.when(F.col("n") % 7 != 0, F.col("company")).alias("company"), "pay_source", F.when(F.col("n") % 4 == 0, "ghosted").alias("reason"))
    return metrics.friction(rows, F.coalesce("pay_source", F.lit("direct")))


@query(f"""{TC} SELECT * FROM (SELECT n, score, CAST(day AS varchar) AS day, CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, day DESC NULLS LAST, n) AS int) AS position
FROM canon WHERE stage = 'EVALUATED') WHERE position <= 6""")
def awaiting_top6(spark, sf_dir):
    rows = t.tracker(spark, sf_dir).where(text.canonical_status(F.col("status")) == "EVALUATED")
    top = rows.orderBy(F.desc_nulls_last("score"), F.desc_nulls_last("day"), "n").limit(6)  # the report's six
    found = metrics.ranked(top.select("n", "score", "day"), F.desc_nulls_last("score"), F.desc_nulls_last("day"), F.asc("n"))
    return found.select("n", "score", F.col("day").cast("string").alias("day"), F.col("place").alias("position"))


@query(f"""{T} SELECT n, company, CAST(row_number() OVER (PARTITION BY company ORDER BY score DESC NULLS LAST, day DESC NULLS LAST, n) AS int) AS place FROM tracker""")
def inbox_order(spark, sf_dir):
    rows = t.tracker(spark, sf_dir, roles=False).select("n", "company", "score", "day")
    return metrics.ranked(rows, F.desc_nulls_last("score"), F.desc_nulls_last("day"), F.asc("n"), by=("company",)).select("n", "company", "place")


_TODAY = "date '2000-01-01'"


@query(f"""{TC}, last AS (SELECT num, max(date) AS moved FROM (SELECT user_id AS num, CAST(ts AS date) AS date FROM events) GROUP BY num)
SELECT n, date_diff('day', day, {_TODAY}) AS age, CASE WHEN date_diff('day', day, {_TODAY}) <= 60 THEN 'fresh' WHEN stage NOT IN {metrics.ACTIVE} THEN 'closed' WHEN moved > day THEN 'moved' ELSE 'stale' END AS verdict
FROM canon LEFT JOIN last ON num = n WHERE day <= {_TODAY}""")
def stale_rows(spark, sf_dir):
    today = F.expr(_TODAY)
    rows = t.tracker(spark, sf_dir).where(F.col("day") <= today)
    last = t.status_log(spark, sf_dir).groupBy("num").agg(F.max("date").alias("moved"))
    age = F.datediff(today, "day")
    verdict = (
        F.when(age <= 60, "fresh").when(~text.canonical_status(F.col("status")).isin(*metrics.ACTIVE), "closed").when(F.col("moved") > F.col("day"), "moved").otherwise("stale")
    )
    return rows.join(last, F.col("num") == F.col("n"), "left").select("n", age.cast("long").alias("age"), verdict.alias("verdict"))


@query(f"""{T}, e AS (SELECT n AS id, day AS evaluated FROM tracker), c AS (SELECT user_id AS id, max(CAST(ts AS date)) AS changed FROM events GROUP BY user_id)
SELECT id, CAST(evaluated AS varchar) AS evaluated, CAST(changed AS varchar) AS changed FROM e JOIN c USING (id) WHERE changed > evaluated""")
def reeval_candidates(spark, sf_dir):
    evaluated = t.tracker(spark, sf_dir, roles=False).select(F.col("n").alias("id"), F.col("day").alias("evaluated"))
    found = joins.reevaluation_candidates(evaluated, t.status_log(spark, sf_dir).select(F.col("num").alias("id"), F.col("date").alias("changed")))
    return found.select("id", F.col("evaluated").cast("string").alias("evaluated"), F.col("changed").cast("string").alias("changed"))


@query("""WITH i AS (SELECT DISTINCT CAST(ts AS date) AS day FROM events WHERE event_type = 'signup'), c AS (SELECT CAST(ts AS date) AS closes FROM events WHERE event_type = 'purchase')
SELECT CAST(day AS varchar) AS day, count(*) AS closings FROM i JOIN c ON closes = day OR closes = day - 1 GROUP BY day HAVING count(*) >= 2""")
def closing_clash(spark, sf_dir):
    log = t.status_log(spark, sf_dir)
    found = joins.closing_clash(log.where("target = 'Offer'").select(F.col("date").alias("closes")), log.where("target = 'Interview'").select(F.col("date").alias("day")))
    return found.select(F.col("day").cast("string").alias("day"), "closings")


@query(f"""{T}, seen AS (SELECT company, 'board-' || company AS board FROM tracker), tracked AS (SELECT company, 'board-' || company AS board FROM tracker WHERE status = '**Hired**')
SELECT company, count(*) AS sightings FROM seen WHERE company NOT IN (SELECT company FROM tracked) AND company NOT IN (SELECT company FROM seen WHERE board IN (SELECT board FROM tracked)) GROUP BY company""")
def discover_new(spark, sf_dir):
    rows = t.tracker(spark, sf_dir, roles=False).select("company", "status", F.concat(F.lit("board-"), "company").alias("board"))
    return joins.discover_new(rows.select("company", "board"), rows.where("status = '**Hired**'").select("company", "board"), F.col("board"))


@query("""WITH offers AS (SELECT event_id AS seq, 'u' || CAST(user_id AS varchar) || event_type AS url, 'c' || CAST(user_id % 40 AS varchar) AS company, value FROM events),
f AS (SELECT url, min(seq) AS first_seq FROM offers GROUP BY url)
SELECT CASE WHEN seq <> first_seq THEN 'seen' WHEN company = 'c7' THEN 'blacklisted' WHEN value < 5 THEN 'title' WHEN value > 60 THEN 'location' ELSE 'admitted' END AS reason, count(*) AS count
FROM offers JOIN f USING (url) GROUP BY 1""")
def admission_reasons(spark, sf_dir):
    offers = t.read(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("u"), F.col("user_id").cast("string"), "event_type").alias("url"), F.concat(F.lit("c"), (F.col("user_id") % 40).cast("string")).alias("company"), "value"
    )
    gated = joins.admission(offers, F.col("company") == "c7", F.col("value") >= 5, F.col("value") <= 60)
    return gated.groupBy("reason").agg(F.count("*").alias("count"))


@query("""WITH p AS (SELECT 'k' || CAST(user_id * 7 % 1009 AS varchar) AS key, min(event_id) AS seq FROM events WHERE event_type = 'view' GROUP BY 1),
q AS (SELECT DISTINCT 'k' || CAST(user_id * 7 % 1009 AS varchar) AS key FROM events WHERE event_type = 'error' AND value > 80)
SELECT key, seq, 500 + row_number() OVER (ORDER BY seq) AS id FROM p WHERE key NOT IN (SELECT key FROM q)""")
def batch_plan(spark, sf_dir):
    rows = t.read(spark, sf_dir, "events").withColumn("key", F.concat(F.lit("k"), (F.col("user_id") * 7 % 1009).cast("string")))
    pending = rows.where("event_type = 'view'").select("key", F.col("event_id").alias("seq"))
    return joins.plan_batch(pending, rows.where("event_type = 'error' AND value > 80"), 500)


@query("""WITH b AS (SELECT 'u' || CAST(user_id AS varchar) AS url, event_id AS id, event_type AS state FROM events)
SELECT url, max(id) AS id, max_by(state, id) AS state FROM b GROUP BY url""")
def pending_status(spark, sf_dir):
    rows = t.read(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.col("event_id").alias("id"), F.col("event_type").alias("state"))
    return joins.latest_per_key(rows, "url", F.col("id"))


@query("""SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 18000000000 PRECEDING AND CURRENT ROW), 4) AS five_hours,
round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 604800000000 PRECEDING AND CURRENT ROW), 4) AS seven_days FROM events""")
def usage_rolling(spark, sf_dir):
    rows = t.read(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    window = Window.partitionBy("user_id").orderBy("us")
    total = lambda hours: F.round(F.sum("value").over(window.rangeBetween(-hours * 3_600_000_000, 0)), 4)
    return rows.select("event_id", "user_id", total(5).alias("five_hours"), total(168).alias("seven_days"))


@query("""SELECT event_id, CASE WHEN age <= 1 THEN 1 WHEN age <= 3 THEN 3 WHEN age <= 7 THEN 7 WHEN age <= 14 THEN 14 WHEN age <= 30 THEN 30 END AS freshness
FROM (SELECT event_id, greatest(date_diff('day', CAST(ts AS date), date '2024-01-31'), 0) AS age FROM events)""")
def freshness_windows(spark, sf_dir):
    day = F.to_date("ts")
    return t.read(spark, sf_dir, "events").select("event_id", values.freshness(day, F.expr("date '2024-01-31'")).alias("freshness"))


@query(f"""{TC} SELECT stage, count(*) AS rows, count(*) FILTER (keep) AS kept FROM (SELECT stage, day IS NULL OR date_diff('day', day, date '1999-06-01') <= 90 OR stage IN ('APPLIED', 'INTERVIEW') AS keep FROM canon) GROUP BY stage""")
def retention_plan(spark, sf_dir):
    rows = t.tracker(spark, sf_dir, roles=False).select("day", text.canonical_status(F.col("status")).alias("status"))
    kept = joins.retention(rows, F.expr("date '1999-06-01'"), 90, ("APPLIED", "INTERVIEW"))
    return kept.groupBy(F.col("status").alias("stage")).agg(F.count("*").alias("rows"), metrics.count_if(F.col("keep")).alias("kept"))


@query("""SELECT p.p_partkey, p.p_retailprice * CASE p_size % 5 WHEN 0 THEN 2080 WHEN 1 THEN 52 WHEN 2 THEN 26 WHEN 3 THEN 12 ELSE 1 END AS annual FROM part p""")
def pay_annualized(spark, sf_dir):
    period = F.expr("CASE p_size % 5 WHEN 0 THEN 'hour' WHEN 1 THEN 'week' WHEN 2 THEN 'biweek' WHEN 3 THEN 'month' ELSE 'year' END")
    return t.read(spark, sf_dir, "part").select("p_partkey", values.annualized(F.col("p_retailprice"), period).alias("annual"))


@query(f"""{TC} SELECT stage, bucket, count(*) AS count FROM (SELECT stage, CASE WHEN score >= 4.5 THEN 'top' WHEN score >= 4 THEN 'good' WHEN score >= 3 THEN 'fair' ELSE 'low' END AS bucket FROM canon WHERE score IS NOT NULL) GROUP BY ALL""")
def fit_bands(spark, sf_dir):
    score = F.col("score")
    bucket = F.when(score >= 4.5, "top").when(score >= 4, "good").when(score >= 3, "fair").otherwise("low")
    rows = t.tracker(spark, sf_dir, roles=False).where(score.isNotNull())
    return rows.groupBy(text.canonical_status(F.col("status")).alias("stage"), bucket.alias("bucket")).agg(F.count("*").alias("count"))
