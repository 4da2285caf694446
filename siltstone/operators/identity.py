"""Identity of companies, postings and contacts: relations, imports, reconciliation, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Corporate forms that are no part of a company's name (fixed values).
FORMS = ("inc", "llc", "ltd", "gmbh", "ag", "sa", "bv", "plc", "corp", "co", "kg", "srl", "oy", "ab")
# Words that name a unit of a company (fixed values).
UNITS = ("germany", "europe", "uk", "us", "usa", "labs", "lab", "research", "digital", "cloud", "health", "services", "solutions", "group", "technologies")


def company_tokens(name: Column, forms: tuple[str, ...] = FORMS) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(*forms))
    return words


def company_key(name: Column) -> Column:
    """A company's name without corporate form, case and punctuation."""
    return F.array_join(company_tokens(name), " ")


def company_relation(left: Column, right: Column) -> Column:
    """same; parent, where one name begins with the other's words and goes on with a unit's, or with two words or more shared; null."""
    a, b = company_tokens(left), company_tokens(right)
    short = F.when(F.size(a) <= F.size(b), a).otherwise(b)
    long_ = F.when(F.size(a) <= F.size(b), b).otherwise(a)
    n = F.size(short)
    prefix = (n > 0) & (F.slice(long_, 1, F.greatest(n, F.lit(1))) == short)
    next_ = F.coalesce(F.get(long_, n), F.lit(""))
    return F.when((n > 0) & (a == b), "same").when(prefix & ((n >= 2) | next_.isin(*UNITS)), "parent")


def company_relations(names: DataFrame) -> DataFrame:
    """All related pairs (left_name, right_name, relation) of names, left before right.

    A related name's words are a beginning of the other's, so each name is looked up
    under its whole sequence of words by all beginnings of the others: as many rows as
    names have words, however many begin alike.
    """
    rows = names.where("name IS NOT NULL").distinct().withColumn("words", company_tokens(F.col("name"))).where(F.size("words") > 0)
    begin = F.transform(F.sequence(F.lit(1), F.size("words")), lambda n: F.struct(F.array_join(F.slice("words", 1, n), " ").alias("key"), n.alias("n"), F.get("words", n).alias("next")))
    longer = rows.select(F.col("name").alias("long_name"), F.explode(begin).alias("x")).select("long_name", "x.*")
    longer = longer.where((F.col("n") >= 2) | F.col("next").isNull() | F.col("next").isin(*UNITS))
    whole = rows.select(F.col("name").alias("short_name"), F.array_join("words", " ").alias("key"))
    # Equal names find each other twice, and one name itself.
    met = whole.join(longer, "key").where("short_name < long_name OR (next IS NOT NULL AND short_name != long_name)")
    relation = F.when(F.col("next").isNull(), "same").otherwise("parent")
    return met.select(F.least("short_name", "long_name").alias("left_name"), F.greatest("short_name", "long_name").alias("right_name"), relation.alias("relation"))


def import_plan(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Each imported row (seq, url_key, company, role) as new, known or repeated.

    A row is known by its URL key; without one, or where the tracker's row has
    none, by company and role.  Of equal rows of one import the first counts.
    """
    identity = F.concat_ws("|", company_key(F.col("company")), F.lower(F.trim("role")))
    keyed = rows.withColumn("identity", identity).withColumn("own", F.when(F.coalesce("url_key", F.lit("")) != "", F.concat(F.lit("u:"), "url_key")).otherwise(F.concat(F.lit("i:"), "identity")))
    tracked = known.withColumn("identity", identity)
    urls = tracked.where(F.coalesce("url_key", F.lit("")) != "").select("url_key").distinct().withColumn("by_url", F.lit(True))
    # An identity match counts unless both sides have URLs (then they differ, or the URL would have matched).
    open_ = tracked.groupBy("identity").agg(F.max(F.coalesce("url_key", F.lit("")) == "").alias("bare"), F.lit(True).alias("named"))
    first = keyed.groupBy("own").agg(F.min("seq").alias("first"))
    joined = keyed.join(urls, "url_key", "left").join(open_, "identity", "left").join(first, "own")
    named = F.coalesce("named", F.lit(False)) & (F.coalesce("bare", F.lit(False)) | (F.coalesce("url_key", F.lit("")) == ""))
    verdict = F.when(F.coalesce("by_url", F.lit(False)) | named, "known").when(F.col("seq") != F.col("first"), "repeated").otherwise("new")
    return joined.select("seq", verdict.alias("verdict"))


def reconcile(pending: DataFrame, batch: DataFrame, processed: DataFrame) -> DataFrame:
    """Where each pending key belongs: already (processed), moved (a completed batch row with a report), no-report, dealbreaker, or keep."""
    latest = batch.groupBy("key").agg(F.max_by(F.struct("status", "report"), "id").alias("b"))
    done = processed.select("key").distinct().withColumn("done", F.lit(True))
    joined = pending.select("key").distinct().join(latest, "key", "left").join(done, "key", "left")
    bucket = (
        F.when(F.coalesce("done", F.lit(False)), "already").when(F.col("b.status") == "dealbreaker", "dealbreaker")
        .when((F.col("b.status") == "completed") & F.col("b.report").isNotNull(), "moved").when(F.col("b.status") == "completed", "no-report").otherwise("keep")
    )
    return joined.select("key", bucket.alias("bucket"))


def upserted_contacts(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Contacts by normalised (name, company): of each field the latest value that is not empty."""
    key = [F.lower(F.trim("name")).alias("name_key"), company_key(F.col("company")).alias("company_key")]
    last = [F.max_by(F.col(f), F.when(F.trim(F.coalesce(F.col(f), F.lit(""))) != "", F.col("seq"))).alias(f) for f in fields]
    return rows.groupBy(*key).agg(F.count("*").alias("rows"), *last)


def story_scores(stories: DataFrame, wanted: list[str]) -> DataFrame:
    """Stories (id, tags, title, body) by what they say of the wanted words: 3 a tag, else 2 in the title, else 1 in the body."""
    words = lambda c: F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^\p{L}\p{N}+#]+")
    tags = F.transform("tags", lambda x: F.lower(x))
    points = F.lit(0)
    for word in dict.fromkeys(w.lower() for w in wanted):
        points = points + F.when(F.array_contains(tags, word), 3).when(F.array_contains(words("title"), word), 2).when(F.array_contains(words("body"), word), 1).otherwise(0)
    return stories.select("id", points.alias("score"))
