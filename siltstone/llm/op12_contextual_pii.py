"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

1. Seeds: emails, IP addresses, card and phone numbers of fixed shapes (*base* spans).
2. Candidates: strings that look like identifiers (LEAST_DIGITS digits or an at sign) and
   overlap no base span.
3. The lexical patterns of a place are its two words to the left, and its word on either
   side.  Occurrences make a graph of patterns and distinct values.  A pattern's
   confidence is the sum of its values' scores over all distinct strings that stand in its
   place anywhere in the corpus, plain words included; a value's score is the noisy-or of
   its confident patterns.  ROUNDS of scoring let discovered values support patterns that
   discover others.
4. Occurrences of values of LEAST_SCORE and more are spans beside the base ones, of the
   kind of their best pattern.

Counts are of distinct values, so copies of a document add nothing to a pattern.

The expressions are linear in a text's length: possessive, and anchored where a shorter
start gives the same match.  Positions come from the lengths of what lies between matches,
summed by a window over a text's matches, so no expression is quadratic in them.

Edge cases: a null or empty text has no spans and the digest of the empty string; a row of
any doc_id (null and repeated ones too) gives one row; no rows give none; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage, table, texts

#: Kinds in the order of their listing.
KINDS = ("email", "ip", "card", "phone")
_LOCAL, _DOMAIN, _LOOSE = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]", "[A-Za-z0-9._%+@#()/-]"
#: What matches from inside a run also matches from its start, so starts within runs are skipped.
MATCH = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "": rf"(?<!{_LOOSE})(?=[A-Za-z._%+#()/-]{{0,24}}[0-9@]){_LOOSE}++(?:[ ]\(?[0-9]{_LOOSE}*+)*+",
}
#: A candidate has so many digits at least, or an at sign.
LEAST_DIGITS = 5
#: Distinct scored values that a pattern needs, its least confidence, and the least score of a discovered value.
SUPPORT, CONFIDENCE, LEAST_SCORE = 3, 0.5, 0.75
ROUNDS = 3
#: Patterns up to this number are broadcast (at most 70 characters each); more are shuffled.
BROADCAST_PATTERNS = 100_000
#: Patterns are held against one in so many texts, then more, then all: what stands in a place in some texts is a lower bound.
SLICES = (256, 16, 1)
#: Characters beside a match in which its words are looked for, and the most of a word.
BESIDE, WORD = 120, 32


def _words(text: Column) -> Column:
    """Words of a context: lower case, digits as 0, split after signs that introduce a value."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "0"), r"([:=<>\"'(\[])", "$1 ")
    return F.filter(F.split(plain, r"\s+"), lambda w: w != "")


def _word(words: Column, at: int | Column) -> Column:
    return F.substring(F.coalesce(F.try_element_at(words, F.lit(at) if isinstance(at, int) else at), F.lit("^")), 1, WORD)


def _patterns(two: Column, one: Column, right: Column) -> Column:
    return F.array(F.concat_ws(" ", two, one), F.concat_ws(" ", one, F.lit("_"), right))


def _found(kind: str) -> tuple[Column, Column]:
    """Texts between the matches, and the matches."""
    return F.split("text", MATCH[kind], -1), F.regexp_extract_all("text", F.lit(MATCH[kind]), F.lit(0))


def _occurrences(docs: DataFrame) -> DataFrame:
    """A row for each match: rid, doc_id, kind ('' for candidates), i, gap (characters before it, from the last one), value, patterns.

    A text without matches has one row with a null kind.
    """
    rows = texts(docs).withColumn("rid", F.monotonically_increasing_id())
    lists = {k: f"found_{k or 'loose'}" for k in MATCH}
    some = {k: F.col("text").contains("@") if k == "email" else F.col("text").contains("+") if k == "phone" else F.col("text").rlike("[0-9@]") for k in MATCH}
    rows = rows.select("rid", "doc_id", *(F.when(some[k], F.struct(gaps.alias("gaps"), values.alias("values"))).alias(lists[k]) for k in MATCH for gaps, values in [_found(k)]))

    def entries(kind: str) -> Column:
        found = F.col(lists[kind])

        def entry(value: Column, i: Column) -> Column:
            gap = found["gaps"][i]
            left, right = _words(F.right(gap, F.lit(BESIDE))), _words(F.left(found["gaps"][i + 1], F.lit(BESIDE)))
            return F.struct(
                F.lit(kind).alias("kind"), i.alias("i"), F.length(gap).alias("gap"), value.alias("value"),
                _patterns(_word(left, -2), _word(left, -1), _word(right, 1)).alias("patterns"),
            )

        return F.coalesce(F.transform(found["values"], entry), F.array().cast("array<struct<kind:string,i:int,gap:int,value:string,patterns:array<string>>>"))

    every = F.concat(*map(entries, MATCH))
    return rows.select("rid", "doc_id", F.explode_outer(every).alias("x")).select("rid", "doc_id", "x.*")


def _luhn(digits: Column) -> Column:
    """Whether the digits, at most 19, pass Luhn's check."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    byte = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    loose = (n >= LEAST_DIGITS) | value.contains("@")
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", value.rlike(rf"\A{byte}(?:\.{byte}){{3}}\z"))
        .when(kind == "card", F.when(n.between(14, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(10, 15))
        .otherwise(loose)
    )


def placed(docs: DataFrame) -> DataFrame:
    """Base spans and candidates with their places: rid, doc_id, kind, start, stop, value, patterns; a null kind where a text has none.

    Candidates are without signs at their ends; those that overlap a base span are left out.
    """
    rows = _occurrences(docs)
    before = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("value").cast("long")
    rows = rows.withColumn("start", F.sum(F.col("gap").cast("long") + size).over(before) - size)
    bare = F.when(F.col("kind") == "", F.regexp_replace("value", r"(?<![._%+#()/-])[._%+#()/-]++\z", "")).otherwise(F.col("value"))
    rows = rows.withColumn("value", bare).withColumn("stop", F.col("start") + F.length("value"))
    rows = rows.withColumn("good", F.col("kind").isNull() | _valid(F.col("kind"), F.col("value")))
    base = F.col("good") & (F.col("kind") != "")
    # Both frames end at the row before, in either order; a frame that begins at a row and ends with the last is summed anew for each row.
    earlier = Window.partitionBy("rid").orderBy("start", F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("rid").orderBy(F.desc("start"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"reached": F.max(F.when(base, F.col("stop"))).over(earlier), "next": F.min(F.when(base, F.col("start"))).over(later)})
    free = (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("stop")) >= F.col("stop"))
    kept = F.when(F.col("good") & ((F.col("kind") != "") | free), F.col("kind"))
    # A row whose match fails stays with a null kind, so that its text keeps a row.
    return rows.select("rid", "doc_id", kept.alias("kind"), "start", "stop", "value", "patterns")


def _plain_places(docs: DataFrame, patterns: DataFrame, broadcast: bool) -> DataFrame:
    """(pattern, plain): how many distinct plain words stand in a pattern's place, over all texts."""
    start = F.array(F.lit("^"))
    rows = texts(docs).select(_words(F.col("text")).alias("word")).select("word", F.concat(start, "word").alias("one"), F.concat(start, start, "word").alias("two"), F.slice("word", 2, F.greatest(F.size("word"), F.lit(1))).alias("right"))
    rows = rows.select(F.inline(F.arrays_zip("two", "one", "word", "right"))).where("word IS NOT NULL AND NOT word RLIKE '[0-9@]'")
    cut = lambda c: F.substring(F.coalesce(c, F.lit("^")), 1, WORD).alias(c)
    rows = rows.select(*map(cut, ("two", "one", "word", "right")))
    wanted = patterns.select("pattern")
    rows = rows.select("word", F.explode(_patterns(F.col("two"), F.col("one"), F.col("right"))).alias("pattern"))
    met = rows.join(F.broadcast(wanted) if broadcast else wanted, "pattern")
    return met.distinct().groupBy("pattern").agg(F.count("*").alias("plain"))


def scored(docs: DataFrame, spans: DataFrame, stage: Stage) -> DataFrame:
    """(value, kind, score): discovered values, by rounds over the graph of patterns and values."""
    label = F.max(F.when(F.col("kind") != "", F.col("kind"))).alias("seed")
    edges = spans.where("kind IS NOT NULL").select("kind", "value", F.explode("patterns").alias("pattern"))
    edges = edges.groupBy("pattern", "value").agg(label)
    many = edges.groupBy("pattern").agg(F.count("*").alias("values")).where(F.col("values") >= SUPPORT)
    many = stage.write(many, "patterns")

    def possible(over: DataFrame, patterns: DataFrame) -> DataFrame:
        """Patterns that can become confident: those whose places hold too many plain words can't, whatever their values' scores are."""
        counted = patterns.select("pattern", "values").join(_plain_places(over, patterns, patterns.count() <= BROADCAST_PATTERNS), "pattern", "left")
        counted = counted.select("pattern", "values", F.coalesce("plain", F.lit(0)).alias("plain"))
        return counted.where(F.col("values") >= CONFIDENCE * (F.col("values") + F.col("plain")))

    # Most go by what some of the texts show already; the counts that remain are of all texts.
    patterns = many
    for k in SLICES:
        patterns = stage.write(possible(docs.where(F.pmod(F.xxhash64("text"), F.lit(k)) == 0), patterns), f"possible-{k}")
    edges = stage.write(edges.join(patterns, "pattern"), "edges")
    found = None
    for step in range(ROUNDS):
        if found is None:
            known = edges.where("seed IS NOT NULL").select("pattern", "values", "plain", F.col("seed").alias("kind"), F.lit(1.0).alias("score"))
        else:
            both = edges.join(found.withColumnRenamed("kind", "found_kind"), "value", "left")
            known = both.select("pattern", "values", "plain", F.coalesce("seed", "found_kind").alias("kind"), F.when(F.col("seed").isNotNull(), 1.0).otherwise(F.col("score")).alias("score")).where("kind IS NOT NULL")
        by_kind = known.groupBy("pattern", "values", "plain", "kind").agg(F.sum("score").alias("sum"), F.count("*").alias("n"))
        share = F.least(F.col("sum") / (F.col("values") + F.col("plain")), F.lit(0.99))
        sure = by_kind.where(F.col("n") >= SUPPORT).withColumn("confidence", share).where(F.col("confidence") >= CONFIDENCE)
        sure = sure.groupBy("pattern").agg(F.max(F.struct("confidence", "kind")).alias("best")).select("pattern", "best.*")
        hits = edges.where("seed IS NULL").select("pattern", "value").join(sure, "pattern")
        odds = hits.groupBy("value").agg(F.max(F.struct("confidence", "kind"))["kind"].alias("kind"), (1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        found = stage.write(odds.where(F.col("score") >= LEAST_SCORE), f"found-{step}")
    stage.drop("patterns", "edges", *(f"possible-{k}" for k in SLICES), *(f"found-{step}" for step in range(ROUNDS - 1)))
    return found


def personal_data(docs: DataFrame, stage: Stage | None = None) -> DataFrame:
    """Each row's spans: doc_id, n_email, n_ip, n_card, n_phone, base (list), spans (list), as text kind:start:end."""
    stage = stage or Stage(docs.sparkSession, "personal-data")
    spans = stage.write(placed(docs), "spans")
    found = scored(docs, spans, stage).select("value", F.col("kind").alias("found_kind"))
    rows = spans.join(found, "value", "left")
    is_base = F.coalesce(F.col("kind") != "", F.lit(False))
    kind = F.when(is_base, F.col("kind")).when(F.col("kind") == "", F.col("found_kind"))
    place = F.struct("start", F.array_position(F.array(*map(F.lit, KINDS)), kind).alias("at"), "stop", kind.alias("kind"))
    counts = [F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS]
    per = rows.groupBy("rid", "doc_id").agg(*counts, F.collect_list(F.when(is_base, place)).alias("base"), F.collect_list(F.when(kind.isNotNull(), place)).alias("spans"))
    listed = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    return per.select("doc_id", *(f"n_{k}" for k in KINDS), listed("base").alias("base"), listed("spans").alias("spans"))


def op12_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of personal data in every document."""
    found = personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
