"""Phrases in texts by a positional index, and the terms that set one group of texts apart.

A word is two or more of a-z, 0-9, + # . - that begins with a letter or digit and ends
with one or with + or #, or one letter or digit, after lower-casing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import checkpointed

WORD = "[a-z0-9][a-z0-9+#.-]*[a-z0-9+#]|[a-z0-9]"
#: Words never offered as terms (fixed values).
STOP_WORDS = (
    "a about above across after again against all also am an and any are as at be because been before being below between both but by can could did do does doing "
    "down during each either else etc few for from further had has have having he her here hers him his how however i if in into is it its itself just may me might "
    "more most must my no nor not now of off on once one only or other our ours out over own per same she should so some such than that the their theirs them then "
    "there these they this those through to too under until up upon us very via was we were what when where whether which while who whom why will with within without "
    "would you your yours able ability well new including include includes using use used get make like need needs want work working works role team teams join looking "
    "help helps ensure ensuring support supporting strong good great excellent plus preferred required requirements responsibilities qualifications experience years year "
    "days day time part full"
).split()
#: What every posting says (fixed values).
BOILERPLATE = (
    "equal opportunity employer employers benefits salary insurance dental vision vacation holiday holidays diversity inclusive inclusion applicants applicant applicable "
    "candidate candidates race color gender sex religion orientation disability disabilities veteran veterans accommodation accommodations compensation range apply "
    "application applications resume cover letter privacy policy position positions job jobs company companies opportunities location locations remote hybrid onsite "
    "office offer offers perks paid pto"
).split()
#: Distinct words up to which a word list is broadcast; longer ones are shuffled.
BROADCAST_WORDS = 200_000


def words(text: Column) -> Column:
    """The words of a text in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _bounded(df: DataFrame) -> DataFrame:
    """With a broadcast hint where its size is known to be bounded."""
    return F.broadcast(df) if df.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS else df


def _keys(found: Column) -> Column:
    """(seq, key) of a phrase: its pairs of neighbouring words, or its one word."""
    pairs = F.transform(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))), lambda w, i: F.struct(i.alias("seq"), F.concat_ws(" ", w, F.get(found, i + 1)).alias("key")))
    return F.when(F.size(found) == 1, F.array(F.struct(F.lit(0).alias("seq"), F.get(found, 0).alias("key")))).otherwise(pairs)


def positions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The positional index: (id, pos, key) for every word and every pair of neighbouring words, places from 0."""
    rows = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w")).withColumn("next", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))))
    rows = rows.select("id", F.posexplode(F.arrays_zip("w", "next")).alias("pos", "x"))
    return rows.select("id", "pos", F.explode(F.array(F.col("x.w"), F.concat(F.col("x.w"), F.lit(" "), F.col("x.next")))).alias("key")).where("key IS NOT NULL")


def phrase_hits(docs: DataFrame, phrases: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(phrase, id, pos): where each phrase's words stand in a row in a text.

    Only pairs of words that phrases have, and phrases of one word, enter the index.  A
    phrase is looked up by its rarest pair; its other pairs are asked for at their
    places by text and place, so neither phrases times texts nor all places of a
    common pair meet.  Phrases without words are nowhere.
    """
    parts = phrases.select("phrase").where("phrase IS NOT NULL").distinct().select("phrase", words(F.col("phrase")).alias("w")).where(F.size("w") > 0)
    parts = parts.select("phrase", _keys(F.col("w")).alias("k")).select("phrase", F.size("k").alias("n"), F.explode("k").alias("x")).select("phrase", "n", "x.seq", "x.key")
    index = positions(docs, id_col, text_col).join(_bounded(parts.select("key").distinct()), "key", "left_semi").select("id", "pos", "key")
    # Texts are read once for all three uses of the index.
    index = checkpointed(index)
    often = index.groupBy("key").agg(F.count("*").alias("places"))
    # A pair that is nowhere leads its phrase nowhere.
    led = parts.join(often, "key", "left").groupBy("phrase", "n").agg(F.min(F.struct(F.coalesce("places", F.lit(0)).alias("places"), "seq", "key")).alias("lead"))
    led = led.where("lead.places > 0").select("phrase", "n", F.col("lead.seq").alias("seq"), F.col("lead.key").alias("key"))
    starts = index.join(led, "key").select("phrase", "n", "id", (F.col("pos") - F.col("seq")).alias("start")).where("start >= 0").distinct()
    asked = starts.join(parts.select("phrase", "seq", "key"), "phrase").select("phrase", "n", "id", "start", (F.col("start") + F.col("seq")).alias("pos"), "key")
    # Places are counted, not rows: a repeated row of a text has its places twice.
    met = asked.hint("shuffle_hash").join(index, ["id", "pos", "key"]).groupBy("phrase", "n", "id", "start").agg(F.countDistinct("pos").alias("met"))
    return met.where("met = n").select("phrase", "id", F.col("start").alias("pos"))


def phrase_coverage(docs: DataFrame, phrases: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(phrase, texts, places, first_id) of every phrase; zeros where it stands nowhere."""
    hits = phrase_hits(docs, phrases, id_col, text_col)
    found = hits.groupBy("phrase").agg(F.countDistinct("id").alias("texts"), F.count("*").alias("places"), F.min("id").alias("first_id"))
    every = phrases.select("phrase").where("phrase IS NOT NULL").distinct().join(found, "phrase", "left")
    return every.select("phrase", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("places", F.lit(0)).alias("places"), "first_id")


def usable(word: Column) -> Column:
    """Words that may be terms: two letters or more, no number, neither stop word nor boilerplate."""
    return (F.length(word) >= 2) & ~word.rlike(r"\A[0-9.,-]+\z") & ~word.isin(*STOP_WORDS) & ~word.isin(*BOILERPLATE)


def without_comments(text: Column) -> Column:
    """Markup comments as a space; one that does not end takes the rest.  Openers that a removal puts together go as well."""
    once = lambda t: F.regexp_replace(t, r"(?s)<!--.*?(?:-->|\z)", " ")
    return once(once(text))


def _said(text: Column) -> Column:
    """The words of each part of a text: see `sentence_words`."""
    clean = F.lower(F.regexp_replace(F.regexp_replace(without_comments(text), r"https?://\S+", " "), "[`*_>#|]", " "))
    return F.transform(F.split(clean, r'[\n;:,()\[\]{}"]+|[.!?]+(?=\s|\z)'), words)


def sentence_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, w): the words of every sentence, line, or part between commas, colons and brackets; without URLs and marks of emphasis."""
    return docs.select(F.col(id_col).alias("id"), F.explode(_said(F.col(text_col))).alias("w")).where(F.size("w") > 0)


def _terms_of_texts(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """`terms` where each text is one row: a text's own words and pairs are made distinct where it is read, so only counts are shuffled."""
    said = _said(F.col(text_col))
    single = docs.select(F.explode(F.array_distinct(F.flatten(said))).alias("term")).where(usable(F.col("term")))
    often = checkpointed(single.groupBy("term").agg(F.count("*").alias("texts")).where(F.col("texts") >= least))

    def neighbours(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))

    pairs = docs.select(F.explode(F.array_distinct(F.flatten(F.transform(said, neighbours)))).alias("term"))
    known = _bounded(often.select("term"))
    for place in (0, 1):
        side = F.substring_index("term", " ", 1 if place == 0 else -1)
        pairs = pairs.withColumn("side", side).join(known.withColumnRenamed("term", "side"), "side", "left_semi").select("term")
    counted = pairs.groupBy("term").agg(F.count("*").alias("texts")).where(F.col("texts") >= least)
    kinds = [(often, "word"), (counted, "phrase")]
    return reduce(DataFrame.unionByName, [df.select("term", F.lit(kind).alias("kind"), "texts") for df, kind in kinds])


def terms(docs: DataFrame, id_col: str, text_col: str, least: int = 1, names: DataFrame | None = None) -> DataFrame:
    """(term, kind, texts): words, pairs of neighbouring words of one sentence, and names, in `least` texts or more.

    Level by level: a pair is counted only if both of its words are in as many texts.
    ``names`` is (id, name) of dictionary finds; a name is its lower-case term, of kind
    ``skill`` wherever a word or pair is the same.
    """
    if names is None and docs.groupBy(id_col).count().where("count > 1").isEmpty():
        return _terms_of_texts(docs, id_col, text_col, least)
    rows = sentence_words(docs, id_col, text_col)
    single = rows.select("id", F.explode("w").alias("term")).where(usable(F.col("term"))).distinct()
    often = _bounded(checkpointed(single.groupBy("term").agg(F.count("*").alias("texts")).where(F.col("texts") >= least).select("term")))
    n = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = rows.select("id", F.explode(F.zip_with(F.slice("w", 1, n), F.slice("w", 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p")).select("id", "p.a", "p.b")
    pairs = pairs.withColumn("term", F.concat_ws(" ", "a", "b"))
    frequent = pairs
    for side in ("a", "b"):
        frequent = frequent.join(often.withColumnRenamed("term", side), side, "left_semi")
    found = single.unionByName(frequent.select("id", "term"))
    kind = F.when(F.col("term").contains(" "), "phrase").otherwise("word")
    if names is not None:
        named = names.select("id", F.lower("name").alias("term")).where("term IS NOT NULL")
        known = named.select("term").distinct()
        same = pairs.join(known, "term", "left_semi").where(usable(F.col("a")) & usable(F.col("b")))
        found = found.unionByName(named).unionByName(same.select("id", "term"))
    counted = found.distinct().groupBy("term").agg(F.count("*").alias("texts")).where(F.col("texts") >= least)
    if names is not None:
        counted = counted.join(known.withColumn("skill", F.lit(True)), "term", "left")
        kind = F.when(F.col("skill"), "skill").otherwise(kind)
    return counted.select("term", kind.alias("kind"), "texts")


def covered(candidates: DataFrame, entries: DataFrame) -> DataFrame:
    """Candidates (term, ..) that hold an entry's words in a row, or equal it."""
    hits = phrase_hits(candidates.select(F.col("term").alias("id"), "term"), entries, "id", "term")
    return candidates.join(hits.select(F.col("id").alias("term")).distinct(), "term", "left_semi")


def telling_terms(positive: DataFrame, baseline: DataFrame, entries: DataFrame, id_col: str, text_col: str, least: int = 3, top: int = 25) -> DataFrame:
    """The terms that set `positive` texts apart: (term, kind, positive, baseline, lift), the first `top`.

    The lift is log2((p + 1) / (P + 2)) - log2((b + 1) / (B + 2)); terms in fewer than
    `least` positive texts, with no lift, or covered by an entry are left out.
    """
    size = lambda df, name: df.agg(F.count("*").alias(name))
    p = terms(positive, id_col, text_col, least).select("term", "kind", F.col("texts").alias("positive"))
    b = terms(baseline, id_col, text_col).select("term", F.col("texts").alias("baseline"))
    joined = p.join(b, "term", "left").select("term", "kind", "positive", F.coalesce("baseline", F.lit(0)).alias("baseline"))
    left = joined.join(covered(joined, entries).select("term"), "term", "left_anti")
    sized = left.crossJoin(F.broadcast(size(positive, "P"))).crossJoin(F.broadcast(size(baseline, "B")))
    lift = F.log2(((F.col("positive") + 1) / (F.col("P") + 2)) / ((F.col("baseline") + 1) / (F.col("B") + 2)))
    scored = sized.withColumn("raw", lift).where("raw > 0").select("term", "kind", "positive", "baseline", F.round("raw", 2).alias("lift"))
    return scored.orderBy(F.desc("lift"), F.desc("positive"), "term").limit(top)
