"""Employers by name: one best registered employer for a written name, with a reason or a refusal; and the registry's fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Long legal forms and their short ones (fixed values).
SHORT_FORMS = {"corporation": "corp", "incorporated": "inc", "limited": "ltd", "company": "co"}
#: Reasons from the strongest on.
REASONS = ("exact", "plausible", "misspelt")
#: Least and most letters of a name in which one slip is looked for.
SLIP = (6, 40)


def bare_name(name: Column) -> Column:
    """Letters a-z and digits of a name."""
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "")


def name_tokens(name: Column) -> Column:
    """Words of a name: a run of single letters is one word, a leading "the" goes, the last word's legal form is short."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", " "))
    joined = F.regexp_replace(plain, r"(?<=(?:^|\s)[a-z0-9])\s(?=[a-z0-9](?:\s|$))", "")
    words = F.filter(F.split(joined, " "), lambda w: w != "")
    words = F.when(F.get(words, 0) == "the", F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))).otherwise(words)
    last = F.get(words, F.size(words) - 1)
    short = F.coalesce(F.create_map(*[F.lit(x) for pair in SHORT_FORMS.items() for x in pair])[last], last)
    return F.when(F.size(words) > 0, F.concat(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.array(short))).otherwise(words)


def _beginnings(words: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " "))


def _slips(bare: Column) -> Column:
    """The name, and the name without each of its letters: names one slip apart share one of these."""
    n = F.length(bare)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(bare, F.lit(1), i - 1), F.substring(bare, i + 1, n)))
    return F.when(n.between(*SLIP), F.array_distinct(F.concat(F.array(bare), cut))).otherwise(F.array().cast("array<string>"))


def resolve_employers(names: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, key, match, reason) for every row of names (id, name); registry is (key, name, evidence).

    exact: the same letters.  plausible: the words of one are a beginning of the other's.
    misspelt: one letter more, less or other.  The strongest reason counts, within it the
    most evidence; two employers that tie are refused (``ambiguous``), and without any
    the reason is ``none``.

    Names meet by keys of their letters, beginnings and slips.  For a key that decides by
    itself only the registry's two best rows are kept, so a key's block has two rows
    however many employers share it; rows with one bare name are two at most for slips as well.
    """
    rows = registry.where("key IS NOT NULL AND name IS NOT NULL").select("key", F.col("name").alias("match"), F.coalesce(F.col("evidence"), F.lit(0)).alias("evidence"))
    rows = rows.select("key", "match", "evidence", bare_name(F.col("match")).alias("bare"), name_tokens(F.col("match")).alias("words")).where("bare != ''")

    def best_two(keyed: DataFrame) -> DataFrame:
        """An employer counts once for a key; of all employers the two with the most evidence stay."""
        one = keyed.groupBy("block", "key").agg(F.max_by(F.struct("match", "bare", "evidence"), F.struct("evidence", "match")).alias("x")).select("block", "key", "x.*")
        order = Window.partitionBy("block").orderBy(F.desc("evidence"), "match", "key")
        return one.withColumn("place", F.row_number().over(order)).where("place <= 2").drop("place")

    wanted = names.select("id", "name", bare_name(F.col("name")).alias("own"), name_tokens(F.col("name")).alias("own_words")).where("own != ''")
    ask = lambda block: wanted.select("id", "own", block.alias("block"))
    whole = F.array_join("words", " ")
    exact = ask(F.col("own")).join(best_two(rows.withColumn("block", F.col("bare"))), "block").withColumn("strength", F.lit(3))
    shorter = wanted.where(F.size("own_words") > 0).select("id", "own", F.explode(_beginnings(F.col("own_words"))).alias("block")).join(best_two(rows.withColumn("block", whole)), "block")
    longer = rows.where(F.size("words") > 0).select("key", "match", "bare", "evidence", F.explode(_beginnings(F.col("words"))).alias("block"))
    longer = ask(F.array_join("own_words", " ")).where("block != ''").join(best_two(longer), "block")
    plausible = shorter.unionByName(longer).withColumn("strength", F.lit(2))
    slips = best_two(rows.withColumn("block", F.col("bare"))).drop("block").withColumn("block", F.explode(_slips(F.col("bare"))))
    near = wanted.select("id", "own", F.explode(_slips(F.col("own"))).alias("block")).join(slips, "block").where(F.levenshtein("own", "bare") == 1).withColumn("strength", F.lit(1))
    found = exact.unionByName(plausible).unionByName(near).groupBy("id", "key").agg(F.max(F.struct("strength", "evidence", "match")).alias("x"))
    # The best of each strength and evidence, and whether another employer ties with it.
    ranked = found.select("id", "key", F.struct("x.strength", "x.evidence").alias("rank"), F.col("x.match").alias("match"))
    top = ranked.groupBy("id").agg(F.max("rank").alias("rank"))
    tied = ranked.join(top, ["id", "rank"]).groupBy("id", "rank").agg(F.count("*").alias("n"), F.min(F.struct("key", "match")).alias("one"))
    reason = F.array(*[F.lit(r) for r in reversed(REASONS)])
    sure = F.col("n") == 1
    result = tied.select("id", F.when(sure, F.col("one.key")).alias("key"), F.when(sure, F.col("one.match")).alias("match"), F.when(sure, F.get(reason, F.col("rank.strength") - 1)).otherwise("ambiguous").alias("reason"))
    return names.select("id").join(result, "id", "left").select("id", "key", "match", F.coalesce("reason", F.lit("none")).alias("reason"))


def fold_identities(registry: DataFrame, inbox: DataFrame, identity: tuple[str, ...]) -> DataFrame:
    """The registry with an inbox folded in: for each identity the row of its first contribution (contribution, seq).

    Both have the same columns, among them contribution, seq and the identity's.  The fold
    is a least element for each identity, so folding again changes nothing, and
    two inboxes give the same registry in either order.  Rows without an identity go.
    """
    rows = registry.unionByName(inbox.select(registry.columns))
    rows = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in identity))
    values = [c for c in registry.columns if c not in identity]
    order = F.struct("contribution", "seq", *[F.col(c) for c in values if c not in ("contribution", "seq")])
    best = rows.groupBy(*identity).agg(F.min_by(F.struct(*values), order).alias("r"))
    return best.select(*[F.col(c) if c in identity else F.col(f"r.{c}").alias(c) for c in registry.columns])


def fold_report(registry: DataFrame, inbox: DataFrame, identity: tuple[str, ...]) -> DataFrame:
    """(contribution, added, skipped) of a fold: a row is skipped if its identity is registered or an earlier row of the inbox has it."""
    rows = inbox.where(" AND ".join(f"`{c}` IS NOT NULL" for c in identity))
    known = registry.select(*identity).distinct().withColumn("known", F.lit(True))
    first = rows.groupBy(*identity).agg(F.min(F.struct("contribution", "seq")).alias("first"))
    judged = rows.join(first, list(identity)).join(known, list(identity), "left")
    added = F.col("known").isNull() & (F.struct("contribution", "seq") == F.col("first"))
    return judged.groupBy("contribution").agg(F.count(F.when(added, 1)).alias("added"), F.count(F.when(~added, 1)).alias("skipped"))
