"""Conversation structure repair by a min-plus scan over 4x4 matrices.

A well-formed conversation reads ``(s?(ua)+)?`` by the first letters of its roles.  The
states are: nothing yet, after the system turn, after a user turn, after an assistant
turn.  Each turn is a matrix of cheapest (cost, audit) elements from state to state:
keep (0), give another role (2), delete (3; the only choice for blank turns and for
repeats), one more for a truncated turn that stays; it is multiplied from the left by
the closure of inserted turns (2 each).  The product over all turns is associative, so a
conversation of any length is cut into blocks, each block's turns are multiplied in its
task, and the blocks' products are multiplied in a tree over Spark groups.

The elements are compared by cost, then by audit.  That is a semiring here: an audit's
cost follows from its letters, so audits of equal cost are never prefixes of each other,
and what is least stays least after anything is appended.

Edge cases: null role and text are one space; a null turn comes before all others; turns
of one number are ordered by role, then by SHA-256; equal rows are one row with a count
until they are written; a null ``conv_id`` is a conversation of its own; a conversation
of which no row is left has zeros and an empty audit; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, partitions, table

#: Characters that don't count as text.
BLANK = r"[\x20\x09-\x0D]"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Rows of one block.  A block is one group of a task.
BLOCK = 512
#: Neighbouring products that one group multiplies.
FAN_IN = 16
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a kept turn of a role, by state before.
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = ("su", "ua", "au")

Matrix = tuple


def times(left: Matrix, right: Matrix) -> Matrix:
    """Min-plus product of two 4x4 matrices of (cost, audit) elements; None is unreachable."""
    out = []
    for i in range(4):
        for j in range(4):
            ways = [(left[4 * i + k], right[4 * k + j]) for k in range(4)]
            ways = [(x[0] + y[0], x[1], y[1]) for x, y in ways if x is not None and y is not None]
            least = min((cost for cost, _, _ in ways), default=None)
            out.append(None if least is None else (least, min(x + y for cost, x, y in ways if cost == least)))
    return tuple(out)


def _matrix(elements: dict) -> Matrix:
    return tuple(elements.get((i, j)) for i in range(4) for j in range(4))


UNIT = _matrix({(i, i): (0, "") for i in range(4)})


def _closure() -> Matrix:
    """Any number of inserted turns: the least fixed point of 1 + insert * closure."""
    insert = {(i, j): (INSERT, "I") for role in "ua" for i, j in STEPS[role].items()}
    one, closed = _matrix({(i, i): (0, "") for i in range(4)} | insert), UNIT
    while (further := times(closed, one)) != closed:
        closed = further
    return closed


CLOSURE = _closure()


def turn_matrix(initial: str, fault: str, count: int) -> Matrix:
    """A turn, with the inserted ones before it; its further copies can only be deleted."""
    ways = {(i, i): (DELETE, "D") for i in range(4)}
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        for role in "ua":
            ways |= {(i, j): (REROLE + more, "R") for i, j in STEPS[role].items()}
        ways |= {(i, j): (KEEP + more, "K") for i, j in STEPS.get(initial, {}).items()}
    copies = {(i, i): (DELETE * (count - 1), "D" * (count - 1)) for i in range(4)}
    return times(times(CLOSURE, _matrix(ways)), _matrix(copies))


def product(turns: tuple) -> Matrix:
    """Product of the turns' matrices as a balanced tree."""
    if len(turns) > 8:
        return times(product(turns[: len(turns) // 2]), product(turns[len(turns) // 2 :]))
    return _short_product(turns)


@lru_cache(maxsize=50_000)
def _short_product(turns: tuple) -> Matrix:
    if not turns:
        return UNIT
    if len(turns) == 1:
        return turn_matrix(*turns[0])
    return times(_short_product(turns[: len(turns) // 2]), _short_product(turns[len(turns) // 2 :]))


def cheapest(whole: Matrix) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    closed = times(whole, CLOSURE)
    return min(x for x in (closed[4 * START + START], closed[4 * START + ASSISTANT]) if x is not None)


SUMMARY = (
    "conv_id long, part long, blk long, open boolean, n long, costs array<long>, audits array<string>, "
    "blank long, duplicate long, truncated long, illegal long, first string, last string, "
    "first_turn long, last_turn long, least_turn long, turns long"
)
_NAMES = [x.split()[0] for x in SUMMARY.split(", ")]


def _arrow(rows: list[dict], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    fields = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])
    return pa.Table.from_pylist(rows, schema=fields)


def _summed(a: dict, b: dict) -> dict:
    """Two neighbouring summaries as one; the matrices are multiplied."""
    out = {k: a[k] + b[k] for k in ("n", "blank", "duplicate", "truncated")}
    out |= {"conv_id": a["conv_id"], "first": a["first"], "last": b["last"], "matrix": times(a["matrix"], b["matrix"])}
    out["illegal"] = a["illegal"] + b["illegal"] + (a["last"] + b["first"] not in LEGAL)
    known = [x for x in (a["least_turn"], b["least_turn"]) if x is not None]
    same = a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    return out | {"least_turn": min(known, default=None), "turns": a["turns"] + b["turns"] - same, "first_turn": a["first_turn"], "last_turn": b["last_turn"]}


def _row(summary: dict, part: int, blk: int, is_open: bool) -> dict:
    matrix = summary["matrix"]
    costs, audits = [None if x is None else x[0] for x in matrix], [None if x is None else x[1] for x in matrix]
    return {k: v for k, v in summary.items() if k != "matrix"} | {"part": part, "blk": blk, "open": is_open, "costs": costs, "audits": audits}


def _read(row: dict) -> dict:
    return row | {"matrix": tuple(None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"]))}


def _block(rows: pa.Table) -> pa.Table:
    """Summaries of the conversations of one block; the first and the last may go on in other blocks."""
    found = sorted(rows.to_pylist(), key=lambda r: r["pos"])
    runs: list[list[dict]] = []
    for r in found:
        if not runs or runs[-1][-1]["conv_id"] != r["conv_id"]:
            runs.append([])
        runs[-1].append(r)
    out = []
    for k, run in enumerate(runs):
        faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        illegal = 0
        for j, r in enumerate(run):
            if r["fault"]:
                faults[r["fault"]] += 1
            faults["blank" if r["fault"] == "blank" else "duplicate"] += r["n"] - 1
            illegal += (r["n"] - 1) + (j > 0 and run[j - 1]["initial"] + r["initial"] not in LEGAL)
        known = [r["turn"] for r in run if r["turn"] is not None]
        summary = faults | {"conv_id": run[0]["conv_id"], "n": sum(r["n"] for r in run), "illegal": illegal, "first": run[0]["initial"], "last": run[-1]["initial"]}
        summary |= {"first_turn": run[0]["turn"], "last_turn": run[-1]["turn"], "least_turn": min(known, default=None), "turns": len(set(known))}
        summary["matrix"] = product(tuple((r["initial"], r["fault"], r["n"]) for r in run))
        out.append(_row(summary, found[0]["part"], found[0]["blk"], k in (0, len(runs) - 1)))
    return _arrow(out, SUMMARY)


def _merge(rows: pa.Table) -> pa.Table:
    """One summary for the neighbouring ones of a conversation, multiplied pairwise."""
    found = sorted(rows.to_pylist(), key=lambda r: (r["part"], r["blk"]))
    level = [_read(r) for r in found]
    while len(level) > 1:
        level = [_summed(level[k], level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return _arrow([{k: v for k, v in _row(level[0], found[0]["part"], found[0]["blk"], True).items() if k in _NAMES}], SUMMARY)


RESULT = "conv_id long, part long, blk long, open boolean, n long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in map(_read, batch.to_pylist()):
            cost, audit = cheapest(r["matrix"])
            gaps = 0 if r["least_turn"] is None else r["last_turn"] - r["least_turn"] + 1 - r["turns"]
            out.append({k: r[k] for k in ("conv_id", "part", "blk", "open", "n", "blank", "duplicate", "truncated", "illegal")} | {"gaps": gaps, "cost": cost, "audit": audit})
        yield from _arrow(out, RESULT).to_batches()


SLICE = "part long, blk long, conv_id long, piece string, before long, opens boolean, whole boolean"


def _slices(results: pa.Table, blocks: pa.Table) -> pa.Table:
    """Cut a conversation's audit at its blocks; before counts the turns that are there already."""
    if not results.num_rows:
        return _arrow([], SLICE)
    found = sorted(blocks.to_pylist(), key=lambda r: (r["part"], r["blk"]))
    return _arrow(_cut(results.column("audit")[0].as_py(), found), SLICE)


def _whole_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slices of conversations of one block."""
    for batch in batches:
        yield from _arrow([s for r in batch.to_pylist() for s in _cut(r["audit"], [r])], SLICE).to_batches()


def _cut(audit: str, found: list[dict]) -> list[dict]:
    opens = (len(audit) - audit.count("D")) % 2 == 1
    out, at, before = [], 0, 0
    for k, r in enumerate(found):
        end, rows = at, 0
        while rows < r["n"]:
            rows += audit[end] != "I"
            end += 1
        end = len(audit) if k == len(found) - 1 else end
        piece = audit[at:end]
        out.append({"part": r["part"], "blk": r["blk"], "conv_id": r["conv_id"], "piece": piece, "before": before, "opens": opens, "whole": len(found) == 1})
        at, before = end, before + len(piece) - piece.count("D")
    return out


REPAIRED = "conv_id long, part long, blk long, position long, edit string, role string, text string"
CHUNK = "conv_id long, part long, blk long, whole boolean, chunk binary"


def _repaired(rows: pa.Table, slices: pa.Table) -> Iterator[tuple[dict, list[dict]]]:
    by_conversation: dict = {}
    for r in sorted(rows.to_pylist(), key=lambda r: r["pos"]):
        by_conversation.setdefault(r["conv_id"], []).append(r)
    for s in slices.to_pylist():
        turns = iter([(r["role"], r["text"]) for r in by_conversation.get(s["conv_id"], []) for _ in range(r["n"])])
        position, out = s["before"], []
        for edit in s["piece"]:
            role, text = ("", "") if edit == "I" else next(turns)
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if (position - s["opens"]) % 2 else "user"
            out.append({"conv_id": s["conv_id"], "part": s["part"], "blk": s["blk"], "position": position, "edit": edit, "role": role, "text": text})
            position += 1
        yield s, out


def _turns(rows: pa.Table, slices: pa.Table) -> pa.Table:
    return _arrow([r for _, out in _repaired(rows, slices) for r in out], REPAIRED)


def _chunks(rows: pa.Table, slices: pa.Table) -> pa.Table:
    """Each block's repaired turns as they are hashed; every turn but a conversation's first begins with a newline."""
    out = []
    for s, turns in _repaired(rows, slices):
        chunk = "".join("\n" * (t["position"] > 0) + f"{t['role']}:{t['text']}" for t in turns).encode()
        if s["whole"]:
            chunk = hashlib.sha256(chunk).hexdigest().encode()
        out.append({k: s[k] for k in ("conv_id", "part", "blk", "whole")} | {"chunk": chunk})
    return _arrow(out, CHUNK)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the sorted chunks of each conversation, one chunk in memory at a time."""
    schema, current, state = "conv_id long, repaired_sha256 string", None, None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if state is None or r["conv_id"] != current:
                if state is not None:
                    out.append({"conv_id": current, "repaired_sha256": state.hexdigest()})
                current, state = r["conv_id"], hashlib.sha256()
            state.update(r["chunk"])
        yield from _arrow(out, schema).to_batches()
    if state is not None:
        yield from _arrow([{"conv_id": current, "repaired_sha256": state.hexdigest()}], schema).to_batches()


def turns_of(conversations: DataFrame) -> DataFrame:
    """The columns used, with nulls of role and text as one space."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *texts)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the contract's damage, and copies, how often each is there."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = turns_of(conversations).withColumn("kind", kind).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _fault(first: Column) -> Column:
    """The first fault of a row: blank, duplicate, truncated, or none."""
    text = F.col("text")
    sound = text.rlike(rf"[.!?]{BLANK}*\z")
    return F.when(~text.rlike(r"[^\x20\x09-\x0D]"), "blank").when(~first, "duplicate").when(~sound, "truncated").otherwise("")


def repair(turns: DataFrame, stage: Stage | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, blocks' slices, ordered rows) of turns (conv_id, turn, role, text, copies).

    ``results`` has counts, cost and audit of every conversation that has rows.  Rows are
    ordered by ranges of (conversation, turn, role, digest), so a conversation of any
    length is spread over tasks, and cut into blocks of BLOCK rows.
    """
    spark = turns.sparkSession
    stage = stage or Stage(spark, "conversations")
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    rows = turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("n"))
    rows = stage.write(rows.withColumns({"digest": digest, "at": order}), "rows")
    # The first row of each role and text; the join's keys are those of single rows, so no key is hot.
    first = rows.groupBy("conv_id", "digest").agg(F.min("at").alias("at")).withColumn("is_first", F.lit(True))
    first = first.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), F.col("at").alias("a"), "is_first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")) & (F.col("at") == F.col("a"))
    rows = rows.join(first, same, "left").withColumn("fault", _fault(F.col("is_first").isNotNull()))
    rows = rows.select("conv_id", "turn", "role", "text", "n", "fault", "digest", "at")
    keys = ["conv_id", "at", "role", "digest"]
    rows = rows.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id()
    rows = rows.withColumns({"part": F.spark_partition_id().cast("long"), "pos": place.bitwiseAND(F.lit((1 << 33) - 1))})
    rows = stage.write(rows.withColumn("blk", F.floor(F.col("pos") / BLOCK)).drop("digest", "at"), "ordered")
    stage.drop("rows")

    slim = rows.select("conv_id", "part", "blk", "pos", "turn", "n", "fault", F.substring("role", 1, 1).alias("initial"))
    blocks = stage.write(slim.groupBy("part", "blk").applyInArrow(_block, SUMMARY), "blocks")
    going, width = blocks.where("open"), 1
    going = stage.write(going.groupBy("conv_id", "part").applyInArrow(_merge, SUMMARY), "merged-0")
    levels = ["merged-0"]
    while width < partitions(spark):
        width *= FAN_IN
        merged = going.groupBy("conv_id", F.floor(F.col("part") / width)).applyInArrow(lambda _, rows: _merge(rows), SUMMARY)
        levels.append(f"merged-{width}")
        going = stage.write(merged, levels[-1])
    results = stage.write(blocks.where("NOT open").unionByName(going).mapInArrow(_results, RESULT), "results")
    whole = results.where("NOT open").select("conv_id", "audit", "part", "blk", "n").mapInArrow(_whole_slices, SLICE)
    parts = blocks.where("open").select("conv_id", "part", "blk", "n").groupBy("conv_id")
    cut = results.where("open").select("conv_id", "audit").groupBy("conv_id").cogroup(parts).applyInArrow(_slices, SLICE)
    slices = stage.write(whole.unionByName(cut), "slices")
    stage.drop("blocks", *levels)
    return results.drop("part", "blk", "open", "n"), slices, rows


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), edit, role, text."""
    _, slices, rows = repair(turns)
    found = rows.groupBy("part", "blk").cogroup(slices.groupBy("part", "blk")).applyInArrow(_turns, REPAIRED)
    return found.drop("part", "blk")


def digests(slices: DataFrame, rows: DataFrame, stage: Stage) -> DataFrame:
    """SHA-256 of each conversation's repaired ``role:text`` lines.

    A conversation of one block is hashed in its block.  SHA-256 can't be split, so the
    chunks of a longer one stream in order through one task, one at a time.
    """
    chunks = stage.write(rows.groupBy("part", "blk").cogroup(slices.groupBy("part", "blk")).applyInArrow(_chunks, CHUNK), "chunks")
    whole = chunks.where("whole").select("conv_id", F.col("chunk").cast("string").alias("repaired_sha256"))
    cut = chunks.where("NOT whole").repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "blk")
    return whole.unionByName(cut.mapInArrow(_digests, "conv_id long, repaired_sha256 string"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each conversation: its faults, the cheapest repair, and the repaired text's digest."""
    conversations = table(spark, sf_dir, "conversations")
    stage = Stage(spark, "conversations")
    results, slices, rows = repair(damaged(conversations), stage)
    hashes = digests(slices, rows, stage).select(F.col("conv_id").alias("h"), "repaired_sha256")
    results = results.withColumnRenamed("conv_id", "r")
    every = turns_of(conversations).select("conv_id").distinct()
    found = every.join(results, F.col("conv_id").eqNullSafe(F.col("r")), "left").join(hashes, F.col("conv_id").eqNullSafe(F.col("h")), "left")
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.sha2(F.lit(""), 256)
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


def _least(*ways: str) -> str:
    return f"least({', '.join(ways)})"


def _way(state: str, cost: str, letter: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}'}}"


def _stays(state: str, initial: str) -> str:
    """The cheaper of keeping a turn and giving it the role of this initial."""
    kept = _way(state, f"CASE WHEN initial = '{initial}' THEN more ELSE 1000000000 END", "K")
    return f"{kept}, {_way(state, f'{REROLE} + more', 'R')}"


OP13_SQL = f"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS varchar), ' ') || ':' || coalesce(CAST(turn AS varchar), ' ') AS key FROM conversations),
summed AS (SELECT *, xor(list_reduce(list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS bigint)),
  lambda crc, b: list_reduce(list_transform(range(8), lambda k: CAST(k AS bigint)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, b)), CAST(4294967295 AS bigint)), 4294967295) % 20 AS kind FROM keyed),
broken AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM summed WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), copy) AS rn FROM broken),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) AS nth, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS bare, substr(role, 1, 1) AS initial FROM placed),
judged AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY rn) || initial AS pair FROM seen),
coded AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS more FROM judged),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM coded GROUP BY conv_id),
ways AS (SELECT conv_id, CAST(0 AS bigint) AS rn, {{'c': CAST(0 AS bigint), 'a': ''}} AS z, {{'c': CAST(1000000000 AS bigint), 'a': ''}} AS s, {{'c': CAST({INSERT} AS bigint), 'a': 'I'}} AS u, {{'c': CAST({2 * INSERT} AS bigint), 'a': 'II'}} AS a FROM sums
UNION ALL
SELECT conv_id, rn, z, s, u, {_least("a", _way("u", str(INSERT), "I"))} AS a FROM (
  SELECT conv_id, rn, z, s, {_least("u", *(_way(x, str(INSERT), "I") for x in "zsa"))} AS u, a FROM (
    SELECT w.conv_id, r.rn, {_way("w.z", str(DELETE), "D")} AS z,
      CASE WHEN gone OR initial <> 's' THEN {_way("w.s", str(DELETE), "D")} ELSE {_least(_way("w.s", str(DELETE), "D"), _way("w.z", "more", "K"))} END AS s,
      CASE WHEN gone THEN {_way("w.u", str(DELETE), "D")} ELSE {_least(_way("w.u", str(DELETE), "D"), *(_stays(f"w.{x}", "u") for x in "zsa"))} END AS u,
      CASE WHEN gone THEN {_way("w.a", str(DELETE), "D")} ELSE {_least(_way("w.a", str(DELETE), "D"), _stays("w.u", "a"))} END AS a
    FROM ways w JOIN coded r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.rn = w.rn + 1))),
best AS (SELECT s.*, least(w.z, w.a).c AS cost, least(w.z, w.a).a AS audit FROM sums s JOIN ways w ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND w.rn = s.n),
letters AS (SELECT conv_id, audit, unnest(string_split(audit, '')) AS edit, unnest(range(length(audit))) AS k FROM best WHERE audit <> ''),
counted AS (SELECT *, count(*) FILTER (edit <> 'I') OVER w AS rn, count(*) FILTER (edit <> 'D') OVER w AS place, count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id) AS total
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
lines AS (SELECT c.conv_id, k, CASE WHEN edit = 'K' THEN r.role WHEN (place - total % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE r.text END AS line
  FROM counted c LEFT JOIN coded r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.rn = c.rn WHERE edit <> 'D'),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY k) AS repaired FROM lines GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""
