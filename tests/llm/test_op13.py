"""Repairs against all edit sequences by brute force, and against the contract's definitions."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from siltstone.llm import op13_conversation_repair as op13

TEXTS = ["Yes.", "No", "", " ", "Why?", "so", "Yes.", " \t"]
ROLES = ["user", "assistant", "system", "tool", ""]


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def ordered(rows):
    key = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], key(r)))


def cheapest(rows, bad):
    """The least (cost, audit) over all edit sequences, and its turns."""
    best = None
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    choices = [["D"] if f in ("blank", "duplicate") else ["K", "user", "assistant", "D"] for f in bad]
    for between in itertools.product(inserts, repeat=len(rows) + 1):
        for chosen in itertools.product(*choices):
            cost, audit, out = 0, "", []
            for k, gap in enumerate(between):
                cost, audit, out = cost + 2 * len(gap), audit + "I" * len(gap), out + [(r, "") for r in gap]
                if k < len(rows):
                    c = chosen[k]
                    cost += {"K": 0, "D": 3}.get(c, 2) + (c != "D" and bad[k] == "truncated")
                    audit += c if c in "KD" else "R"
                    out += [] if c == "D" else [(rows[k][2] if c == "K" else c, rows[k][3])]
            if (best is None or (cost, audit) < best[0]) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
                best = (cost, audit), out
    return best


def check(spark, rows, schema="conv_id long, turn long, role string, text string"):
    turns = op13.damaged(spark.createDataFrame(rows, schema))
    stage = op13.Stage(spark, "test")
    results, slices, ordered_rows = op13.repair(turns, stage)
    got = {r.conv_id: r for r in results.collect()}
    hashes = {r[0]: r[1] for r in op13.digests(slices, ordered_rows, stage).collect()}
    kept = {}
    for r in sorted(op13.repaired_turns(turns).collect(), key=lambda r: (str(r.conv_id), r.position)):
        kept.setdefault(r.conv_id, []).append((r.role, r.text))
    by = {}
    for r in damage([r[:4] for r in rows]):
        by.setdefault(r[0], []).append(r)
    assert set(got) == set(by) == set(hashes)
    return by, got, hashes, kept


@pytest.mark.parametrize("block", [1, 2, 512])
def test_all_edit_sequences(spark, monkeypatch, block):
    """Blocks of one and two rows make every conversation go through the tree."""
    monkeypatch.setattr(op13, "BLOCK", block)
    rng = random.Random(13)
    rows = [(c, rng.choice([None, 0, 1, 2, 3, 7]), rng.choice(ROLES + ROLES[:2] * 3 + [None]), rng.choice(TEXTS + [None])) for c in [*range(40), None] for _ in range(rng.randrange(1, 4))]
    by, got, hashes, kept = check(spark, rows)
    for conv, found in by.items():
        found = ordered(found)
        if len(found) > 3:
            continue
        bad, r = faults(found), got[conv]
        (cost, audit), turns = cheapest(found, bad)
        numbers = [t for _, t, _, _ in found if t is not None]
        assert (r.cost, r.audit) == (cost, audit), found
        assert kept.get(conv, []) == turns
        assert hashes[conv] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in turns).encode()).hexdigest()
        assert (r.blank, r.duplicate, r.truncated) == tuple(map(bad.count, ("blank", "duplicate", "truncated")))
        assert r.gaps == (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0)
        first = [a[2][:1] for a in found]
        assert r.illegal == sum(x + y not in ("su", "ua", "au") for x, y in itertools.pairwise(first))


def test_long_conversation_in_blocks(spark, monkeypatch):
    """One conversation with most rows, in many blocks, equals the same in one block; so do thousands of equal rows."""
    rng = random.Random(3)
    rows = [(1, t, rng.choice(ROLES), rng.choice(TEXTS) + str(rng.randrange(40)) + rng.choice([".", ""])) for t in range(600)]
    rows += [(2, None, "user", "Same.")] * 1500 + [(3, 5, "assistant", "x" * 100_000 + ".")]
    results = []
    for block in (7, 1000):
        monkeypatch.setattr(op13, "BLOCK", block)
        _, got, hashes, kept = check(spark, rows)
        results.append(({c: tuple(r) for c, r in got.items()}, hashes, kept))
    assert results[0] == results[1]
    assert results[0][0][2][-1].count("D") >= 1499


def test_semiring():
    """Products don't depend on how they are grouped."""
    rng = random.Random(1)
    turns = tuple((rng.choice("suat"), rng.choice(["", "", "blank", "truncated"]), rng.choice([1, 1, 3])) for _ in range(21))
    one_by_one = op13.UNIT
    for t in turns:
        one_by_one = op13.times(one_by_one, op13.turn_matrix(*t))
    assert one_by_one == op13.product(turns)
    assert op13.times(op13.CLOSURE, op13.CLOSURE) == op13.CLOSURE


def test_query_gives_every_conversation(spark, tmp_path):
    """Dropped conversations, nulls, extra columns with clashing names, and an empty table."""
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    schema = "conv_id long, turn long, role string, text string, part long, n string, digest int"
    rows = [(dropped, 0, "user", "Hi.", 1, "x", None), (None, None, None, None, 2, None, 3), (7, 1, "user", "Ä? ", 3, "y", 4)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/some/conversations.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/conversations.parquet")
    got = {r.conv_id: r for r in op13.op13_conversation_repair(spark, f"{tmp_path}/some").collect()}
    assert set(got) == {dropped, None, 7}
    assert tuple(got[dropped])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert (got[None].blank, got[None].audit) in {(1, "D"), (0, ""), (2, "DD")}
    assert op13.op13_conversation_repair(spark, f"{tmp_path}/none").collect() == []
