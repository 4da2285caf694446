"""rANS: exact round trips of blocks, segments and whole tables."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltstone.llm import op2_rans as op
from siltstone.llm.common import Stage, texts
from siltstone.llm.tokens import Encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [1, 7, 8, 9, 1000, 5000])
@pytest.mark.parametrize("symbols", [1, 2, 300, 60000])
def test_round_trip(n, symbols):
    rng = np.random.default_rng(n * symbols)
    ids = (rng.zipf(1.3, n) % symbols).astype(np.uint16 if symbols <= 1 << 16 else np.uint32)
    tokens, counts = np.unique(ids, return_counts=True)
    freq = op.normalise(tokens, counts)
    assert freq.sum() == 1 << op.BITS and (freq > 0).all()
    table = op.Table(tokens, freq)
    payload, marks, states = op.encode_block(ids, table, lanes=8, every=16)
    assert (op.decode_block(payload, n, marks, states, table, lanes=8, every=16) == ids).all()
    # The last segment decodes alone from its checkpoint.
    words = np.frombuffer(payload, "<u4").astype(np.uint64)
    last = len(marks) - 1
    state = np.frombuffer(states, np.uint64).reshape(-1, 8)[last]
    tail = op.decode_segment(words, marks[last], state, n - last * 128, table)
    assert (tail == ids[last * 128 :]).all()


def test_normalise_many_rare():
    counts = np.array([10**9, *[1] * 50000])
    freq = op.normalise(np.arange(len(counts)), counts)
    assert freq.sum() == 1 << op.BITS and freq.min() >= 1


@pytest.mark.parametrize(("path", "spaces"), [(BYTE, "lead"), (WORD, "drop")])
def test_encoder_is_exact(path, spaces):
    encoder = Encoder(path, spaces)

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.lists(st.text(alphabet="aZé9 .,'\n\t!_\x01\x02́s−Σİ١½", max_size=14), min_size=1, max_size=4))
    def check(values):
        want = encoder.model.encode_batch(values, add_special_tokens=False)
        assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder(values)] == [w.ids for w in want]

    check()


@pytest.mark.parametrize(("path", "spaces", "ids"), [(BYTE, "lead", [64, 220, 50256, 275]), (WORD, "drop", [320, 49407, 321])])
def test_strings_of_special_tokens(path, spaces, ids):
    encoder, plain = Encoder(path, spaces), Tokenizer.from_file(path)
    values = ["plain text", "a <|endoftext|> b", "x<|endoftext|>", "<|startoftext|>, y. z", "a <|EndOfText|> b", ""]
    got = [np.frombuffer(x, encoder.dtype).tolist() for x in encoder(values)]
    assert got == [e.ids for e in plain.encode_batch(values, add_special_tokens=False)]
    assert got[1] == ids


def expected(rows):
    model = Tokenizer.from_file(BYTE)
    out, start = [], 0
    for doc, text in rows:
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    return out


def test_table_in_any_order(spark, tmp_path):
    rows = [(i, f"text {i} with some words # and more " * (i % 5)) for i in range(200)] + [(500, None), (501, ""), (502, "long " * 20000)]
    shuffled = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    stage = Stage(spark, "t")
    got = op.decoded_documents(*op.write_rans(texts(shuffled), BYTE, 2, stage)).collect()
    assert sorted(tuple(r) for r in got) == expected(rows)


def test_damage_is_found(spark):
    stage = Stage(spark, "t")
    frequencies, blocks = op.write_rans(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), BYTE, 2, stage)
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="damaged payload"):
        op.decoded_documents(frequencies, blocks.withColumn("payload", F.concat("payload", F.lit(b"\x00\x00\x00\x00")))).collect()


def test_odd_rows(spark, odd, none):
    got = op.decoded_documents(*op.write_rans(odd, BYTE, 2, Stage(spark, "t"))).collect()
    assert len(got) == odd.count() and sum(r["n_tokens"] == 1 for r in got) == 2
    assert min(got, key=lambda r: r["start"])["doc_id"] is None
    assert op.decoded_documents(*op.write_rans(none, BYTE, 2, Stage(spark, "t"))).count() == 0
