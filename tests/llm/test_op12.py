"""Base spans against Python's expressions as the contract writes them; discovery on small corpora with known contexts."""

import hashlib
import random
import re
import time

from siltstone.llm import op12_contextual_pii as op12

EXPRESSIONS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
DOCS = "doc_id long, text string"


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    out = []
    for at, (kind, expression) in enumerate(EXPRESSIONS.items()):
        for m in re.finditer(expression, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 14 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 10 <= len(digits) <= 15):
                out.append((m.start(), at, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def found(spark, texts):
    rows = op12.personal_data(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    assert len(rows) == len(texts)
    return {r.doc_id: r for r in rows}


def test_base_spans(spark):
    """Random strings over the alphabets of the expressions, with real cases among them."""
    rng = random.Random(12)
    parts = ["4539578763621486", "+1 (555) 010-9999", "a.b@c-d.example", "10.0.0.256", "1.2.3.4.5.6.7.8", "0001.02.3.255", "4539 5787-6362 1486", "x@y", "_q@r.s", "é", "😀", "ß", "@", "+", "-", " ", ".", "%", "(", "\n", "12345", "a", "0", "+4", "a@b.c_d@e.f"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(700)]
    got = found(spark, texts)
    for k, text in enumerate(texts):
        want = base(text)
        assert got[k].base == ",".join(want), text
        assert [got[k][f"n_{kind}"] for kind in op12.KINDS] == [sum(x.startswith(kind) for x in want) for kind in op12.KINDS]
        assert set(want) <= set(got[k].spans.split(","))


def test_long_runs_are_linear(spark):
    """Texts on which a plain expression takes quadratic time or a deep stack."""
    texts = ["a" * 200_000, "1" * 200_000, "1.1" * 60_000, "a@" + "b." * 100_000 + "c", "+1" + "(" * 200_000, "1 " * 100_000, "a." * 100_000 + "@b.c", "x@y.z " * 20_000, "1.2.3.4 " * 20_000]
    began = time.time()
    got = found(spark, texts)
    assert time.time() - began < 60
    assert got[3].base == f"email:0:{len(texts[3])}" and got[6].n_email == 1
    assert got[7].n_email == 20_000 and got[7].base.startswith("email:0:5,email:6:11,") and got[8].n_ip == 20_000


def corpus():
    """Phone and card numbers in contexts of their own, identifiers of other shapes in the same ones, and plain text."""
    texts = [f"You can reach me at +1 (555) 010-{1000 + k} any day, said number {k}." for k in range(8)]
    texts += [f"You can reach me at 0171-55{k}-2213 any day, they wrote." for k in range(3)]
    texts += [f"Card no: 4539578763621486 was used; again card no: {n} today." for n in ("4556737586899855", "4929420573595709", "4716461583322103")]
    texts += ["Card no: X-99281-77 was used."]
    texts += [f"The meeting is at building 98765{k} on floor two of the {w} house in order 12-3456-{k}." for k, w in enumerate(["red", "old", "tall"])]
    texts += ["You can reach me at 0171-550-2213 tomorrow.", "Nothing here at all."]
    return texts


def test_discovery(spark):
    texts = corpus()
    got = found(spark, texts)
    spans = {k: [x for x in r.spans.split(",") if x and x not in base(texts[k])] for k, r in got.items()}
    for k in range(8, 11):
        start = texts[k].index("0171")
        assert spans[k] == [f"phone:{start}:{start + 13}"]
    start = texts[14].index("X-99")
    assert spans[14] == [f"card:{start}:{start + 10}"]
    assert spans[18] == [f"phone:{texts[18].index('0171')}:{texts[18].index('0171') + 13}"], "a discovered value counts wherever it stands"
    assert not any(spans[k] for k in (*range(8), *range(11, 14), *range(15, 18), 19)), "base spans and numbers in other contexts stay as they are"


def test_second_round(spark):
    """Values of the first round support a pattern that discovers further ones."""
    texts = [f"my phone is: +1 555 010 {1000 + k} ok" for k in range(6)]
    texts += [f"my phone is: 55{k}-777-88 ok" for k in range(4)] + [f"ring them under 55{k}-777-88 now" for k in range(4)] + ["ring them under 12345-6 now"]
    got = found(spark, texts)
    assert got[len(texts) - 1].spans == f"phone:{texts[-1].index('12345')}:{texts[-1].index('12345') + 7}"


def test_plain_words_outvote(spark):
    """A context in which mostly plain words stand discovers nothing, and copies don't support it."""
    texts = [f"it was of the +1 555 010 {1000 + k} kind" for k in range(4)] + [f"it was of the {w} kind" for w in "big small old new red blue odd even".split()] + ["it was of the 55-66-77 kind"]
    assert found(spark, texts)[len(texts) - 1].spans == ""
    copies = ["so call us on +1 555 010 9999 please"] * 30 + ["so call us on 55-66-77 please"]
    assert found(spark, copies)[30].spans == ""


def test_shuffled_patterns(spark, monkeypatch):
    """More patterns than may be broadcast give the same result."""
    texts = corpus()
    want = {k: tuple(r) for k, r in found(spark, texts).items()}
    monkeypatch.setattr(op12, "BROADCAST_PATTERNS", 0)
    assert {k: tuple(r) for k, r in found(spark, texts).items()} == want


def test_query_and_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, rid int, kind string, value string, pattern string"
    rows = [(1, None, 1, "x", None, None), (1, "", 2, "y", "v", "p"), (None, "a@b.c", 3, "z", "v", "p"), (1, "a@b.c 😀 1.2.3.4", None, None, None, None), (1, "a@b.c 😀 1.2.3.4", None, None, None, None)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/some/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    got = op12.op12_contextual_pii(spark, f"{tmp_path}/some")
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    both = "email:0:5,ip:8:15"
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 0, 0, 0, 0, digest(""), "")] * 2 + [(None, 1, 0, 0, 0, digest("email:0:5"), "email:0:5")] + [(1, 1, 1, 0, 0, digest(both), both)] * 2, key=str)
    assert op12.op12_contextual_pii(spark, f"{tmp_path}/none").collect() == []


def test_native(spark, tmp_path):
    """No Python worker in any plan of the main path."""
    docs = spark.createDataFrame(list(enumerate(corpus())), DOCS)
    plans = op12.placed(docs)._jdf.queryExecution().toString() + op12._plain_places(docs, docs.selectExpr("text AS pattern"), True)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow|EvalPython", plans)
