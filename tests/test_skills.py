"""Dictionary names, phrases, terms and annotated sentences against plain versions."""

import re

import pytest

import pyarrow as pa
from siltstone.operators import annotations, dictionary, phrases
from siltstone.operators.lineage import slices

TERMS = [
    ("React", "React", None), ("React Native", "React Native", None), ("C++", "C++", None), (".NET", ".NET", None), ("CI/CD", "CI/CD", None), ("Golang", "Go", None), ("Go", "Go", "exact-word"),
    ("SAFe", "SAFe", "exact"), ("k8s", "Kubernetes", None), ("Kubernetes", "Kubernetes", None), ("fine-tuning", "Fine-tuning", "listed"), ("fine tuning", "Fine-tuning", "listed"),
    ("PyTorch", "PyTorch", None), ("LLM", "LLMs", None), ("Java", "Java", None), ("JavaScript", "JavaScript", None), (None, "x", None), ("y", None, None),
]
#: A text and the names in it.
CASES = [
    ("REACT native and react", {"React Native", "React"}),
    ("We use C++, c++; C+ and .net/ASP.NET", {"C++", ".NET"}),
    ("go the extra mile, GO, Go-live", set()),
    ("Go, Rust (Go) or Go/Rust", {"Go"}),
    ("golang", {"Go"}),
    ("a safe place, SAFE, SAFety", set()),
    ("SAFe 6 and k8s", {"SAFe", "Kubernetes"}),
    ("JavaScript is not Javax", {"JavaScript"}),
    ("CI/CDs or ci/cd.", {"CI/CD"}),
    ("Fine-tuning Postgres queries", set()),
    ("PyTorch, Fine-tuning, RAG", {"PyTorch", "Fine-tuning"}),
    ("- Fine tuning (LoRA)", {"Fine-tuning"}),
    ("Fine-tuning: tables to cut spend", set()),
    ("model fine-tuning", {"Fine-tuning"}),
    ("fine-tuning of models", {"Fine-tuning"}),
    ("fine-tuning attribution models", set()),
    ("fine-tuning with LLM data", {"Fine-tuning", "LLMs"}),
    ("fine-tuning queries\nLLM", {"LLMs"}),
    ("éReact réactJava réJava", {"React", "Java"}),
    ("", set()),
    (None, set()),
]


@pytest.mark.parametrize("size", [50_000, 3])
def test_names(spark, monkeypatch, size):
    """Expected names, with one tree and with several."""
    monkeypatch.setattr(dictionary, "TREE_TERMS", size)
    terms = spark.createDataFrame(TERMS, "term string, name string, rule string")
    docs = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(CASES)], "doc_id long, text string")
    found = dictionary.find_names(docs, terms, "doc_id", "text", beside=("model", "models"), companions=("PyTorch", "LLMs"))
    got = {r["id"]: set(r["names"]) for r in dictionary.names_by_text(found).collect()}
    assert {k: got.get(k, set()) for k in range(len(CASES))} == {k: names for k, (_, names) in enumerate(CASES)}
    for r in found.collect():
        text = CASES[r["id"]][0]
        assert text[r["begin"] : r["end"]].strip() and not re.match("[A-Za-z0-9_]{2}", text[r["end"] - 1 : r["end"] + 1])


def test_names_without_terms_and_wrong_rules(spark):
    docs = spark.createDataFrame([(1, "Go")], "doc_id long, text string")
    assert dictionary.find_names(docs, spark.createDataFrame([], "term string, name string, rule string"), "doc_id", "text").collect() == []
    with pytest.raises(ValueError, match="sometimes"):
        dictionary.find_names(docs, spark.createDataFrame([("Go", "Go", "sometimes")], "term string, name string, rule string"), "doc_id", "text")


def test_gaps(spark):
    wanted = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 2, "y"), ("a", 3, None), ("b", 4, "x"), ("b", 5, None), ("b", 6, None), (None, 7, "z")], "source string, id long, name string")
    known = spark.createDataFrame([("y",), (None,)], "name string")
    rows = {(r.source, r.place): (r.name, r.texts, r.caveat) for r in dictionary.gaps(wanted, known, "source").collect()}
    assert rows == {("a", 1): ("x", 2, ""), ("b", 1): ("x", 1, "thin-coverage"), (None, 1): ("z", 1, "")}
    nothing = dictionary.gaps(wanted, known.limit(0), "source", limit=1).collect()
    assert {(r.source, r.name, r.caveat) for r in nothing} == {("a", "x", "no-known-names"), ("b", "x", "no-known-names,thin-coverage"), (None, "z", "no-known-names")}


def plain_words(text):
    return [w for w in (re.sub(r"^[.-]+|[.-]+$", "", x) for x in re.findall(phrases.WORD, text.lower())) if w]


TEXTS = ["the cat sat on the cat mat. The cat", "Cat the, c++ and node.js; the the the cat", "", None, "mat the cat sat", "x - y ... z the-cat sat"]
PHRASES = ["the cat", "cat sat", "the the", "c++", "node.js the", "dog", "the dog", "", None, "the the the cat", "mat"]


@pytest.mark.parametrize("most", [200_000, 0])
def test_phrase_hits(spark, monkeypatch, most):
    """Every place of every phrase, with a broadcast vocabulary and with a shuffled one."""
    monkeypatch.setattr(phrases, "BROADCAST_WORDS", most)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    wanted = spark.createDataFrame([(p,) for p in PHRASES + PHRASES[:2]], "phrase string")
    got = sorted(map(tuple, phrases.phrase_hits(docs, wanted, "doc_id", "text").collect()))
    want = []
    for p in {p for p in PHRASES if p}:
        e = plain_words(p)
        for k, text in enumerate(TEXTS):
            w = plain_words(text or "")
            want += [(p, k, i) for i in range(len(w) - len(e) + 1) if w[i : i + len(e)] == e]
    assert got == sorted(want)
    rows = {r.phrase: (r.texts, r.places, r.first_id) for r in phrases.phrase_coverage(docs, wanted, "doc_id", "text").collect()}
    assert rows["dog"] == (0, 0, None) and rows["the the"] == (1, 2, 1) and set(rows) == {p for p in PHRASES if p is not None}


def test_terms(spark):
    texts = ["Build data pipelines, data lakes. Pipelines (kafka) run https://x.example/data now!", "data pipelines <!-- data lakes --> are the data", "Data\npipelines; 2024 salary", "kafka streams"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.term: (r.kind, r.texts) for r in phrases.terms(docs, "doc_id", "text").collect()}
    assert got["data"] == ("word", 3) and got["data pipelines"] == ("phrase", 2) and got["data lakes"] == ("phrase", 1) and got["kafka"] == ("word", 2)
    assert not set(got) & {"pipelines data", "lakes pipelines", "salary", "2024", "are", "x.example"}
    names = spark.createDataFrame([(0, "Kafka"), (2, "Kafka"), (3, "Kafka Streams")], "id long, name string")
    least = {r.term: (r.kind, r.texts) for r in phrases.terms(docs, "doc_id", "text", 2, names).collect()}
    assert least["kafka"] == ("skill", 3) and least["data pipelines"] == ("phrase", 2) and "kafka streams" not in least


def test_telling_terms(spark):
    make = lambda rows: spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    positive = make(["rust services"] * 4 + ["rust grpc"] * 3 + ["java"] * 3)
    baseline = make(["java services"] * 6 + ["go"] * 4)
    entries = spark.createDataFrame([("grpc",)], "phrase string")
    rows = [tuple(r) for r in phrases.telling_terms(positive, baseline, entries, "doc_id", "text").collect()]
    assert rows == [("rust", "word", 7, 0, 3.0), ("rust services", "phrase", 4, 0, 2.32)]


POSTING = """Reports to the Head of Data. You will join the Education Department.
Responsible for the model platform. You will own the roadmap and lead the team.
You will publish a weekly report. Success is measured by KPIs in the first 90 days.
You will work closely with product and engineering. We support the team and help with launches."""


def clarity(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    judged, counts = annotations.role_clarity(docs, "doc_id", "text")
    status = {(r.id, r.point): (r.status, r.evidence) for r in judged.collect()}
    return status, {r.id: r for r in counts.collect()}


def test_role_clarity(spark):
    vague = "Work with stakeholders. Reports to: TBD. Regular updates. As needed, assist with things and contribute to projects."
    status, counts = clarity(spark, POSTING, vague, "", None, "Reports to Jane Doe.", "Key responsibilities:\nThings.", "The first 90 days are onboarding. Annual KPIs decide.")
    assert {p: s for (k, p), (s, _) in status.items() if k == 0} == dict.fromkeys(annotations.ROLE_POINTS, "present")
    assert status[0, "supervisor"][1] == ["Reports to the Head of Data.", "You will join the Education Department."]
    assert {p: s for (k, p), (s, _) in status.items() if k == 1} == {
        "supervisor": "missing", "scope": "missing", "deliverables": "missing", "success": "missing", "coordination": "partial", "cadence": "partial",
    }
    assert counts[1].ask and counts[1].soft_verbs == 3 and counts[1].soft and not counts[0].ask
    assert not counts[2].ask and counts[2].missing == 6 and not counts[3].ask
    assert status[4, "supervisor"][0] == "partial" and status[5, "scope"][0] == "partial" and status[6, "success"][0] == "partial"


def test_long_sentences_are_quoted_around_the_match(spark):
    text = "x " * 400 + "reports to Jane " + "😀 " * 400
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = annotations.annotate(annotations.sentences(docs, "doc_id", "text"), {"r": annotations.ROLE_DETECTORS["reports-to"]}).collect()
    assert len(row.evidence) == annotations.EVIDENCE and "reports to Jane" in row.evidence and row.evidence in text
    assert text[row.begin : row.end] == "reports to Jane"


def test_sentences(spark):
    text = " One. Two!\r\n\n three?four  \n. "
    docs = spark.createDataFrame([(1, text), (2, None), (3, "\n \n")], "doc_id long, text string")
    rows = sorted(annotations.sentences(docs, "doc_id", "text").collect())
    assert [r.text for r in rows] == ["One.", "Two!", "three?four", "."]
    assert all(text[r.begin : r.end] == r.text for r in rows) and [r.sentence for r in rows] == [0, 1, 2, 3]


def test_slices_hold_few_texts():
    texts = ["x" * 10] * 600 + ["y" * (1 << 20)] * 3 + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    cut = list(slices(iter([batch, batch.slice(0, 0)])))
    assert [t for b in cut for t in b.column("text").to_pylist()] == texts
    assert max(b.num_rows for b in cut) == 256 and len(cut) >= 6


def test_terms_of_single_texts_need_no_shuffle_of_texts(spark, capsys):
    rows = [(k, "Data pipelines, data pipelines! Spark jobs <!-- no --> run; c++ c++." if k % 2 else "Spark jobs. data-driven work") for k in range(8)] + [(8, None), (9, "")]
    docs = spark.createDataFrame(rows, "id long, text string")
    none = spark.createDataFrame([], "id long, name string")
    for least in (1, 4, 9):
        got = sorted(tuple(r) for r in phrases.terms(docs, "id", "text", least).collect())
        assert got == sorted(tuple(r) for r in phrases.terms(docs, "id", "text", least, none).collect())
        assert bool(got) == (least < 9)
    phrases.terms(docs, "id", "text", 4).explain("simple")
    assert "hashpartitioning(id" not in capsys.readouterr().out
    twice = phrases.terms(docs.unionByName(docs), "id", "text", 4)
    assert {r["term"]: r["texts"] for r in twice.collect()}["data pipelines"] == 4
