"""Lexical search, spelling variants and the quality classifier, against plain versions and on odd tables."""

import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402

from sensorloom.llm import factors, lexical, spelling  # noqa: E402
from sensorloom.llm.common import draw, prepare  # noqa: E402


@pytest.fixture(scope="module", autouse=True)
def shared(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    prepare(spark)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(5)
    names = ["an", "Été", "öl", "the", "x1", "ÿard", "Of", "tion", "ß", "word", "straße", "日本"]
    return lambda n: " ".join(rng.choice(names) + rng.choice(["", "s", "-", "!!", "\t"]) for _ in range(n))


def test_lexical_search(spark, prose):
    texts = [None, "", " ,;\n", "the", "THE the", *(prose(n) for n in range(3, 60)), prose(30_000)]
    texts += [texts[9]] * 20  # equal scores go by id
    docs = [(i * 7 % 101, t, 1, "x") for i, t in enumerate(texts)] + [(None, "the of", 1, "x"), (7, texts[9], 1, "x")]
    items = [(i, prose(2 + i % 9)) for i in range(30)] + [(30, None), (31, ""), (32, "nowhere"), (3, "the THE"), (None, "of")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score long, item string").repartition(4)
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = brute.ranked([d[:2] for d in docs], items, 7)
    ask = lambda d, q, **more: sorted(map(tuple, lexical.rank(d, "doc_id", "text", q, "item_id", "text", k=7, **more).collect()))
    assert ask(frame, asked) == want
    # Several blocks of items give the same rows.
    assert ask(frame, asked, block_terms=20) == want
    assert ask(frame.where("doc_id < 0"), asked) == ask(frame, asked.where("item_id < 0")) == []


def test_shared_sums_equal_plain_ones():
    rng = np.random.default_rng(2)
    uses = rng.random((60, 25)) < 0.3
    uses[:10, :] = uses[0]  # terms that always stand together
    uses[:, uses.any(0).argmin()] |= rng.random(60) < 0.5
    parts, rest = lexical.mine(uses)
    assert parts and rest.sum() + sum(map(len, parts)) < uses.sum()
    item, term = np.nonzero(uses.T)
    table = pa.table({"block": pa.array([0] * len(item), pa.int32()), "item": pa.array(item), "term": pa.array([f"t{t:02d}" for t in term])})
    rows = [type("Row", (), r) for r in lexical._shared(table).to_pylist()]
    names, graph = lexical._graph(rows)
    value = rng.integers(0, 1 << 40, (60, 3))
    acc = np.zeros((graph.n_nodes, 3), np.int64)
    acc[: len(names)] = value[[int(x[1:]) for x in names]]
    assert (graph.scores(acc) == uses.T[graph.items].astype(np.int64) @ value).all()
    # Each shared sum is made once, from sums made before it.
    assert len(graph.levels) > 1 and all((p < first).all() for first, p, _ in graph.levels)


def test_terms_of_long_texts_are_not_cut(monkeypatch, prose):
    text = prose(500)
    want = [x.encode() for x in brute.TERM.findall(text.translate(brute.LOWER))]
    monkeypatch.setattr(lexical, "CHUNK", 16)
    assert [x for part in lexical.terms_of(text) for x in part] == want
    monkeypatch.setattr(spelling, "CHUNK", 16)
    assert Counter(x.decode("latin-1") for part in spelling.runs_of(text) for x in part) == brute.slips([(0, text)], 1 << 40)


def test_word_counts_with_slips(spark, monkeypatch):
    rng = random.Random(9)
    names = ["aabbaa", "ÀÉcole", "word×word", "straße", "naïveté", "Überall", "abc", "zürich", "日本zurich", "a1bcdefg"]
    texts = [" ".join(rng.choices(names, k=rng.randint(0, 30))) for _ in range(400)] + [None, "", "!?"]
    docs = [(i if i % 50 else None, t, i) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, n int").repartition(3)
    counts = brute.slips([d[:2] for d in docs], 7)
    want = {(w, n) for w, n in counts.items() if len(w) >= 6 and n >= 5}
    assert len(want) > 10 and {tuple(r) for r in spelling.words(frame, "doc_id", "text", every=7).collect()} == want
    monkeypatch.setattr(spelling, "HELD", 3)
    assert {tuple(r) for r in spelling.words(frame, "doc_id", "text", every=7).collect()} == want
    assert spelling.group(frame.where("doc_id < 0"), "doc_id", "text").count() == 0


def test_spelling_variants(spark):
    rng = random.Random(4)
    counts = {"aaaaaa": 7, "aaaaaaa": 50, "aaaaaaaa": 400, "aabaaa": 7, "abcdef": 5, "abcdefg": 30, "bcdefg": 200, "bbcdefg": 1100, "étéété": 9, "eteete": 50}
    while len(counts) < 400:
        counts.setdefault("".join(rng.choices("abé", k=rng.randint(6, 8))), rng.choice([5, 6, 30, 30, 160, 900]))
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    found = {tuple(r) for r in spelling.variants(frame).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert found == brute.variants(counts, 5)
    assert any(root not in (word, form) for word, form, root, *_ in found)


def test_scan_carries_groups_over_batches(spark):
    counts = {"abcdef": 5, "abcdeg": 50, "abcdeh": 6, "abcde": 7}
    rows = sorted(spelling.rotations(spark.createDataFrame(list(counts.items()), "word string, n long")).collect())
    one = lambda r: pa.RecordBatch.from_pylist([r.asDict()])
    parts = list(spelling._scan(map(one, rows)))
    found = [tuple(r.values()) for b in parts for r in b.to_pylist()]
    assert ("abcdef", 3, 50, "abcdeg") in found and ("abcde", 3, 50, "abcdeg") in found and ("abcdeg", 3, 7, "abcde") in found


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(900):
        text = " ".join(word() for _ in range(rng.randint(5, 60)))
        bad = i % 5 == 0
        if bad:
            text = rng.choice([text.upper(), text.replace(" ", "$$ "), " ".join([word()] * 40)])
        rows.append((i, text, len(text) if i % 3 else None, "x"))
        if i % 2 or bad:
            labels.append((i, int(not bad)))
    rows += [(900, None, 3, "x"), (901, "", None, "x"), (902, " \n", -5, "x"), (903, "long " * 300_000, 1, "x"), (None, "text", 1, "x")]
    schema = "doc_id long, text string, n_chars long, predicted string"
    return spark.createDataFrame(rows, schema).repartition(3), spark.createDataFrame([*labels, (1, None), (5, 7), (4444, 1)], "doc_id long, quality int")


def test_quality_classifier(graded):
    docs, labels = graded
    hidden, size = factors.held_out(F.col("doc_id")), F.col("n_chars")
    model = factors.fit(docs.where(~hidden), "doc_id", "text", size, labels, "doc_id", "quality", sample_texts=200)
    found = factors.classify(docs, "doc_id", "text", size, model)
    assert found.columns == ["doc_id", "score", "predicted"] and found.count() == docs.count()
    rows = {r.doc_id: r for r in found.collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    truth = {r.doc_id: r.quality for r in labels.join(docs.where(hidden), "doc_id").where("quality in (0, 1)").collect()}
    assert len(truth) > 100 and sum(rows[i].predicted == q for i, q in truth.items()) >= 0.97 * len(truth)
    # Learned again, on rows in another order, the model is the same.
    again = factors.fit(docs.where(~hidden).repartition(7), "doc_id", "text", size, labels, "doc_id", "quality", sample_texts=200)
    assert np.allclose(again.factors, model.factors) and np.allclose(again.edges, model.edges)


def test_classifier_without_labels(graded):
    docs, labels = graded
    size = F.col("n_chars")
    assert factors.fit(docs, "doc_id", "text", size, labels.where("quality is null"), "doc_id", "quality") is None
    assert {(r.score, r.predicted) for r in factors.classify(docs, "doc_id", "text", size, None).collect()} == {(0.5, 1)}
    assert factors.classify(docs.where("doc_id < 0"), "doc_id", "text", size, None).count() == 0
    one = factors.fit(docs, "doc_id", "text", size, labels.where("quality = 0"), "doc_id", "quality", steps=30)
    assert all(r.predicted == 0 for r in factors.classify(docs.limit(20), "doc_id", "text", size, one).collect())


def test_pairs_by_sum_of_squares():
    rng = np.random.default_rng(1)
    edges = np.sort(rng.random((3, factors.BINS - 1)), axis=1)
    n = factors.BUCKETS + 3 * factors.BINS
    model = factors.Model(edges, 0.3, rng.normal(size=n), rng.normal(size=(n, factors.FACTORS)) / 5)
    at, value = [np.array([3, 70, 900], np.int32), np.zeros(0, np.int32)], [np.array([0.2, 0.5, 0.4], np.float32), np.zeros(0, np.float32)]
    rows = model.rows(at, value, rng.random((2, 3)))
    for i, got in enumerate(model.score(rows)):
        mine = slice(rows.start[i], [*rows.start, len(rows.at)][i + 1])
        x, f = rows.value[mine], rows.at[mine]
        pairs = sum(x[a] * x[b] * model.factors[f[a]] @ model.factors[f[b]] for a in range(len(x)) for b in range(a))
        assert abs(got - 1 / (1 + np.exp(-(0.3 + model.weights[f] @ x + pairs)))) < 1e-6


def test_drawing_is_bounded_whatever_the_copies(spark):
    rows = spark.createDataFrame([(0, 5)] * 3000 + [(0, i * 10**15) for i in range(3000)] + [(1, i) for i in range(3)], "label int, h long")
    drawn, counted = draw(rows, 200)
    assert counted == {0: 3000 + 1, 1: 3} and Counter(r.label for r in drawn.collect()) == {0: 100, 1: 3}
