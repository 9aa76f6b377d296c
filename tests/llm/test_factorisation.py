"""The linear-time sum against all pairs, the fit against its gradient's aim, accuracy on held-out labels."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallymatch.llm import factorisation, words

FOLDER = "/root/testdata/sf0.01"
LABELS = "doc_id long, label int"


def of(texts, n_chars=None):
    return factorisation.features(*words.raw(pa.array(texts, pa.string())), n_chars or [len(t or "") for t in texts])


def test_all_pairs():
    """Sum of squares against the sum over all pairs, text by text."""
    texts = ["The cat sat.\nThe cat sat.", None, "", "ÖL 123 $$$ !!", "x " * 500, "a\x1cb \t c" * 30]
    rng = np.random.default_rng(5)
    machine = factorisation.Machine(
        rng.normal(size=1), rng.normal(size=factorisation.FEATURES), rng.normal(size=(factorisation.FEATURES, factorisation.RANK))
    )
    text, place, value = of(texts)
    found = machine.raw(text, place, value, len(texts))
    for k in range(len(texts)):
        p, x = place[text == k], value[text == k]
        assert len(set(p.tolist())) == len(p)
        expected = machine.bias[0] + (machine.weights[p] * x).sum()
        for i in range(len(p)):
            for j in range(i):
                expected += machine.vectors[p[i]] @ machine.vectors[p[j]] * x[i] * x[j]
        assert found[k] == pytest.approx(expected)


def test_texts_apart_or_together():
    """A text has the same features whatever stands beside it."""
    texts = ["One two, two.\n\nOne", "", None, "AAA &&& 9", "no end"]
    text, place, value = of(texts)
    for k, own in enumerate(texts):
        _, p, v = of([own])
        assert p.tolist() == place[text == k].tolist() and np.allclose(v, value[text == k])


def test_interactions_are_learnt():
    """A label that depends on two features together, not on either: no linear model can tell."""
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 2, (2, 4000))
    place = np.stack([a, 2 + b], 1).reshape(-1)
    first, value = np.arange(0, 8001, 2), np.ones(8000)
    machine = factorisation.fit_rows(first, place, value, (a ^ b).astype(float), np.ones(4000), 4)
    likely = factorisation.logistic(machine.raw(np.repeat(np.arange(4000), 2), place, value, 4000))
    assert ((likely > 0.5) == (a ^ b)).mean() > 0.99


def test_held_out_accuracy(spark):
    found = factorisation.op13_factorisation(spark, FOLDER)
    rows = {r.doc_id: r for r in found.collect()}
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").filter("quality is not null").collect()
    held = [(rows[r.doc_id], r.quality) for r in labels if rows[r.doc_id].held_out]
    assert len(held) > 60
    assert np.mean([row.predicted == label for row, label in held]) > 0.95
    assert np.mean([row.predicted for row, label in held if label == 1]) > 0.95


def test_labels_of_held_out_rows_do_not_count(spark, documents):
    rows = [(i, "good words here" if i % 3 else "BAD!! $$$ #$%") for i in range(300)]
    docs = documents(rows)

    def labels(flip):
        held = {i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2}
        return spark.createDataFrame([(i, int(i % 3 > 0) ^ int(flip and i in held)) for i in range(300)], LABELS)

    scores = [sorted(factorisation.score(docs, factorisation.fit(docs, labels(flip))).collect()) for flip in (False, True)]
    assert scores[0] == scores[1]
    assert all((r.score > 0.5) == (r.doc_id % 3 > 0) for r in scores[0])


def test_cases(spark, documents):
    rows = [(1, "good words"), (1, "good words"), (2, None), (3, ""), (None, "BAD!!"), (4, "BAD!! " * 200_000), (5, "BAD!!")]
    docs = documents(rows)
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (4, 0), (5, 0), (None, 1), (2, None), (99, 1), (3, 1)], LABELS)
    machine = factorisation.fit(docs, labels)
    found = factorisation.score(docs, machine).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id == 1}) == 1
    assert not [r for r in found if r.doc_id is None][0].held_out
    clashing = docs.withColumns({n: F.lit("?") for n in ("label", "labels", "own", "places", "values", "held_out", "score", "a.b")})
    again = factorisation.score(clashing, factorisation.fit(clashing, labels)).collect()
    assert sorted(again, key=str) == sorted(found, key=str)
    assert factorisation.score(docs.limit(0), machine).count() == 0
    for few in (labels.limit(0), labels.filter("doc_id = 4")):
        assert {r.score for r in factorisation.score(docs, factorisation.fit(docs, few)).collect()} == {0.5}
    without = docs.drop("n_chars")
    assert factorisation.score(without, factorisation.fit(without, labels)).count() == len(rows)
