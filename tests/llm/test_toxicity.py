"""The fit against its gradient and known thresholds; held-out accuracy; planted words."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymatch.llm import toxicity

FOLDER = "/root/testdata/sf0.1"


def test_ordinal_fit():
    """Weights and thresholds of a known model come back, thresholds in order."""
    rng = np.random.default_rng(1)
    n, weights, thresholds = 20_000, np.array([2.0, -1.0, 1.0]), np.array([0.5, 2.0])
    ones = rng.random((n, 3)) < 0.5
    latent = ones @ weights + rng.logistic(size=n)
    grades = (latent[:, None] > thresholds).sum(1)
    texts, places = np.nonzero(ones)
    fitted, found = toxicity.fit_ordinal(texts, places, np.ones(len(texts)), grades, np.ones(n), 3)
    assert np.allclose(fitted, weights, atol=0.15) and np.allclose(found, thresholds, atol=0.15)
    up = toxicity.Ordinal(np.zeros(0), fitted, found).at_least(np.linspace(-5, 5, 11))
    assert (np.diff(up, axis=1) <= 0).all() and (np.diff(up, axis=0) > 0).all()


def test_held_out(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", F.col("toxic").cast("int").alias("label"))
    model = toxicity.fit(docs, labels.filter("doc_id % 4 <> 0"))
    held = labels.filter("doc_id % 4 = 0").join(toxicity.severity(docs, model), "doc_id").collect()
    toxic = [r for r in held if r.label]
    clean = [r for r in held if not r.label]
    assert len(toxic) > 30 and len(clean) > 300
    assert np.mean([r.toxic for r in toxic]) > 0.9
    assert np.mean([r.toxic for r in clean]) < 0.01
    assert all(0 <= r.severity <= 2 and r.toxic == (r.p_toxic >= 0.5) for r in held)


def made(rng, n, bad):
    plain = [f"w{k}" for k in range(200)]
    return " ".join(rng.choices(plain, k=n - bad) + rng.choices(["Vile!", "nasty"], k=bad))


def test_planted(documents, spark):
    rng = random.Random(2)
    rows = [(k, made(rng, 60, (k % 4 == 0) * rng.choice([2, 8]))) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)] + [(None, 1), (7, None), (9999, 1)], "doc_id long, label int")
    docs = documents(rows).withColumns({n: F.lit("?") for n in ("label", "keys", "grade", "a.b")})
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    texts = [(1, made(rng, 60, 0)), (2, made(rng, 60, 2)), (3, made(rng, 60, 9)), (4, ""), (5, None), (None, "so nasty, VILE"),
             (6, made(rng, 40_000, 0)), (6, made(rng, 40_000, 0))]
    found = {(r.doc_id, r.toxic) for r in toxicity.severity(documents(texts), model).collect()}
    assert found == {(1, False), (2, True), (3, True), (4, False), (5, False), (None, True), (6, False)}
    assert toxicity.severity(documents(texts).limit(0), model).count() == 0


@pytest.mark.parametrize("label", [None, 0, 1])
def test_nothing_to_learn_from(documents, spark, label):
    docs = documents(["a b", "c"]).select("doc_id", "text")
    labels = spark.createDataFrame([(0, label), (1, label)], "doc_id long, label int")
    assert [r.severity for r in toxicity.severity(docs, toxicity.fit(docs, labels)).collect()] == [0.0, 0.0]


def test_given_grades(documents, spark):
    rng = random.Random(3)
    words = {0: "calm", 1: "rude", 2: "cruel", 3: "vicious"}
    rows = [(k, f"{made(rng, 20, 0)} {words[k % 4]}") for k in range(800)]
    labels = spark.createDataFrame([(k, k % 4) for k in range(800)], "doc_id long, label int")
    docs = documents(rows).select("doc_id", "text")
    found = toxicity.severity(docs, toxicity.fit(docs, labels)).collect()
    assert np.mean([r.grade == r.doc_id % 4 for r in found]) > 0.95
