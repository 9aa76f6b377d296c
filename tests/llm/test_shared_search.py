"""Against plain scores of all pairs; the graph of sums against direct sums; the given tables against SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymatch.llm import shared_search

FOLDER = "/root/testdata/sf0.001"
ITEMS = "item_id long, text string"


def terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute(items, docs, most=50):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    having = Counter(t for _, c in counts for t in c)
    rows = []
    for item, text in items:
        scores = []
        for i, own in counts:
            if own:
                m = 100 - 50 + (50 * own.total() * n_docs) // total
                score = sum(
                    math.floor(1000 * math.log((2 * n_docs + 2) / (2 * having[t] + 1)))
                    * (1_000_000_000 * own[t] // (1000 * own[t] + 20 * m))
                    for t in set(terms(text))
                    if own[t]
                )
                if score > 0:
                    scores.append((-score, -(1 << 63) if i is None else i, i))
        rows += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(sorted(scores, key=lambda x: x[:2])[:most], 1)]
    return sorted(rows, key=str)


@pytest.fixture
def items(spark):
    return lambda rows: spark.createDataFrame(rows, ITEMS)


def same(found, expected):
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()), key=str) == expected


@pytest.mark.parametrize("postings", [10, 200_000])
def test_planted(documents, items, postings):
    """A few terms a plan splits queries over plans; all sizes give the same."""
    rng = random.Random(1)
    vocabulary = ["the", "The", "öl", "cat", "x1", "中文", "dog's", "of", "a-b", "z_z"] + [f"w{n}" for n in range(30)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(60)))) for i in range(300)]
    docs += [(300 + i, docs[7][1]) for i in range(80)] + [(500, None), (501, ""), (502, " .,; "), (None, "the cat öl"), (7, docs[7][1])]
    asked = [(i, " ".join(rng.choices(vocabulary, k=12)) + " the of cat") for i in range(12)]
    asked += [(20, None), (21, ""), (22, "?!"), (23, "absent words only"), (3, "cat"), (None, "öl the"), (24, docs[7][1])]
    same(shared_search.search(items(asked), documents(docs), postings=postings, most=20), brute(asked, docs, 20))


def test_long_texts(documents, items):
    rng = random.Random(2)
    docs = [(i, " ".join(f"t{rng.randrange(3000)}" for _ in range(30_000))) for i in range(3)] + [(9, "t1 " * 200_000), (10, "y" * 10**6 + " t2")]
    asked = [(0, " ".join(f"t{n}" for n in range(2500))), (1, "t1 t2"), (2, "Y" * 10**6)]
    same(shared_search.search(items(asked), documents(docs), postings=1000), brute(asked, docs))


def test_empty_and_clashing(documents, items):
    docs, asked = documents(["a b", "b c", "a"]), items([(1, "a b"), (2, "c")])
    clashing = {n: F.lit("?") for n in ("row", "n", "terms", "counts", "score", "rank", "plan", "part", "a.b")}
    rows = [shared_search.search(i, d).collect() for i, d in ((asked, docs), (asked.withColumns(clashing), docs.withColumns(clashing)))]
    assert sorted(rows[0]) == sorted(rows[1]) and len(rows[0]) == 4
    assert shared_search.search(asked.limit(0), docs).count() == 0
    assert shared_search.search(asked, docs.limit(0)).count() == 0


def test_graph():
    """Sums along the graph are the sums of the terms, and shared sets are added once."""
    rng = np.random.default_rng(3)
    common = [np.unique(rng.integers(0, 400, 60)) for _ in range(4)]
    own = [np.unique(np.concatenate([common[k % 4], rng.integers(0, 2000, 10)])) for k in range(80)]
    item = np.repeat(np.arange(80), [len(x) for x in own])
    key = np.concatenate(own).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    plan = shared_search.Plan.unpacked(shared_search.mine(item, key, np.arange(80), np.arange(80)).packed())
    value = rng.integers(0, 1 << 40, (len(plan.terms), 5))
    term, doc = (x.ravel() for x in np.indices(value.shape))
    scores = plan.scores(plan.leaf[term], doc, value.ravel(), 5)
    expected = [value[np.searchsorted(plan.terms, key[item == k])].sum(0) for k in range(80)]
    assert np.array_equal(scores, expected)
    additions = len(plan.left) + len(plan.nodes) - 80
    assert additions < 0.25 * (len(item) - 80)
    # No pair of neighbours is left that two queries share.
    assert not len(shared_search.picked(np.repeat(np.arange(80), np.diff(plan.first)), plan.nodes)[0])


def test_given_tables(spark):
    found = shared_search.op12_shared_search(spark, FOLDER)
    connection = duckdb.connect()
    for name in ("documents", "benchmark"):
        connection.sql(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    expected = connection.sql(shared_search.OP12_SQL)
    assert found.columns == expected.columns and dict(found.dtypes)["rank"] == "int"
    assert sorted(map(tuple, found.collect())) == sorted(expected.fetchall())
