"""Against brute force over all pairs."""

import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallymatch.llm import graph, ngram_join

FOLDER = "/root/testdata/sf0.001"


def shingles(text, size=5):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(ws[p : p + size]) for p in range(max(1, len(ws) - size + 1))} if ws else set()


def brute(rows, threshold=Fraction(4, 5)):
    own = [shingles(t) for _, t in rows]
    root, n = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(own[i] & own[j])
            if own[i] and own[j] and Fraction(both, len(own[i] | own[j])) >= threshold:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    low = lambda i: -(1 << 63) if i is None else i
    classes = {}
    for k, (i, _) in enumerate(rows):
        classes[find(k)] = min(classes.get(find(k), i), i, key=low)
    return sorted(((i, classes[find(k)], n[k]) for k, (i, _) in enumerate(rows)), key=str)


def ours(docs, **options):
    found = ngram_join.near_duplicates(docs, **options)
    return sorted(map(tuple, found.select("doc_id", "class_id", "n_links").collect()), key=str)


def varied(random, words, changes):
    words = list(words)
    for _ in range(changes):
        words[random.randrange(len(words))] = f"new{random.randrange(1000)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(5, 90))) for _ in range(40)]
    for n, changes in ((150, 1), (120, 2), (200, 5), (60, 1)):
        base = rng.choices(vocabulary, k=n)
        texts += [varied(rng, base, rng.randrange(changes + 1)) for _ in range(25)]
    texts += ["", None, "one", "one", "a b c d", "a b c d", "a b c e", "a b c d e", "a  b\nc d e", "x " * 500, "x " * 700]
    out = [(7 * k, t) for k, t in enumerate(texts)]
    return out + [(7, texts[1]), (14, "quite another text than the row above has"), (None, texts[45])]


def test_planted(documents, rows):
    assert ours(documents(rows)) == brute(rows)


def test_blocks(documents, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 4)
    assert ours(documents(rows)) == brute(rows)


def test_lower_threshold(documents, rows):
    found = ours(documents(rows), threshold=Fraction(1, 2), trees=64)
    assert found == brute(rows, Fraction(1, 2))


def test_given_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert ours(docs) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_empty_and_clashing_columns(documents):
    docs = documents(["a b c d e f", "a b c d e f", "g"])
    assert ours(docs.limit(0)) == []
    names = ("one", "two", "size", "keys", "node", "cluster", "n", "least", "copies", "tree", "class_id", "a.b")
    clashing = docs.withColumns({name: F.lit("?") for name in names})
    assert ours(clashing) == ours(docs) == [(0, 0, 1), (1, 0, 1), (2, 2, 0)]


def test_depth():
    assert ngram_join.depth() == 6
    assert ngram_join.depth(trees=8, recall=0.99) == 3
    assert ngram_join.depth(trees=1, threshold=0.5, recall=0.999) == 1


def test_components(spark, stage):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)]
    edges += [(500, k) for k in range(501, 700)] + [(9, 9)]
    found = dict(graph.components(spark.createDataFrame(edges, "a long, b long"), stage).collect())
    root = {}
    for a, b in edges:
        if a != b:
            root.setdefault(a, a)
            root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    assert found == root
