"""Against brute force over all windows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallymatch.llm import substring_dedup, words

FOLDER = "/root/testdata/sf0.001"


def brute(rows, window=20):
    """(doc_id, kept text, n_words, n_removed) for each row."""
    split = [(-(1 << 63) if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, ws in split:
        for p in range(len(ws) - window + 1):
            key = tuple(ws[p : p + window])
            first[key] = min(first.get(key, (i, p)), (i, p))
    out = []
    for (given, _), (i, ws) in zip(rows, split):
        gone = set()
        for p in range(len(ws) - window + 1):
            if first[tuple(ws[p : p + window])] < (i, p):
                gone.update(range(p, p + window))
        kept = [w for p, w in enumerate(ws) if p not in gone]
        out.append((given, " ".join(kept), len(ws), len(gone)))
    return sorted(out, key=str)


def ours(docs):
    return sorted(map(tuple, substring_dedup.remove_repeats(docs).collect()), key=str)


def test_cover():
    assert {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER} == set(range(13))


def test_planted(documents):
    random.seed(5)
    vocabulary = [f"w{k}é" for k in range(300)]
    passages = [random.choices(vocabulary, k=n) for n in (19, 20, 21, 33, 60, 200)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(random.randrange(6)):
            parts += random.choice(passages) if random.random() < 0.5 else random.choices(vocabulary, k=random.randrange(40))
        texts.append("".join(w + random.choice([" ", "\n", "\t  "]) for w in parts))
    texts += [texts[3], "", None, "  \n", "one", " ".join(["same"] * 100), "x" * 70_000 + " " + " ".join(passages[4])]
    rows = list(enumerate(texts)) + [(2, texts[2]), (5, " ".join(passages[5])), (None, " ".join(passages[4]))]
    assert ours(documents(rows)) == brute(rows)


def test_given_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert ours(docs) == brute(rows)


def test_empty_and_clashing_columns(documents):
    docs = documents(["a b", "c"])
    assert ours(docs.limit(0)) == []
    clashing = docs.withColumns({name: F.lit("?") for name in ("key", "pos", "known", "hits", "marks", "a.b", "n", "kept")})
    assert ours(clashing) == ours(docs)


@pytest.mark.parametrize("texts", [[""], ["", "a", "", "b c"], ["é à", "a" * 200_000 + " b"], [" a", "b ", "c"]])
def test_words(texts):
    import numpy as np
    import pyarrow as pa

    data, offsets = words.raw(pa.array(texts))
    found = words.Words(data, offsets)
    assert found.counts.tolist() == [len(t.split()) for t in texts]
    assert found.joined(np.ones(len(found), bool)) == [" ".join(t.split()).encode() for t in texts]
    hashes = found.hashes()
    assert len(set(hashes.tolist())) == len({w for t in texts for w in t.split()})
