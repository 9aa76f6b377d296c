"""Against the tokenizer over whole texts, a plain best-fit search, and the rules of a packing."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallymatch.llm import packing

FOLDER = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(VOCABULARY)
TOKENS = packing.Tokens(VOCABULARY)


def encoded(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" \n\t\x0b\x1c\x85\xa0 aZé'stDß.,1²中́ΣςİÀÿ×º_<|endoftext|>"), max_size=60))
def test_word_by_word(text):
    assert np.frombuffer(TOKENS.of(text), "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_letters():
    for letter in packing.LETTERS:
        for text in (letter, f"a{letter}", f"{letter}a.", f"x{letter}y's"):
            assert np.frombuffer(TOKENS.of(text), "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_bounded_memory(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    tokens = packing.Tokens(VOCABULARY)
    for text in ["one two, three. four five six", "one seven eight! nine", "Two ten; Ten 11 it's"] * 3:
        assert np.frombuffer(tokens.of(text), "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit(lengths):
    most, rooms, plain = 50, [], []
    for piece in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fitting = [(room, k) for k, room in enumerate(rooms) if room >= lengths[piece]]
        if fitting:
            least = min(room for room, _ in fitting)
            rooms[next(k for room, k in fitting if room == least)] -= lengths[piece]
        else:
            rooms.append(most - lengths[piece])
    found = packing.best_fit(lengths, most)
    assert sorted(k for sequence in found for k in sequence) == list(range(len(lengths)))
    # Which of two sequences with equal room takes a piece makes no difference to the rooms.
    assert sorted(most - sum(lengths[k] for k in sequence) for sequence in found) == sorted(rooms)


def check(pieces, rows, most):
    """Each id of each document in one piece, each sequence gapless and not over its length; the number of sequences."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
        by_doc[p.doc_id, p.doc_tokens].append(p)
    for sequence in by_sequence.values():
        at = 0
        for offset, length in sorted(sequence):
            assert offset == at and length > 0
            at += length
        assert at <= most
    expected = defaultdict(list)
    for doc_id, text in rows:
        ids = encoded(text)
        for start in range(0, len(ids), most):
            own = np.array(ids[start : start + most], "<u4")
            expected[doc_id, len(ids)].append((start, len(own), zlib.crc32(own.tobytes())))
    got = {key: sorted((p.start, p.length, p.ids_crc32) for p in found) for key, found in by_doc.items()}
    assert got == {key: sorted(found) for key, found in expected.items()}
    return len(by_sequence)


@pytest.mark.parametrize("block", [300, 1 << 20])
def test_planted(documents, block):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["the", "Cat,", "naïve", "x9"], k=rng.choice([1, 5, 20, 90, 400]))) for _ in range(150)]
    rows = [*enumerate([*texts, "", None, "a" * 9000, " \n "]), (3, texts[3]), (None, "null id"), (None, None)]
    found = packing.digest(packing.pack(documents(rows).coalesce(2), VOCABULARY, most=128, block=block))
    check(found.collect(), rows, 128)


def test_given_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    n = check(packing.op1_packing(spark, FOLDER).collect(), rows, packing.LENGTH)
    total = sum(len(encoded(text)) for _, text in rows)
    assert n <= total / packing.LENGTH * 1.02 + 1


def test_empty_and_clashing_columns(documents):
    docs = documents(["a b", None])
    assert packing.pack(docs.limit(0), VOCABULARY).count() == 0
    clashing = docs.withColumns({name: F.lit("?") for name in ("start", "ids", "offset", "sequence_id", "a.b")})
    assert packing.digest(packing.pack(clashing, VOCABULARY)).count() == 2
