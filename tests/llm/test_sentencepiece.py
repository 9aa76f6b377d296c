"""Against the library with the same pieces as a unigram model, plain dynamic programming, and the round trip."""

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import numpy as np

from tallymatch.llm import sentencepiece_viterbi as viterbi

FOLDER = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
OWN = viterbi.Vocabulary(MODEL)


def ids(text):
    return np.frombuffer(OWN.encode(text), "<u4").tolist()


@pytest.fixture(scope="module")
def unigram():
    """The library's search over the same pieces: the model file with its type set to unigram."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    proto.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def test_against_library(unigram, spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect()
    texts = [sentence for r in docs[:60] for sentence in r.text.split("\n")[:5]]
    texts += ["", " ", "  two  blanks ", "naïve 中文 字 🙂🙂", "tab\tand\nline", "a" * 300, "=" * 70, "é" * 50, "<s> </s> <0x41>"]
    total = lambda own: sum(unigram.get_score(k) for k in own if not unigram.is_byte(k))
    equal = 0
    for text in filter(None, texts):
        own, theirs = ids(text), unigram.encode(text)
        assert unigram.decode(own) == text
        # The library's search settles for less now and then; none of its cuts has a greater sum.
        if sum(map(unigram.is_byte, own)) == sum(map(unigram.is_byte, theirs)):
            assert total(own) >= total(theirs), text
        equal += own == theirs
    assert equal > 50


def plain(text):
    """The best sum over all cuts, and its pieces."""
    text = viterbi.BLANK + text.replace(" ", viterbi.BLANK)
    best = [(0.0, [])] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - OWN.longest), end):
            piece = text[start:end]
            score = OWN.scores.get(piece, OWN.unknown if end == start + 1 else None)
            if score is not None and (best[end] is None or best[start][0] + score > best[end][0]):
                best[end] = best[start][0] + score, [*best[start][1], piece]
    return best[-1][1]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(" ethanios=-ü中"), min_size=1, max_size=40))
def test_against_plain_search(text):
    expected = []
    for piece in plain(text):
        expected += [OWN.ids[piece]] if piece in OWN.ids else [OWN.bytes[b] for b in piece.encode()]
    assert ids(text) == expected


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("theanio="), min_size=200, max_size=900))
def test_streaming_settles_early(text):
    """The pieces are the same whether or not anything was settled on the way."""
    found = list(OWN.pieces_of(text))
    assert "".join(found) == text
    kept, viterbi.SETTLE = viterbi.SETTLE, 10**9
    try:
        assert found == list(OWN.pieces_of(text))
    finally:
        viterbi.SETTLE = kept


def test_window_is_bounded():
    """After a text of 200,000 characters without a blank the state is that of a few windows."""
    sizes = []
    path = OWN._path
    OWN._path = lambda text, back, base, end: (sizes.append(len(back)), path(text, back, base, end))[1]
    try:
        assert "".join(OWN.pieces_of("thereandback" * 17_000)) == "thereandback" * 17_000
    finally:
        del OWN._path
    assert len(sizes) > 100 and max(sizes) < 20 * OWN.longest


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    assert OWN.decode(OWN.encode(text)) == text


def test_tables(spark, documents):
    found = viterbi.op7_sentencepiece(spark, FOLDER).collect()
    assert len(found) == 200 and all(r.same and r.n_tokens > 0 for r in found)
    rows = [(1, None), (None, ""), (2, "a ▁ b"), (2, "a ▁ b"), (3, "x" * 50_000)]
    docs = documents(rows).withColumns({name: F.lit("?") for name in ("ids", "decoded", "a.b")})
    back = viterbi.decode(viterbi.encode(docs, MODEL), MODEL)
    assert sorted(back.select("doc_id", "decoded").collect(), key=str) == sorted(rows, key=str)
    assert viterbi.encode(docs.limit(0), MODEL).count() == 0
