"""Against plain counting, and what is rejected and kept."""

import math
import random
import re
from collections import Counter

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallymatch.llm import quality

FOLDER = "/root/testdata/sf0.01"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def brute_repeated(own):
    windows = Counter(tuple(own[p : p + 8]) for p in range(len(own) - 7))
    return len({q for p in range(len(own) - 7) if windows[tuple(own[p : p + 8])] > 1 for q in range(p, p + 8)})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60))
def test_repeated_words(own):
    assert quality.repeated_words(own) == brute_repeated(own)


def brute(text):
    text = text or ""
    own = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if line.strip("\x20\x09\x0a\x0b\x0c\x0d")]
    repeated = brute_repeated(own)
    ids = [i for word in own for i in brute.model.encode(word)]
    share = [n / len(ids) for n in Counter(ids).values()]
    return {
        "n_words": len(own),
        "word_chars": sum(map(len, own)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated,
        "base_failed": len(own) < 20 or 100 * repeated > 30 * len(own),
        "n_tokens": len(ids),
        "entropy": -sum(p * math.log2(p) for p in share),
        "byte_share": sum(brute.model.is_byte(i) for i in ids) / len(ids) if ids else None,
    }


brute.model = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def same(found, text):
    for name, value in brute(text).items():
        assert found[name] == value or abs(found[name] - value) < 1e-9, (name, found)


def test_given_tables(spark):
    found = {r.doc_id: r for r in quality.op2_quality_rules(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(docs) == len(found)
    for doc in docs:
        same(found[doc.doc_id], doc.text)
        assert not (found[doc.doc_id].base_failed and found[doc.doc_id].kept)
    # Clean documents, as the labels have them, stay.
    clean = spark.read.parquet(f"{FOLDER}/labels.parquet").filter("quality = 1").collect()
    passed = [found[r.doc_id] for r in clean if not found[r.doc_id].base_failed]
    assert len(passed) > 100 and all(r.kept for r in passed)


def test_planted(documents):
    prose = "It was a bright cold day in April and the clocks were striking thirteen while he walked slowly home again"
    russian = "Все счастливые семьи похожи друг на друга каждая несчастливая семья несчастлива по своему и это давно известно нам всем друзья"
    hexes = " ".join(f"{k * 7919:x}{k * 104729:x}{k * 1299709:x}" for k in range(1, 60))
    noise = " ".join(f"{word}#$%" for word in prose.split() * 3 + [f"x{k}" for k in range(60)])
    emoji = " ".join(chr(0x1F300 + k) * 5 for k in range(200))
    texts = [prose, russian, hexes, noise, emoji, "", None, "short", "a b " * 200, "\x1c \x85 " * 30, "x" * 300_000]
    docs = documents(texts).withColumn("lang", F.when(F.col("doc_id") == 1, None).otherwise("en"))
    found = quality.measure(docs.unionAll(docs), MODEL).collect()
    assert len(found) == 2 * len(texts)
    for row in found:
        same(row, texts[row.doc_id])
    assert {r.doc_id for r in found if r.kept} == {0, 1}


def plain_verdict(found, text):
    """The verdict from its definition, on the measures that ``same`` has checked."""
    if found["base_failed"] or not found["n_tokens"]:
        return False
    band, spare = quality.BANDS[found["band"]], min(60, 0.5 * found["n_words"])
    chars, n = found["word_chars"], found["n_tokens"]
    bytes_ = sum(brute.model.is_byte(i) for word in re.findall(r"[^\x20\x09-\x0D]+", text or "") for i in brute.model.encode(word))
    few = n - spare <= chars / band.least_chars and n - spare <= band.most_tokens * found["n_words"]
    return few and chars <= band.most_chars * n and bytes_ <= band.most_bytes * n + 8 and found["entropy"] >= band.least_entropy * min(math.log2(n), 10)


def test_verdicts(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    for row in quality.op2_quality_rules(spark, "/root/testdata/sf0.001").collect():
        assert row.kept == plain_verdict(row, docs[row.doc_id])


def test_short_junk(documents):
    """Junk of 20 to 40 words is rejected, prose of that length with an address and a few signs is kept."""
    rng = random.Random(2)
    junk = [" ".join(f"{rng.randrange(16**6):06x}" for _ in range(n)) for n in (20, 30, 40)]
    junk += [" ".join([chr(0x1F300 + k) for k in range(n)] + ["the", "cat", "sat", "on", "a", "mat"]) for n in (14, 20, 30)]
    junk += [" ".join(rng.choice(["$#", "%&*", "|<>", "@@@!"]) * 3 for _ in range(n)) for n in (20, 40)]
    prose = "It was a bright cold day in April and the clocks were striking thirteen while he walked slowly home again"
    fine = [f"{prose} and wrote to j.smith@example.org", f"{prose} 😀", f"See https://example.org/a/b?c=1 where {prose}", f"{prose}, Größe 12 m²"]
    texts = junk + fine
    found = quality.measure(documents(texts).withColumn("lang", F.lit("en")), MODEL).collect()
    assert {r.doc_id for r in found if r.kept} == set(range(len(junk), len(texts)))


def test_empty_and_clashing_columns(documents):
    docs = documents([(None, "a b"), (1, None)])
    assert quality.measure(docs.limit(0), MODEL).count() == 0
    clashing = docs.drop("lang").withColumns({name: F.lit("?") for name in ("kept", "band", "n_words", "a.b")})
    assert sorted(r.n_words for r in quality.measure(clashing, MODEL).collect()) == [0, 2]
