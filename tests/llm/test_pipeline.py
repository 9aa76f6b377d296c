"""Each stage of the pipeline on what the one before kept, against brute force; the whole run against the stages."""

import public_tokenizers
import pytest
import test_line_dedup
import test_ngram_join
import test_packing
import test_substring_dedup
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tallymatch.llm import packing, quality

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """The rows that each stage but the last gives, by name; first the documents themselves."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [("documents", docs.collect())]
    for name, step in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path_factory.mktemp("stages") / name)
        step(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == corpus_pipeline.COLUMNS
        out.append((name, docs.collect()))
    return out


def texts(rows):
    return [(r.doc_id, r.text) for r in rows]


def by_id(rows):
    return {r.doc_id: r for r in rows}


def test_stages(spark, kept):
    (_, docs), (_, good), (_, lined), (_, single), (_, cut) = kept
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "ngram_jaccard_join", "substring_dedup", "packing",
    ]
    verdicts = quality.measure(spark.createDataFrame(docs), public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert by_id(good) == {i: r for i, r in by_id(docs).items() if i in {v.doc_id for v in verdicts if v.kept}}

    expected = {i: text for i, text, _, _ in test_line_dedup.brute(texts(good))}
    assert dict(texts(lined)) == expected and len(lined) == len(good)

    alone = {i for i, class_id, _ in test_ngram_join.brute(texts(lined)) if i == class_id}
    assert by_id(single) == {i: r for i, r in by_id(lined).items() if i in alone}

    expected = {i: text for i, text, _, _ in test_substring_dedup.brute(texts(single))}
    assert dict(texts(cut)) == expected and len(cut) == len(single)
    for rows in (lined, cut):
        assert all(r.n_chars == len(r.text) and r.lang == by_id(docs)[r.doc_id].lang for r in rows)
    assert len(docs) > len(good) > len(single)


def test_run(spark, kept):
    found = __spark_entry__.queries()["pipeline"](spark, FOLDER).collect()
    assert test_packing.check(found, texts(kept[-1][1]), packing.LENGTH) > 0


def test_empty(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nulls_and_repeated_rows(spark, documents):
    prose = "It was a bright cold day in April and the clocks were striking thirteen while he walked slowly home again"
    docs = documents([(1, prose), (1, prose), (None, prose), (2, None), (3, ""), (4, f"{prose} and then some more words came")])
    docs = docs.withColumn("lang", F.lit(None).cast("string"))
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(step(spark, docs, FOLDER).collect(), docs.schema)
    assert sorted(docs.select("doc_id").collect(), key=str) == [(4,), (None,)]
