"""A corpus pipeline: each stage takes what the one before has kept, as documents, and hands on documents.

The stages: quality rules drop documents; repeated runs of lines are cut out; of each group of near duplicates the document
with the smallest id stays; words of repeated windows are cut out; what is left is tokenised and packed. A document that
loses its whole text to the two cutting stages stays as an empty one. Between stages ``n_chars`` follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymatch.llm import line_dedup, ngram_join, packing, quality, substring_dedup, tables
from tallymatch.plans.staging import Stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
CARRIED = ["lang", "source"]


def _documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs.select(*COLUMNS), public_tokenizers.path("piece_bpe_32k.model"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(line_dedup.remove_repeated_lines(docs, carry=CARRIED))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows under the smallest id of their class; rows that share that id are the same document and all stay."""
    classes = ngram_join.near_duplicates(docs).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    stay = classes.select(tables.known_id().alias("known")).distinct()
    docs = docs.select(*COLUMNS, tables.known_id().alias("known"))
    return docs.join(stay, "known", "left_semi").select(*COLUMNS)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(substring_dedup.remove_repeats(docs, carry=CARRIED))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", substring_dedup_stage),
    ("packing", packing_stage),
]

#: The stages tokenise and hash; SQL cannot express them, so the tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, from the documents in ``sf_dir``."""
    stage = Stage(spark)
    docs = tables.table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage.save(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
