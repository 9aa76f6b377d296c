"""What the operators share: columns under names of their own, tables in the shared folder."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymatch.plans.staging import Stage
from tallymatch.llm.words import LEAST_ID

TABLES = {"documents", "pages", "embeddings", "labels", "benchmark"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def only(docs: DataFrame, *names: str) -> DataFrame:
    """These columns alone: others, whatever their names, cannot clash with the operator's own."""
    return docs.select(*(F.col(f"`{name}`") for name in names))


def known_id(name: str = "doc_id") -> Column:
    """The id, with null as the smallest long."""
    return F.coalesce(F.col(name).cast("long"), F.lit(LEAST_ID))


def given_id(name: str = "doc_id") -> Column:
    """Back to null."""
    return F.when(F.col(name) != LEAST_ID, F.col(name))


def staged(table: DataFrame, name: str, stage: Stage | None = None) -> DataFrame:
    """The table written to the shared folder and read again: later steps neither recompute nor lose it."""
    return (stage or Stage(table.sparkSession)).save(table, name)


def least_of_most(counts: DataFrame, name: str, most: int) -> int:
    """The least count, a power of a root of 2, that at most ``most`` rows of the table reach."""
    step = F.floor(F.log2(name) * 8).cast("int")
    sizes = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect()
    total, least = 0, 1
    for row in sizes:
        total += row.n
        if total > most:
            return least
        least = math.ceil(2 ** (row.step / 8))
    return 1


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows within the block, for tables with large values; as the session had it afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
