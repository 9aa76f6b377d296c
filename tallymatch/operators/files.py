"""The steps that touch files: a look at the destinations, and the copies.

What is at the destinations comes from one listing of the output folder, joined by path, not from a request for each row. Only where
contents are to be compared, or a size is not known, are files opened. Copies are dealt out by bytes: files go to tasks by the
running sum of their sizes, and a file larger than a task's share is copied in ranges by several tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymatch import labels as L
from tallymatch.functions.paths import file_name, place_in
from tallymatch.operators.outcomes import with_existing
from tallymatch.plans.staging import Stage
from tallymatch.sources.storage import Aside, copy_into_place, copy_range, drop_file, file_size, finish_ranges, same_bytes

ROWS_PER_TASK = 2_000
MOST_TASKS = 100_000
#: A file above this is copied in ranges of this size.
RANGE_BYTES = 256 << 20
#: What opening and renaming a file costs, as bytes.
PER_FILE = 64 << 10
#: A path with an address in front; ranges are written to local and mounted folders alone.
ADDRESS = r"^[A-Za-z][A-Za-z0-9+.-]+://"


def tasks_for(spark, rows: int, at_once: int | None = None) -> int:
    """Tasks for so many files: enough to use every core, small enough that losing one costs little.

    ``at_once`` sets the number of tasks, and with it the most files that are open at a time.
    """
    if at_once:
        return max(1, at_once)
    cores = spark.sparkContext.defaultParallelism
    rounds = -(-rows // (cores * ROWS_PER_TASK))
    return min(MOST_TASKS, cores * max(1, rounds))


def look_at_destinations(
    planned: DataFrame, existing: DataFrame, sizes: DataFrame, out: str, tasks: int, verify: bool = False
) -> DataFrame:
    """Planned rows plus size, found, same and problem: what is at the destination before anything is written.

    ``existing`` is what is directly in the output folder ``out``, ``sizes`` the sources (path, size), each path once. Sizes come first. Bytes are
    compared only where ``verify`` is on and the sizes are equal, side by side up to the first difference. ``problem`` says what
    went wrong when a file could not be read.
    """
    there = existing.select(place_in(out, file_name(F.col("path"))).alias("path"), "size")
    known = sizes.select(F.col("path").alias("source"), "size")
    rows = with_existing(planned.join(known, "source", "left"), there)
    open_row = F.col("found") & (F.col("size").isNull() | F.col("same") & F.lit(verify))
    rows = rows.withColumn("open", open_row)
    if verify:
        rows = rows.repartition(tasks, "destination")

    def compare(source: str, destination: str) -> tuple[bool, str | None]:
        try:
            here = file_size(source)
            if here is None:
                raise FileNotFoundError(f"No such file: {source}")
            return here == file_size(destination) and (not verify or same_bytes(source, destination)[0]), None
        except Exception as error:  # whatever one file raises is an answer about that file
            return False, _in_words(error)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            same, problem = batch["same"].to_numpy(bool, copy=True), [None] * len(batch)
            for k in batch["open"].to_numpy(bool).nonzero()[0]:
                same[k], problem[k] = compare(batch["source"].iloc[k], batch["destination"].iloc[k])
            yield batch.assign(same=same, problem=problem)

    schema = T.StructType([*rows.schema.fields, T.StructField("problem", T.StringType())])
    return rows.mapInPandas(look, schema).drop("open", "existing_size")


def in_bins(pieces: DataFrame, weight: Column, n: int, stage: Stage) -> DataFrame:
    """The pieces with a ``bin`` from 0 to ``n`` - 1, by the running sum of their weights, so no bin is heavier than an even share and
    one piece more. Each partition sums its own pieces; the sums of the partitions before it, one row for each, are added.
    """
    order = ["destination", "part"]
    stored = stage.save(pieces.withColumns({"weight": weight.cast("long"), "slice": F.spark_partition_id()}), "pieces")
    slices = stored.groupBy("slice").agg(F.sum("weight").alias("own"))
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    slices = slices.select("slice", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("before"), F.sum("own").over(everything).alias("whole"))
    own = F.sum("weight").over(Window.partitionBy("slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    placed = stored.withColumn("own", F.coalesce(own, F.lit(0))).join(slices, "slice")
    share = F.floor((F.col("before") + F.col("own")).cast("double") * n / F.col("whole"))
    return placed.withColumn("bin", F.least(share, F.lit(n - 1)).cast("int")).drop("weight", "slice", "own", "before", "whole")


def copy_files(rows: DataFrame, stage: Stage, at_once: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Copy source to destination for every row (source, destination, size and others): status APPLIED, or COPY_FAILED with the reason
    in detail. The copies are made once, and the rows with their outcomes are stored.

    One file that cannot be copied does not stop the others. A task that runs twice writes the same bytes twice, whole files under a
    temporary name of each attempt, ranges of a large file to their own places of one temporary file, which gets its name when
    all are written; so the outcome is the same.
    """
    spark, names = rows.sparkSession, rows.columns
    weight = F.coalesce("size", F.lit(0))
    whole = F.col("source").rlike(ADDRESS) | F.col("destination").rlike(ADDRESS) | (weight <= range_bytes)
    parts = F.when(whole, 1).otherwise(F.ceil(weight / range_bytes)).cast("int")
    figures = F.count_if(parts > 1), F.coalesce(F.sum(parts), F.lit(0)), F.coalesce(F.sum(weight), F.lit(0))
    large, count, total = rows.agg(*figures).first()
    if not count:
        return rows
    # A task has as many small ranges as it has small files, and bytes enough to be worth a task.
    tasks = max(1, at_once) if at_once else min(MOST_TASKS, max(tasks_for(spark, count), -(-total // max(range_bytes, RANGE_BYTES))))
    pieces = rows.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    of_piece = F.when(F.col("parts") == 1, weight).otherwise(
        F.least(F.lit(range_bytes), F.col("size") - F.col("part").cast("long") * range_bytes)
    )
    mark = uuid.uuid4().hex

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with Aside(f"{mark}-{TaskContext.get().taskAttemptId()}") as aside:
            for batch in batches:
                given = zip(batch["source"], batch["destination"], batch["size"], batch["part"], batch["parts"], strict=True)
                outcomes = []
                for source, destination, size, part, n in given:
                    if n == 1:
                        outcomes.append(_copy_one(source, destination, aside))
                        continue
                    at = int(part) * range_bytes
                    outcomes.append(_attempt(copy_range, source, f"{destination}.{mark}.part", at, min(range_bytes, int(size) - at)))
                yield _with_outcomes(batch, outcomes)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            outcomes = []
            for source, destination, size, status, detail in zip(*(batch[n] for n in ("source", "destination", "size", "status", "detail")), strict=True):
                part = f"{destination}.{mark}.part"
                outcome = (status, detail)
                if status == L.APPLIED:
                    outcome = _attempt(finish_ranges, source, part, destination, int(size))
                if outcome[0] != L.APPLIED:
                    drop_file(part)
                outcomes.append(outcome)
            yield _with_outcomes(batch, outcomes)

    placed = in_bins(pieces, of_piece + PER_FILE, tasks, stage).repartitionById(tasks, F.col("bin")).drop("bin")
    done = stage.save(placed.mapInPandas(copy, placed.schema), "copied")
    single = done.filter("parts = 1").select(*names)
    if not large:
        return single
    keys = [name for name in names if name not in ("status", "detail")]
    worst = F.max_by(F.struct("status", "detail"), F.col("status") != L.APPLIED).alias("worst")
    # Few bytes, but each row is a file to be looked at and renamed.
    split = done.filter("parts > 1").repartition(tasks_for(spark, large, at_once), *keys)
    split = split.groupBy(*keys).agg(worst).select(*keys, "worst.*").select(*names)
    return single.unionByName(stage.save(split.mapInPandas(finish, split.schema), "finished"))


def _with_outcomes(batch: pd.DataFrame, outcomes: list[tuple[str, str]]) -> pd.DataFrame:
    return batch.assign(status=[status for status, _ in outcomes], detail=[detail for _, detail in outcomes])


def _attempt(step, *given) -> tuple[str, str]:
    try:
        step(*given)
        return L.APPLIED, ""
    except Exception as error:  # stores raise more than OSError, and none of it may stop the other files
        return L.COPY_FAILED, _in_words(error)


def _copy_one(source: str, destination: str, aside: Aside) -> tuple[str, str]:
    return _attempt(copy_into_place, source, destination, aside)


def _in_words(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"
