"""Counts per key on both sides, and the assets that share a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymatch.functions.paths import path_parts
from tallymatch.functions.text import fold_case
from tallymatch.operators.spread import Limits, attach, heaviest
from tallymatch.plans.staging import Stage


def key_counts(roster: DataFrame) -> DataFrame:
    """Rows per key that is not blank, over all rows, also those another check rejects: (key, n_rows)."""
    return roster.filter("key <> ''").groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"))


def target_counts(roster: DataFrame) -> DataFrame:
    """Rows per case-folded target that is not blank, over all rows: (folded, n_targets)."""
    return (
        roster.filter("target <> ''")
        .groupBy(fold_case(F.col("target")).alias("folded"))
        .agg(F.count(F.lit(1)).alias("n_targets"))
    )


def repeated(counts: DataFrame, n: str) -> DataFrame:
    """The groups with two or more members. All of their members are rejected; there is no first one that wins."""
    return counts.filter(F.col(n) > 1)


def measured(groups: DataFrame, on: str) -> DataFrame:
    """The same rows behind an exchange of their own.

    What is left after counting and filtering is usually little, but the planner judges it by what went into the count.
    Behind an exchange it is judged by its real size, so a small rest is broadcast and the other side of the join is not
    shuffled.
    """
    return groups.repartition(on)


def asset_groups(assets: DataFrame) -> DataFrame:
    """Assets per key with the first path: (key, n_assets, path). One row per key, whatever the size of a group."""
    return assets.groupBy("key").agg(F.count(F.lit(1)).alias("n_assets"), F.min("path").alias("path"))


def key_ledger(roster: DataFrame, assets: DataFrame) -> DataFrame:
    """Both sides counted in one pass: (key, n_rows, n_assets, path), one row per key that is on either side.

    The two inputs are reduced per key before anything is shuffled and meet in a single exchange, so a key that holds
    a third of all rows costs one entry per input partition. ``path`` is the source where there is exactly one asset.
    """
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    rows = roster.filter("key <> ''").select("key", one.alias("r"), none.alias("a"), F.lit(None).cast("string").alias("path"))
    files = assets.select("key", none.alias("r"), one.alias("a"), "path")
    return (
        rows.unionByName(files)
        .groupBy("key")
        .agg(F.sum("r").alias("n_rows"), F.sum("a").alias("n_assets"), F.min("path").alias("path"))
    )


def asset_sizes(assets: DataFrame) -> DataFrame:
    """Assets per key: (key, n_assets)."""
    return assets.groupBy("key").agg(F.count(F.lit(1)).alias("n_assets"))


def asset_listing(assets: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The multimap in long form: every asset with its key and the size of its group.

    One row per asset, so a group may have any size. Sort on (key, parts) for the order within a group.
    """
    sizes = asset_sizes(assets)
    rows = assets.select("key", "path", "file_name", path_parts(F.col("path")).alias("parts"))
    return attach(rows, "key", heaviest(sizes, "key", "n_assets", limits), [sizes], F.xxhash64("path"))


def multimap(assets: DataFrame, stage: Stage) -> DataFrame:
    """Every asset with its place in its group, by path components: (key, n_assets, position, path, file_name).

    A group may have any size, so its order comes from a range partitioning by key and path: each slice numbers its own part
    of a group, and the counts of the slices before it, one row for each group and slice, are added.
    """
    parts = assets.select("key", "path", "file_name", path_parts(F.col("path")).alias("parts"))
    ordered = parts.repartitionByRange("key", "parts").withColumn("slice", F.spark_partition_id())
    ordered = stage.save(ordered, "ordered")
    counts = ordered.groupBy("key", "slice").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("key")
    before = F.sum("n").over(group.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("key", "slice", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(group).alias("n_assets"))
    at = F.row_number().over(Window.partitionBy("key", "slice").orderBy("parts"))
    placed = ordered.withColumn("at", at).join(counts, ["key", "slice"])
    return placed.select("key", "n_assets", (F.col("before") + F.col("at")).alias("position"), "path", "file_name")


def open_groups(ledger: DataFrame) -> DataFrame:
    """Keys with several assets and no row, whose assets some step must look up one by one: (key, n_rows, n_assets).

    Where a row has the key, the ledger settles it, and where there is one asset, the ledger has its path.
    """
    return ledger.filter("n_assets > 1 and n_rows = 0").select("key", "n_rows", "n_assets")
