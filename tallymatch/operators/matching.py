"""The decision: every row gets one status, every asset that no row names is listed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymatch import labels as L
from tallymatch.functions.paths import file_name, target_path
from tallymatch.functions.text import fold_case, is_safe_name
from tallymatch.operators.groups import (
    asset_groups,
    key_counts,
    key_ledger,
    measured,
    open_groups,
    repeated,
    target_counts,
)
from tallymatch.operators.spread import Limits, attach, digest, heaviest, keep_keys

LONGEST_PATH = 4_096
ROW_COLUMNS = ("row_number", "key_raw", "target_raw", "name", "key", "target")


def own_problem() -> Column:
    """The status of a row that its own key and target already rule out, else NULL."""
    return (
        F.when(F.col("key") == "", L.BLANK_KEY)
        .when(F.col("target") == "", L.BLANK_TARGET)
        .when(~is_safe_name(F.col("target")), L.INVALID_TARGET)
    )


def probe(roster: DataFrame, assets: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Left outer join of rows to the assets of their key: adds n_assets (NULL for none) and the first path.

    The assets are grouped first, so there is one row per key on the right and no row is multiplied. Blank keys match
    nothing.
    """
    groups = asset_groups(assets)
    listed = heaviest(key_counts(roster), "key", "n_rows", limits).select("digest")
    of_heavy = groups.withColumn("digest", digest("key")).join(F.broadcast(listed), "digest", "left_semi")
    # A path may have any length; those of more than a page take the ordinary join, so that the list stays small.
    of_heavy = of_heavy.filter(F.octet_length("path") <= LONGEST_PATH).select("digest", "n_assets", "path")
    heavy = listed.join(groups.filter(F.octet_length("path") > LONGEST_PATH).select(digest("key").alias("digest")), "digest", "left_anti")
    heavy = heavy.join(of_heavy, "digest", "left")
    return attach(roster, "key", heavy, [groups], F.col("row_number"), F.col("key") != "")


def with_repeats(roster: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Rows with the size of their key group and target group, NULL where they stand alone: n_rows, n_targets."""
    keys = repeated(key_counts(roster), "n_rows")
    targets = repeated(target_counts(roster), "n_targets")
    salt = F.col("row_number")
    rows = attach(roster, "key", heaviest(keys, "key", "n_rows", limits), [keys], salt)
    rows = rows.withColumn("folded", fold_case(F.col("target")))
    heavy_targets = heaviest(targets, "folded", "n_targets", limits)
    return attach(rows, "folded", heavy_targets, [targets], salt).drop("folded")


@dataclass(frozen=True)
class Counts:
    """What is known per key and per target before any row is decided.

    ``ledger`` counts both sides per key, ``targets`` has the repeated targets, ``groups`` the groups of assets that
    have to be opened. The last two are small next to the tables they come from.
    """

    ledger: DataFrame
    targets: DataFrame
    groups: DataFrame

    @classmethod
    def of(cls, roster: DataFrame, assets: DataFrame) -> Counts:
        ledger = key_ledger(roster, assets)
        targets = measured(repeated(target_counts(roster), "n_targets"), "folded")
        return cls(ledger, targets, measured(open_groups(ledger), "key"))


def facts_of_rows(roster: DataFrame, counts: Counts, limits: Limits = Limits()) -> DataFrame:
    """Every row with what the decision needs: problem, n_rows, n_targets, n_assets, path.

    Rows with a problem of their own, and rows of heavy keys, skip the shuffled lookup. A heavy key has several rows, so
    the path does not matter for it.
    """
    known = counts.ledger.filter("n_rows > 0")
    heavy_keys = heaviest(known, "key", "n_rows", limits)
    heavy_targets = heaviest(counts.targets, "folded", "n_targets", limits)

    salt = F.col("row_number")
    rows = roster.withColumn("problem", own_problem())
    rows = attach(rows, "key", heavy_keys, [known], salt, F.col("problem").isNull())
    rows = rows.withColumn("folded", fold_case(F.col("target")))
    return attach(rows, "folded", heavy_targets, [counts.targets], salt, F.col("n_rows") == 1).drop("folded")


def row_status() -> Column:
    """The checks in order; the first that hits gives the status."""
    return (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("n_rows") > 1, L.DUPLICATE_KEY)
        .when(F.col("n_targets") > 1, L.DUPLICATE_TARGET)
        .when(F.coalesce("n_assets", F.lit(0)) == 0, L.NO_ASSET)
        .when(F.col("n_assets") > 1, L.DUPLICATE_ASSET)
        .otherwise(L.PLANNED)
    )


def row_detail() -> Column:
    """Why, in words, for the statuses that have something to add."""
    status = F.col("status")
    return (
        F.when(status == L.INVALID_TARGET, "Target cannot be used as a file name")
        .when(status == L.DUPLICATE_KEY, F.concat(F.lit("Key is on "), F.col("n_rows").cast("string"), F.lit(" rows")))
        .when(
            status == L.DUPLICATE_TARGET,
            F.concat(F.lit("Target is on "), F.col("n_targets").cast("string"), F.lit(" rows")),
        )
        .when(
            status == L.DUPLICATE_ASSET,
            F.concat(F.col("n_assets").cast("string"), F.lit(" files carry this key")),
        )
        .otherwise("")
    )


def decide(roster: DataFrame, counts: Counts, folder: str, limits: Limits = Limits()) -> DataFrame:
    """One row per roster row: its columns plus status, source, destination and detail.

    The assets themselves are not needed: the ledger has their number for each key, and the path where there is one. The
    names behind a DUPLICATE_ASSET row are the rows of ``candidates``, whatever their number.
    """
    rows = facts_of_rows(roster, counts, limits).withColumn("status", row_status())
    planned = F.col("status") == L.PLANNED
    destination = target_path(folder, F.col("target"), file_name(F.col("path")))
    return rows.withColumn("detail", row_detail()).select(
        *ROW_COLUMNS,
        "status",
        F.when(planned, F.col("path")).otherwise("").alias("source"),
        F.when(planned, destination).otherwise("").alias("destination"),
        "detail",
    )


def orphans(assets: DataFrame, counts: Counts, limits: Limits = Limits()) -> DataFrame:
    """Assets whose key no row has: (key, path). A row that was rejected for any other reason still claims its key.

    The ledger has every key of the assets, so the left anti join is its ``n_rows = 0``, and where such a key has one
    asset the ledger has its path. Only the assets of unclaimed groups are looked up.
    """
    unclaimed = counts.ledger.filter("n_rows = 0")
    single = unclaimed.filter("n_assets = 1").select("key", "path")
    heavy = heaviest(counts.ledger, "key", "n_assets", limits)
    return single.unionByName(keep_keys(assets.select("key", "path"), "key", counts.groups, heavy))


def candidates(decided: DataFrame, assets: DataFrame, counts: Counts, limits: Limits = Limits()) -> DataFrame:
    """Every asset a DUPLICATE_ASSET row could mean: (row_number, key, path, file_name), one row per asset.

    This is the whole listing behind the detail. Such a row is the only one with its key, so the table is at most
    as long as the assets.
    """
    rows = decided.filter(F.col("status") == L.DUPLICATE_ASSET).select("key", "row_number")
    of_rows = rows.select(digest("key").alias("digest"), "row_number")
    heavy = heaviest(counts.ledger, "key", "n_assets", limits).select("digest").join(of_rows, "digest", "left")
    found = attach(assets.select("key", "path", "file_name"), "key", heavy, [rows], F.xxhash64("path"))
    return found.filter("row_number is not null").select("row_number", "key", "path", "file_name")
