"""Both sides of the match, cleaned by the same functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymatch.functions.paths import file_name, file_stem, file_suffix
from tallymatch.functions.text import clean_cell, key_of_text, squeeze

DEFAULT_SUFFIXES = (".jpg", ".jpeg")

# A name with something other than whitespace before its suffix, which is what it takes to have a key. The first pattern
# is a quick look that settles it for nearly all names.
VISIBLE_START = r"\A[!-~]"
HAS_STEM = r"(?Us)[^\s\x1c-\x1f].*\.[^.]+\z"


def _wanted(suffixes: Sequence[str]) -> Column:
    name = F.col("file_name")
    return F.col("suffix").isin(*[suffix.lower() for suffix in suffixes]) & (
        name.rlike(VISIBLE_START) | name.rlike(HAS_STEM)
    )


def keyed_roster(rows: DataFrame, zeros: bool = False, more: Sequence[Column] = ()) -> DataFrame:
    """(row_number, key_raw, target_raw, name) of any cell type -> the same as clean text, plus key and target.

    ``more`` are columns of ``rows`` that stay as they are.
    """
    types = dict(rows.dtypes)
    name = clean_cell("name", types["name"]) if "name" in types else F.lit("")
    return rows.select(
        F.col("row_number").cast("bigint").alias("row_number"),
        clean_cell("key_raw", types["key_raw"]).alias("key_raw"),
        clean_cell("target_raw", types["target_raw"]).alias("target_raw"),
        name.alias("name"),
        *more,
    ).withColumns({
        "key": key_of_text(F.col("key_raw"), zeros),
        "target": squeeze(F.col("target_raw")),
    })


def named_assets(listing: DataFrame, more: Sequence[Column] = ()) -> DataFrame:
    """(path, size) -> the same plus file_name and the lower-cased suffix. No row is dropped."""
    name = file_name(F.col("path"))
    return listing.select("path", F.col("size").cast("bigint").alias("size"), name.alias("file_name"), *more).withColumn(
        "suffix", F.lower(file_suffix(F.col("file_name")))
    )


def keyed_assets(
    listing: DataFrame, suffixes: Sequence[str] = DEFAULT_SUFFIXES, zeros: bool = False
) -> DataFrame:
    """(path, size) -> the assets with a wanted suffix and a key that is not blank."""
    stem = file_stem(F.col("file_name"))
    return (
        named_assets(listing)
        .filter(_wanted(suffixes))
        .withColumn("key", key_of_text(clean_cell(stem), zeros))
    )


def marked_assets(
    listing: DataFrame, suffixes: Sequence[str] = DEFAULT_SUFFIXES, zeros: bool = False, more: Sequence[Column] = ()
) -> DataFrame:
    """Like ``keyed_assets``, but no row is dropped: files that are no asset have no key."""
    stem = file_stem(F.col("file_name"))
    key = F.when(_wanted(suffixes), key_of_text(clean_cell(stem), zeros))
    return named_assets(listing, more).withColumn("key", key)


def scan_metrics(
    listing: DataFrame, suffixes: Sequence[str] = DEFAULT_SUFFIXES, zeros: bool = False
) -> DataFrame:
    """One row: files scanned, files skipped, files kept, distinct keys among those kept."""
    key = key_of_text(clean_cell(file_stem(F.col("file_name"))), zeros)
    kept = F.when(_wanted(suffixes), key)
    # Counting per key first keeps the final step to one row per key, however the keys are spread.
    per_key = named_assets(listing).select(kept.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    held = F.col("key").isNotNull()
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("scanned"),
        F.coalesce(F.sum(F.when(~held, F.col("n"))), F.lit(0)).alias("skipped"),
        F.coalesce(F.sum(F.when(held, F.col("n"))), F.lit(0)).alias("indexed"),
        F.count("key").alias("distinct_keys"),
    )
