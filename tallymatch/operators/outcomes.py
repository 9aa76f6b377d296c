"""What becomes of a planned row, given what is at its destination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymatch import labels as L


def same_content(verify: bool = False) -> Column:
    """Sizes are equal and, if asked for, the hashes too. Needs size, existing_size (and sha256, existing_sha256)."""
    equal = F.col("size") == F.col("existing_size")
    return equal & (F.col("sha256") == F.col("existing_sha256")) if verify else equal


def with_existing(planned: DataFrame, existing: DataFrame, verify: bool = False) -> DataFrame:
    """Left outer join on the destination: adds ``found`` and ``same``.

    ``planned`` has destination and size, ``existing`` has path and size; both have sha256 if ``verify`` is on.
    Destinations and paths are unique on both sides, so this join has no heavy keys.
    """
    there = existing.select(
        F.col("path").alias("destination"),
        F.col("size").alias("existing_size"),
        *([F.col("sha256").alias("existing_sha256")] if verify else []),
        F.lit(True).alias("found"),
    )
    return planned.join(there, "destination", "left").withColumns({
        "found": F.coalesce(F.col("found"), F.lit(False)),
        "same": F.coalesce(same_content(verify), F.lit(False)),
    })


def settle(compared: DataFrame, overwrite: bool = False, dry_run: bool = False) -> DataFrame:
    """Status and detail from ``found`` and ``same``. APPLIED means: to be copied now.

    A dry run still reports what is done or in conflict. Overwriting never touches a file that counts as the same.
    """
    problem = F.col("problem") if "problem" in compared.columns else F.lit(None).cast("string")
    last, last_detail = (L.PLANNED, "Dry run: nothing written") if dry_run else (L.APPLIED, "")
    done = F.col("found") & F.col("same")
    conflict = F.col("found") & F.lit(not overwrite)
    status = (
        F.when(problem.isNotNull(), L.COPY_FAILED)
        .when(done, L.ALREADY_DONE)
        .when(conflict, L.TARGET_CONFLICT)
        .otherwise(last)
    )
    detail = (
        F.when(problem.isNotNull(), problem)
        .when(done, "Destination already holds this file")
        .when(conflict, "Destination holds another file")
        .otherwise(last_detail)
    )
    return compared.withColumns({"status": status, "detail": detail})


def merge_outcomes(decided: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Decided rows with status and detail replaced where ``outcomes`` (row_number, status, detail) has the row."""
    new = outcomes.select(
        "row_number", F.col("status").alias("new_status"), F.col("detail").alias("new_detail")
    )
    return (
        decided.join(new, "row_number", "left")
        .withColumns({
            "status": F.coalesce("new_status", "status"),
            "detail": F.when(F.col("new_status").isNotNull(), F.col("new_detail")).otherwise(F.col("detail")),
        })
        .select(*decided.columns)
    )
