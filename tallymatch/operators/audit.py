"""The audit table and the figures drawn from it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymatch import labels as L
from tallymatch.functions.paths import path_parts

# The columns of the audit in order.
COLUMNS = ("row_number", "key_raw", "target_raw", "name", "status", "source", "destination", "detail")


def audit_table(decided: DataFrame, unclaimed: DataFrame) -> DataFrame:
    """All rows and all orphans in one table: the audit columns plus ``key``, which the report order needs."""
    blank = F.lit("")
    leftovers = unclaimed.select(
        F.lit(None).cast("bigint").alias("row_number"),
        blank.alias("key_raw"),
        blank.alias("target_raw"),
        blank.alias("name"),
        F.lit(L.ORPHAN_ASSET).alias("status"),
        F.col("path").alias("source"),
        blank.alias("destination"),
        F.lit("No row has this key").alias("detail"),
        F.col("key"),
    )
    return decided.select(*COLUMNS, "key").unionByName(leftovers)


def report_order() -> list:
    """Rows by number, then orphans by key and path components."""
    return [
        F.col("row_number").asc_nulls_last(),
        F.when(F.col("row_number").isNull(), F.col("key")),
        F.when(F.col("row_number").isNull(), path_parts(F.col("source"))),
    ]


def in_report_order(audit: DataFrame) -> DataFrame:
    """The audit sorted for reading. Only sinks need it."""
    return audit.orderBy(*report_order()).select(*COLUMNS)


def summary(audit: DataFrame) -> DataFrame:
    """Rows per status, sorted by status: (status, n)."""
    return audit.groupBy("status").agg(F.count(F.lit(1)).alias("n")).orderBy("status")


def all_ok(audit: DataFrame) -> DataFrame:
    """One row: whether every roster row ended well. Orphans do not count, no rows at all is fine."""
    rows = audit.filter("row_number is not null")
    return rows.agg(F.coalesce(F.bool_and(F.col("status").isin(*L.SUCCESS)), F.lit(True)).alias("all_ok"))


def plan_metrics(audit: DataFrame) -> DataFrame:
    """One row: rows with a task, rows with an issue, orphans. For an audit before any outcome is known."""
    row = F.col("row_number").isNotNull()
    task = F.col("status") == L.PLANNED
    return audit.agg(
        F.count_if(row & task).alias("tasks"),
        F.count_if(row & ~task).alias("row_issues"),
        F.count_if(~row).alias("orphans"),
    )


def statuses(audit: DataFrame) -> DataFrame:
    """The statuses that occur, sorted."""
    return audit.select("status").distinct().orderBy("status")


def pick_statuses(audit: DataFrame, picked: Sequence[str]) -> DataFrame:
    return audit.filter(F.col("status").isin(*picked))


def relabel(audit: DataFrame, status_names: Mapping[str, str], column_names: Mapping[str, str] | None = None) -> DataFrame:
    """The audit with the statuses, and if wanted the columns, under the caller's own names."""
    return audit.replace(dict(status_names), subset=["status"]).withColumnsRenamed(dict(column_names or {}))
