"""A whole run on files: list, read, match, copy, report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymatch import labels as L
from tallymatch.operators.audit import audit_table
from tallymatch.operators.files import copy_files, look_at_destinations, tasks_for
from tallymatch.operators.keyed import DEFAULT_SUFFIXES
from tallymatch.operators.outcomes import settle
from tallymatch.operators.sinks import read_audit, write_audit, write_report, write_report_file
from tallymatch.operators.spread import Limits
from tallymatch.plans.reconcile import reconcile
from tallymatch.plans.staging import Stage
from tallymatch.sources.folders import as_listing, list_folder, list_names, require_folder
from tallymatch.sources.sheets import read_sheet
from tallymatch.sources.storage import is_below, make_folder, plain_path, same_folder


@dataclass(frozen=True)
class Settings:
    """What a run can be told."""

    key_column: str = "Key"
    target_column: str = "Target"
    name_column: str | None = "Name"
    suffixes: Sequence[str] = DEFAULT_SUFFIXES
    zeros: bool = False
    recursive: bool = False
    dry_run: bool = False
    overwrite: bool = False
    verify: bool = False
    at_once: int | None = None
    limits: Limits = Limits()


@dataclass(frozen=True)
class RunResult:
    """The outcome code (0 all rows well, 2 some need attention), the audit, the counts per status.

    ``candidates`` lists every asset that the DUPLICATE_ASSET rows could mean, one row per asset, and is stored like the
    audit. ``scan`` counts files scanned, skipped and kept, and different keys; ``plan`` counts tasks, row issues and orphans.
    """

    code: int
    audit: DataFrame
    summary: dict[str, int]
    candidates: DataFrame
    scan: dict[str, int]
    plan: dict[str, int]


def check_folders(assets: str, out: str, recursive: bool) -> None:
    """Refuse an output folder that would change the source, or be listed as part of it next time."""
    if same_folder(assets, out):
        raise ValueError("The output folder must not be the asset folder")
    if recursive and is_below(out, assets):
        raise ValueError("The output folder must not be inside an asset folder that is listed recursively")


def run(
    spark: SparkSession,
    assets: str | DataFrame,
    sheet: str | DataFrame,
    out: str,
    settings: Settings = Settings(),
    *,
    audit_path: str | None = None,
    report_path: str | None = None,
    report_file: str | None = None,
    stage: Stage | None = None,
) -> RunResult:
    """Match a sheet to a folder of files and copy the matched files to their new names.

    In place of a folder there may be a table of files (path, size), such as the inventory of a bucket or what
    ``archives.extract`` has written; in place of a sheet a table of rows (row_number, key_raw, target_raw, name), such as
    ``sheets.roster_from_table`` gives. Raises before anything is listed or written where folders, sheet or columns are not fit.
    The audit is stored at ``audit_path`` (by default in the stage) and, if ``report_path`` is given, written there as a folder of CSV files,
    if ``report_file`` is given, as one CSV file. Counts are taken while tables are written, not by jobs of their own.
    """
    if isinstance(assets, str):
        check_folders(assets, out, settings.recursive)
        require_folder(assets)
    rows = sheet
    if isinstance(sheet, str):
        rows = read_sheet(spark, sheet, settings.key_column, settings.target_column, settings.name_column)
    stage = stage or Stage(spark)
    listing = list_folder(spark, assets, stage, settings.recursive) if isinstance(assets, str) else as_listing(assets)
    match = reconcile(
        rows,
        listing,
        plain_path(out),
        suffixes=settings.suffixes,
        zeros=settings.zeros,
        limits=settings.limits,
        stage=stage,
    )
    planned = F.col("status") == L.PLANNED
    with stage.counting(match.decided, "decided", tasks=F.count_if(planned), row_issues=F.count_if(~planned)) as counted:
        decided = stage.save(counted, "decided")
    outcomes = apply(decided, out, settings, stage, match.assets)
    stored = audit_path or stage.path("audit")
    each = {status: F.count_if(F.col("status") == status) for status in L.ALL}
    with stage.counting(audit_table(outcomes, match.orphans), "audit", **each) as counted:
        write_audit(counted, stored)
    audit = read_audit(spark, stored)
    if report_path:
        write_report(audit, report_path)
    if report_file:
        write_report_file(audit, report_file, stage)
    figures = stage.figures
    counts = {status: n for status, n in sorted(figures["audit"].items()) if n}
    fine = counts.keys() <= {*L.SUCCESS, L.ORPHAN_ASSET}
    candidates = stage.save(match.candidates(decided), "candidates")
    files = figures["assets"]
    scan = {
        "scanned": files["scanned"],
        "skipped": files["scanned"] - files["indexed"],
        "indexed": files["indexed"],
        "distinct_keys": figures["ledger"]["distinct_keys"],
    }
    plan = {**figures["decided"], "orphans": figures["audit"][L.ORPHAN_ASSET]}
    return RunResult(L.CODE_OK if fine else L.CODE_ATTENTION, audit, counts, candidates, scan, plan)


def apply(decided: DataFrame, out: str, settings: Settings, stage: Stage, files: DataFrame) -> DataFrame:
    """Decided rows with the outcome of the planned ones. ``files`` are the sources (path, size), each path once.

    What is at the destinations is listed once, before the first copy, and kept; the copies are made once and their
    outcomes kept. Reading the result again therefore copies nothing.
    """
    planned = decided.filter(F.col("status") == L.PLANNED)
    others = decided.filter(F.col("status") != L.PLANNED)
    existing = list_names(decided.sparkSession, out, stage)
    tasks = tasks_for(decided.sparkSession, planned.count() if settings.verify else 0, settings.at_once)
    compared = look_at_destinations(planned, existing, files, plain_path(out), tasks, settings.verify)
    settled = settle(compared, settings.overwrite, settings.dry_run).select(*decided.columns, "size")
    if settings.dry_run:
        return others.unionByName(stage.save(settled.drop("size"), "settled"))
    to_copy = F.col("status") == L.APPLIED
    with stage.counting(settled, "settled", copies=F.count_if(to_copy), kept=F.count_if(~to_copy)) as counted:
        settled = stage.save(counted, "settled")
    if any(stage.figures["settled"].values()):
        make_folder(out)
    copied = copy_files(settled.filter(to_copy), stage, settings.at_once)
    return others.unionByName(settled.filter(~to_copy).drop("size")).unionByName(copied.drop("size"))
