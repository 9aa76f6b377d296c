"""The match as one plan: two tables in, audit out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymatch.operators.audit import audit_table
from tallymatch.operators.groups import key_ledger, open_groups, repeated, target_counts
from tallymatch.operators.keyed import DEFAULT_SUFFIXES, keyed_assets, keyed_roster, marked_assets
from tallymatch.operators.matching import Counts, candidates, decide, orphans
from tallymatch.operators.spread import Limits
from tallymatch.plans.staging import Stage


@dataclass(frozen=True)
class Reconciliation:
    """The tables of one match, all from the same two inputs."""

    roster: DataFrame
    assets: DataFrame
    counts: Counts
    decided: DataFrame
    orphans: DataFrame
    audit: DataFrame
    limits: Limits = Limits()

    def candidates(self, decided: DataFrame | None = None) -> DataFrame:
        """The whole listing behind the DUPLICATE_ASSET rows, from a stored copy of ``decided`` if there is one."""
        return candidates(decided or self.decided, self.assets, self.counts, self.limits)


def reconcile(
    rows: DataFrame,
    listing: DataFrame,
    folder: str,
    *,
    suffixes: Sequence[str] = DEFAULT_SUFFIXES,
    zeros: bool = False,
    limits: Limits = Limits(),
    stage: Stage | None = None,
) -> Reconciliation:
    """Match rows (row_number, key_raw, target_raw, name) to assets (path, size).

    ``folder`` is where the matched files are to go, ``zeros`` drops leading zeros of all-digit keys on both sides.
    Without a stage everything stays lazy and nothing is written. With one, the tables that several later steps read
    (rows and assets with clean keys, counts per key) are written once and read back; files scanned and indexed and different
    keys are counted on the way (``stage.figures``).
    """
    roster = keyed_roster(rows, zeros)
    if stage is None:
        return reconcile_keyed(roster, keyed_assets(listing, suffixes, zeros), folder, limits)
    marked = marked_assets(listing, suffixes, zeros)
    with stage.counting(marked, "assets", scanned=F.count(F.lit(1)), indexed=F.count("key")) as counted:
        roster, assets = stage.save_all(roster=roster, assets=counted.filter(F.col("key").isNotNull()))
    return reconcile_keyed(roster, assets, folder, limits, stage)


def reconcile_keyed(
    roster: DataFrame, assets: DataFrame, folder: str, limits: Limits = Limits(), stage: Stage | None = None
) -> Reconciliation:
    """The same for tables whose keys are clean already, for example because they were stored that way."""
    if stage is None:
        counts = Counts.of(roster, assets)
    else:
        ledger = key_ledger(roster, assets)
        with stage.counting(ledger, "ledger", distinct_keys=F.count_if(F.col("n_assets") > 0)) as counted:
            ledger, targets = stage.save_all(ledger=counted, targets=repeated(target_counts(roster), "n_targets"))
        counts = Counts(ledger, targets, stage.save(open_groups(ledger), "groups"))
    decided = decide(roster, counts, folder, limits)
    unclaimed = orphans(assets, counts, limits)
    return Reconciliation(roster, assets, counts, decided, unclaimed, audit_table(decided, unclaimed), limits)
