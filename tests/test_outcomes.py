import itertools

import pytest
from pyspark.sql import functions as F

from tallymatch import labels as L
from tallymatch.operators.outcomes import merge_outcomes, settle, with_existing


@pytest.mark.parametrize("dry_run, overwrite, verify", list(itertools.product([False, True], repeat=3)))
def test_every_combination(spark, dry_run, overwrite, verify):
    planned = spark.createDataFrame(
        [(2, "o/a", 3, "x"), (3, "o/b", 3, "x"), (4, "o/c", 3, "x"), (5, "o/d", 3, "x")],
        "row_number long, destination string, size long, sha256 string",
    )
    existing = spark.createDataFrame(
        [("o/a", 3, "x"), ("o/b", 3, "other"), ("o/c", 9, "y"), ("o/z", 3, "x")], "path string, size long, sha256 string"
    )
    settled = settle(with_existing(planned, existing, verify), overwrite, dry_run)
    fresh = L.PLANNED if dry_run else L.APPLIED
    other = fresh if overwrite else L.TARGET_CONFLICT
    assert {row.row_number: row.status for row in settled.collect()} == {
        2: L.ALREADY_DONE, 3: other if verify else L.ALREADY_DONE, 4: other, 5: fresh,
    }


def test_merge_replaces_by_row_number(spark):
    decided = spark.createDataFrame(
        [(2, L.PLANNED, ""), (3, L.NO_ASSET, "why")], "row_number long, status string, detail string"
    )
    outcomes = spark.createDataFrame([(2, L.COPY_FAILED, "OSError: full")], decided.schema)
    merged = merge_outcomes(decided, outcomes).orderBy("row_number").collect()
    assert merged == [(2, L.COPY_FAILED, "OSError: full"), (3, L.NO_ASSET, "why")]
