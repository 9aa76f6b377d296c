from tallymatch import labels as L
from tallymatch.operators import audit as A


def test_summary_is_sorted_by_status(spark):
    """The order of a summary is that of the names, whatever the counts and the order of the rows."""
    statuses = [L.PLANNED, L.NO_ASSET, L.NO_ASSET, L.ORPHAN_ASSET, L.BLANK_KEY, L.APPLIED, L.NO_ASSET, L.DUPLICATE_KEY, L.APPLIED]
    audit = spark.createDataFrame([(status,) for status in statuses], "status string").repartition(5)
    found = [(row.status, row.n) for row in A.summary(audit).collect()]
    assert found == [(status, statuses.count(status)) for status in sorted(set(statuses))]


def test_all_statuses_are_listed():
    named = {value for name, value in vars(L).items() if name.isupper() and isinstance(value, str)}
    assert set(L.ALL) == named and set(L.SUCCESS) <= named
