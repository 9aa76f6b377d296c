import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A documents table of given texts; an item may be (doc_id, text)."""

    def make(items):
        rows = [item if isinstance(item, tuple) else (i, item) for i, item in enumerate(items)]
        return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], COLUMNS)

    return make
