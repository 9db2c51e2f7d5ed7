import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Make a documents table from (doc_id, text) pairs, with the usual further columns."""

    def make(rows):
        full = [(i, t, "en", "src0", len(t) if t is not None else None) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")

    return make
