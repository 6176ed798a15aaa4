import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, with columns whose names clash with results."""
    def make(rows):
        return spark.createDataFrame([(i, t, "x", "y", None, 7, True, "z", 0.5, "w") for i, t in rows],
                                     "doc_id long, text string, lang string, source string, n_chars long, keep_id long, kept boolean, fingerprint string, score double, sha string")
    return make
