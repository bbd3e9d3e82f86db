import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text[, lang, source]) rows, with a column whose name clashes with internal ones."""

    def build(*rows):
        full = [(i, t, *(more or ("en", "s1")), None if t is None else len(t), "extra") for i, t, *more in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, row_id string")

    return build
