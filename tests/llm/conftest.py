import pytest


@pytest.fixture
def frame(spark):
    """A documents-like table from (doc_id, text, lang, source) rows."""

    def make(rows):
        rows = [(*r, *[None] * (5 - len(r))) for r in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make
