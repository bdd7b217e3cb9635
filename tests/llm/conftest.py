import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, path string, row string"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text, lang, source), with extra columns of clashing names."""

    def make(rows):
        return spark.createDataFrame([(*(list(r) + [None] * 4)[:4], None if len(r) < 2 or r[1] is None else len(r[1]), "x", "y") for r in rows], DOCS)

    return make
