import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts, with ids 0, 1, …, and extra columns with names the operators use inside."""

    def make(texts, ids=None, langs=None):
        rows = [
            (i, t, lang, "s", None if t is None else len(t), 1, "k", True)
            for i, t, lang in zip(
                ids or range(len(texts)), texts, langs or ["en"] * len(texts), strict=True
            )
        ]
        return spark.createDataFrame(rows, DOCS + ", node int, component string, kept boolean")

    return make
