import pytest

from buoyline.llm import common


@pytest.fixture(scope="session")
def sc(spark):
    """The test session, prepared for the operators."""
    return common.prepare(spark)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(sc):
    """A documents table of (doc_id, text[, lang, source]) rows with two columns whose names clash with the operators' own."""

    def make(rows):
        full = [(*r, *([None] * (4 - len(r))))[:4] for r in rows]
        data = [(i, t, lang, s, len(t) if t is not None else None, "x", 1) for i, t, lang, s in full]
        return sc.createDataFrame(data, DOCS + ", key string, fp int")

    return make
