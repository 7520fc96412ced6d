import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def frame(spark):
    """A documents table from (doc_id, text[, lang, source]) rows."""
    def make(rows, schema=DOCS):
        full = [(*r, *(None, None)[len(r) - 2:], None)[:5] if len(r) < 4 else (*r[:4], None) for r in rows]
        return spark.createDataFrame(full, schema).repartition(3)
    return make
