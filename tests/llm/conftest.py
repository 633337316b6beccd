import pytest


@pytest.fixture
def docs(spark):
    """A frame of documents from (doc_id, text) or (doc_id, text, lang, source), with clashing extra columns."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, digest string, host string, fp bigint, seed bigint, __id string, label int"

    def make(rows):
        full = [(r[0], r[1], *(r[2:] or ("en", "src0")), len(r[1] or ""), 7, "x", "h", 1, 2, "y", 3) for r in rows]
        return spark.createDataFrame(full, schema)

    return make
