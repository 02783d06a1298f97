import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, seg_id bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text, lang, source); a column with a clashing name comes along."""

    def make(rows):
        return spark.createDataFrame([(d, t, la, s, 1) for d, t, la, s in rows], DOCUMENTS)

    return make
