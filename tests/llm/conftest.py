import pytest


@pytest.fixture()
def table(spark):
    """Rows (doc_id, text, source) as a table with extra columns whose names the operators use themselves."""
    def make(rows):
        full = [(i, t, s, "en", len(t) if t is not None else None, "x", 1, 2, 3) for i, t, s in rows]
        return spark.createDataFrame(full, "doc_id long, text string, source string, lang string, n_chars long, "
                                           "rec_id string, size int, key int, uid int")
    return make
