import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, with a language and columns whose names clash with the operators' own."""
    def make(pairs, clash=True):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        rows = [(i, t, "en", "s", len(t or "")) for i, t in pairs]
        if clash:
            schema += ", kept string, stats string, component_id string, row_key string, ids string, _stats int, found string, shard string, rule string, gone int, again int, `row` int, hash int, text_a string"
            rows = [(*r, "k", "s", "c", "r", "i", 1, "f", "h", "u", 2, 3, 4, 5, "ta") for r in rows]
        return spark.createDataFrame(rows, schema)

    return make
