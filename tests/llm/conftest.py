import pytest


@pytest.fixture(scope="module")
def documents(spark):
    """Build a table of documents from (doc_id, text) pairs, with columns whose names clash with results."""

    def build(rows):
        full = [(i, text, "en", "s", None if text is None else len(text), 0.5, "x") for i, text in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, score double, shard string"
        return spark.createDataFrame(full, schema).repartition(3)

    return build
