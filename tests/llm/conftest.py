import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """documents from (doc_id, text) pairs or full rows; extra columns with clashing names on request."""
    def make(rows, extra=False):
        full = [tuple(r) + (None,) * (5 - len(r)) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F
            for c in ("word", "n", "hash", "text_", "score", "key", "rank", "length", "piece", "component_id"):
                df = df.withColumn(c, F.lit("x"))
        return df
    return make
