import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Make a documents table: rows are (doc_id, text) or (doc_id, text, lang, source)."""

    def make(rows, extra=()):
        full = []
        for r in rows:
            doc_id, text, lang, source = (*r, "en", "s0")[:4] if len(r) < 4 else r
            full.append((doc_id, text, lang, source, len(text) if text is not None else None))
        df = spark.createDataFrame(full, DOC_SCHEMA)
        for name in extra:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("clash"))
        return df

    return make
