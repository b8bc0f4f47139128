import pytest


@pytest.fixture
def docs(spark):
    """Nulls, empty and odd texts, ties, repeated rows, clashing extra columns."""

    def make(rows, extra=True):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        from pyspark.sql import functions as F

        df = df.withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
        if extra:
            for c in ("n", "hash", "tag", "part", "score", "keep", "items", "spans", "base", "ids", "node", "at"):
                df = df.withColumn(c, F.lit(7))
        return df

    return make
