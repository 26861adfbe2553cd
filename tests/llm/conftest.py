import pytest


@pytest.fixture(scope="session")
def make(spark):
    """Documents with extra columns whose names clash with those that the operators use inside."""

    def docs(rows, extra=True):
        df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
        if extra:
            for c in ("copy", "fp", "size", "kind", "spans", "words", "key", "n_words", "component_id", "times", "rows", "__gone", "node", "start"):
                from pyspark.sql import functions as F

                df = df.withColumn(c, F.lit("x"))
        return df

    return docs
