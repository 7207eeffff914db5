import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


@pytest.fixture
def docs(spark):
    """A table of documents from (doc_id, text) rows, with columns whose names clash with results."""

    def make(rows, **extra):
        df = spark.createDataFrame([(i, t) for i, t in rows], DOCS).repartition(3)
        from pyspark.sql import functions as F
        for name in ("length", "fp", "component_id", "node", "line", "pos", "kept", "piece", "a", "b", "root", "n"):
            df = df.withColumn(name, F.lit(extra.get(name, "clash")))
        return df

    return make
