import pytest
from pyspark.sql import types as T


@pytest.fixture
def docs(spark):
    """Make a documents table from (doc_id, text) pairs, with further columns of clashing names."""
    def make(rows, extra=()):
        fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *[T.StructField(c, T.StringType()) for c in extra]]
        return spark.createDataFrame([(*r, *["x" for _ in extra]) for r in rows], T.StructType(fields))
    return make
