import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType(
    [
        StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
        StructField("source", StringType()), StructField("n_chars", LongType()),
    ]
)


@pytest.fixture
def docs_of(spark):
    """Builds a documents table from (doc_id, text) pairs, or texts numbered from 0."""

    def build(rows, parts=3):
        rows = [r if isinstance(r, tuple) else (k, r) for k, r in enumerate(rows)]
        full = [(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return build
