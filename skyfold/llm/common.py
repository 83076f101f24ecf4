"""Small helpers of the subpackage: table reads and row batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task turns into Python objects at a time, so a batch of long texts stays small.
ROWS_AT_ONCE = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(docs: DataFrame) -> Column:
    """The text column, null as empty."""
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into slices of a few rows; a slice shares its batch's memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def split_join(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of rows with one aggregated row a key, in which adaptive execution can split hot keys.

    An aggregate is partitioned by its keys already, and a join that takes this over
    cannot be split. A hash of the keys beside them makes both sides shuffle for the join.
    """
    number = F.xxhash64(*keys)
    return rows.withColumn("_keys", number).join(groups.withColumn("_keys", number), ["_keys", *keys]).drop("_keys")
