"""Action libraries are tables of the user: ``scenario, category, audience, pos, text``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "scenario string, category string, audience string, pos int, text string"


def read_action_library(spark: SparkSession, path: str) -> DataFrame:
    """A library kept as CSV files with a header."""
    return spark.read.schema(SCHEMA).option("header", True).csv(path)
