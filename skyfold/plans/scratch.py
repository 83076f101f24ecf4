"""Working folders for queries that write and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from skyfold.session import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the session's shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/scratch/{name}-{uuid.uuid4().hex}"
