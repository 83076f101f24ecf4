"""Session settings shared by jobs, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "skyfold", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution, skew handling and UTC time.

    ``master`` is left to spark-submit unless given. Shuffle partitions are not
    pinned here: on a cluster AQE coalesces from the configured initial number.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # no call site for every column expression: large plans are built several times as fast
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    if master and master.startswith("local["):
        # small single-file inputs are cut for all cores
        settings["spark.sql.files.minPartitionNum"] = master[6:].split(",")[0].rstrip("]").replace("*", str(os.cpu_count()))
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``; a temporary folder is used
    only where nothing is set, as in local tests.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    local = os.path.join(tempfile.mkdtemp(prefix="skyfold-"), "checkpoints")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a stage table to the shared folder and read it back.

    Later steps that use the stage several times then scan a small table instead
    of repeating its work, and survive the loss of executors.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/stages/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

