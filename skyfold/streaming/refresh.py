"""Records that follow the ingest: after each micro-batch the districts it touches are merged anew."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skyfold.operators import records
from skyfold.sources import versions
from skyfold.streaming.ingest import weekly_partials


def refresh_districts(
    spark: SparkSession, batch: DataFrame, target: str, base: str, cells: DataFrame, model_rows: Callable[[DataFrame], DataFrame], tag: str
) -> int | None:
    """Publish the records of the districts whose cells a batch holds, merged with all sums ingested so far.

    ``cells`` has state, district, lat and lon; ``model_rows`` makes weekly model rows of
    districts from partial sums. Only those districts are computed and written. A batch
    that was published before changes nothing. Returns the version's number.
    """
    place = ["lat", "lon"]
    touched = cells.join(batch.select(*place).distinct(), place, "left_semi").select("state", "district").distinct()
    sums = spark.read.parquet(target)
    wanted = cells.join(touched, ["state", "district"], "left_semi").select(*place).distinct()
    rows = model_rows(sums.join(wanted, place, "left_semi"))
    rows = records.with_keys(rows).join(records.with_keys(touched).select("_ks", "_kd"), ["_ks", "_kd"], "left_semi").drop("_ks", "_kd")
    keys = records.with_keys(rows).select("_ks", "_kd").distinct()
    known = records.with_keys(versions.read_records(spark, base)).join(keys, ["_ks", "_kd"], "left_semi").drop("_ks", "_kd")
    merged = records.merge_weekly(records.seed_missing(known, rows), rows).drop("updated")
    return versions.publish(merged, base, whole=False, tag=tag)


def ingest_and_refresh(
    spark: SparkSession,
    landing: str,
    schema: str,
    target: str,
    checkpoint: str,
    base: str,
    cells: DataFrame,
    model_rows: Callable[[DataFrame], DataFrame],
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Fold every landed file not seen before into the weekly sums, and refresh the records after each micro-batch.

    A batch that runs again after a lost executor or driver replaces its sums and finds
    its version published, so the records are those of one run.
    """
    run = "c" + hashlib.sha1(checkpoint.encode()).hexdigest()[:12]

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        weekly_partials(batch).write.mode("overwrite").parquet(f"{target}/run={run}/batch={batch_id}")
        refresh_districts(spark, batch, target, base, cells, model_rows, f"{run}-{batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    return stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
