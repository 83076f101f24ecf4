"""Grid tables: partitioned Parquet in and out, and choice of files by init and model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITIONS = ["model", "init_date", "kind"]
WEEKLY_FILE = r"_(\d{8})_india_weekly\.nc$"
MEMBERS_FILE = r"_(\d{8})_india_weekly_members\.nc$"


def read_grid(spark: SparkSession, path: str, models: list[str] | None = None, init_date: str | None = None, kind: str | None = None) -> DataFrame:
    """Grid rows; the filters prune partitions before any file is opened."""
    df = spark.read.parquet(path)
    if models:
        df = df.where(F.col("model").isin(models))
    if init_date:
        df = df.where(F.col("init_date") == F.lit(init_date).cast("date"))
    if kind:
        df = df.where(F.col("kind") == kind)
    return df


def write_grid(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Zstd Parquet partitioned by model, init and kind, sorted by place so that boxes prune row groups.

    Only the partitions present in ``df`` are replaced. Rows are spread by
    place as well as partition, so one large run does not end in one task.
    """
    place = F.concat_ws(":", F.floor(F.col("lat") / 5).cast("string"), F.floor(F.col("lon") / 5).cast("string"))
    (
        df.repartition(*PARTITIONS, place)
        .sortWithinPartitions(*PARTITIONS, "lat", "lon")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(*PARTITIONS)
        .parquet(path)
    )


def missing_partitions(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Stage outputs still to be produced: wanted (model, init, kind) not yet on disk."""
    have = existing.select(*PARTITIONS).distinct()
    return wanted.select(*PARTITIONS).distinct().join(have, PARTITIONS, "left_anti")


def _init(name: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))


def discover_models(files: DataFrame, init: str | None = None) -> DataFrame:
    """File per model for one init: the given one, or the newest over all models.

    ``files`` has ``model, name``. A model that has files but none for the init
    comes back with status ``missing``.
    """
    weekly = files.where(~F.contains(F.lower("name"), F.lit("clim"))).withColumn("init", _init(F.col("name"), WEEKLY_FILE))
    weekly = weekly.where(F.col("init").isNotNull())
    target = F.lit(init) if init else weekly.select(F.max("init")).scalar()
    return weekly.groupBy("model").agg(
        F.min(F.when(F.col("init") == target, F.col("name"))).alias("file"), F.max("init").alias("newest")
    ).select("model", "file", "newest", F.when(F.col("file").isNull(), "missing").otherwise("ok").alias("status"))


def explicit_models(specs: dict[str, str], files: DataFrame) -> tuple[DataFrame, Column]:
    """Named files as given; the second value says whether their inits differ."""
    names = F.create_map(*[F.lit(x) for pair in specs.items() for x in pair])
    chosen = files.where(F.col("name") == F.try_element_at(names, F.col("model")))
    chosen = chosen.withColumn("init", _init(F.col("name"), WEEKLY_FILE))
    return chosen, F.count_distinct("init") > 1


def member_files(files: DataFrame, init: str) -> DataFrame:
    """Every member file of an init, all models."""
    return files.where(_init(F.col("name"), MEMBERS_FILE) == init)


def latest_cycle(names: DataFrame) -> DataFrame:
    """Newest six-digit cycle folder."""
    return names.where(F.col("name").rlike(r"^\d{6}$")).agg(F.max("name").alias("cycle"))


def pick_climatology(files: DataFrame, month: str) -> DataFrame:
    """Climatology whose init month matches, else the last one by name."""
    match = F.contains("name", F.lit(f"init{month}")).cast("int")
    clim = files.where(F.contains(F.lower("name"), F.lit("clim")))
    return clim.agg(F.max_by("name", F.struct(match, F.col("name"))).alias("name"))
