"""Writers with fixed column order, versioned targets and repeatable stages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.sources.records import path_exists

# Column order of the exchanged files.
WEEKLY_COLUMNS = (
    "region", "state", "district", "week", "valid_week", "model", "precip_anom_mm_day", "t2m_anom_degC",
    "n_models", "init_date", "geom",
)
ODDS_COLUMNS = (
    "region", "state", "district", "week", "p_wetter", "p_near", "p_drier", "p_heavy", "p_dryspell", "p_hot",
    "n_members", "models", "init_date",
)
OBSERVED_COLUMNS = (
    "state", "district", "rainfall_since_june_1_pct_departure", "rainfall_last_7_days_pct_departure",
    "rainfall_last_14_days_pct_departure", "monsoon_onset_status", "obs_asof",
)
SEASONAL_COLUMNS = (
    "state", "district", "variable", "model", "lead", "valid_month", "units", "anomaly", "p_below", "p_near",
    "p_above", "category", "acc",
)


def write_csv(df: DataFrame, path: str, columns: tuple[str, ...]) -> None:
    """CSV in the given column order; nulls and empty text are both written as nothing."""
    (
        df.select(*columns)
        .write.mode("overwrite")
        .option("header", True)
        .option("nullValue", "")
        .option("emptyValue", "")
        .csv(path)
    )


def framed(values: DataFrame, path: str, head: str, tail: str) -> None:
    """Lines of ``value`` as JSON list files: a file for each task, its values between head and tail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"value": [head]})
        first = True
        for batch in batches:
            lines = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"value": [line if first and not k else f",{line}" for k, line in enumerate(lines)]}, pa.schema([("value", pa.string())]))
            first = first and not lines
        yield pa.RecordBatch.from_pydict({"value": [tail]})

    values.mapInArrow(run, "value string").write.mode("overwrite").text(path)


def write_array(df: DataFrame, path: str) -> None:
    """Rows as JSON arrays, one in each file."""
    framed(df.select(F.to_json(F.struct("*")).alias("value")), path, "[", "]")


def feature(names: dict[str, str]) -> Column:
    """Feature object of an outline: property names with their columns, ring and holes."""
    def closed(ring: Column) -> Column:
        return F.transform(F.concat(ring, F.slice(ring, 1, 1)), lambda p: F.array(p["lon"], p["lat"]))

    return F.struct(
        F.lit("Feature").alias("type"),
        F.struct(*(F.col(c).alias(name) for name, c in names.items())).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.concat(F.array(closed(F.col("ring"))), F.transform("holes", closed)).alias("coordinates")).alias("geometry"),
    )


def write_collection(polygons: DataFrame, path: str, names: dict[str, str]) -> None:
    """Outlines as feature collections, one in each file; every part is a feature of its own."""
    holes = polygons if "holes" in polygons.columns else polygons.withColumn("holes", F.slice(F.array("ring"), 1, 0))
    framed(holes.select(F.to_json(feature(names)).alias("value")), path, '{"type":"FeatureCollection","features":[', "]}")


def write_master_list(points: DataFrame, polygons: DataFrame, base: str) -> None:
    """The district list in three forms: names, coordinates with region, and outlines.

    Lists are ordered by state and district over all their files.
    """
    listed = points.repartitionByRange("state", "district").sortWithinPartitions("state", "district")
    write_csv(listed, f"{base}/district_metadata", ("state", "district"))
    write_csv(listed, f"{base}/district_coordinates", ("state", "district", "latitude", "longitude", "region"))
    write_collection(polygons, f"{base}/districts_geojson", {"state": "state", "district": "district"})


def write_if_missing(df: DataFrame, path: str, force: bool = False) -> bool:
    """Stage output written once; ``force`` replaces it. A target without its success marker is redone."""
    if not force and path_exists(df.sparkSession, f"{path}/_SUCCESS"):
        return False
    df.write.mode("overwrite").parquet(path)
    return True
