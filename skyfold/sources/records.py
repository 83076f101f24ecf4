"""Scans of record, roster, odds and contingency files. Text is read as text and cast softly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold import schemas
from skyfold.sources.big_json import FEATURES, read_array

# Districts served when no roster file exists.
FALLBACK_DISTRICTS = (
    ("Bihar", "Gaya"), ("Bihar", "Patna"),
    ("Uttar Pradesh", "Varanasi"), ("Uttar Pradesh", "Lucknow"),
    ("Maharashtra", "Yavatmal"), ("Maharashtra", "Nagpur"),
    ("Rajasthan", "Jaipur"), ("Rajasthan", "Jodhpur"),
    ("Andhra Pradesh", "Anantapur"), ("Andhra Pradesh", "Kurnool"),
)


def soft(c: str, kind: str) -> Column:
    """Cast that gives null for blank or malformed text."""
    return F.expr(f"try_cast(nullif(trim({c}), '') as {kind})")


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def typed_points(raw: DataFrame) -> DataFrame:
    return raw.select("state", "district", soft("latitude", "double").alias("lat"), soft("longitude", "double").alias("lon"), "region")


def read_district_points(spark: SparkSession, path: str) -> DataFrame:
    return typed_points(_csv(spark, path, schemas.DISTRICT_POINTS))


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """District roster; a short built-in list when the file is missing."""
    if not path_exists(spark, path):
        return spark.createDataFrame(list(FALLBACK_DISTRICTS), schemas.ROSTER)
    return _csv(spark, path, schemas.ROSTER)


def read_records(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Nested district records of one array or, with ``multi_line=False``, of JSON lines; tasks share a file of either form."""
    return read_array(spark, path, schemas.RECORD) if multi_line else spark.read.schema(schemas.RECORD).json(path)


def typed_admin(raw: DataFrame) -> DataFrame:
    """Hand-kept records: whole numbers, 14-day departure 0 when unreadable, text booleans."""
    whole = ("rainfall_since_june_1_pct_departure", "rainfall_last_7_days_pct_departure")
    fourteen = "rainfall_last_14_days_pct_departure"
    out = raw
    for c in whole:
        out = out.withColumn(c, soft(c, "double").cast("int"))
    out = out.withColumn(fourteen, F.coalesce(soft(fourteen, "double").cast("int"), F.lit(0)))
    for c in ("heat_wave_warning", "heavy_rain_warning"):
        out = out.withColumn(c, F.coalesce(F.lower(c) == "true", F.lit(False)))
    return out


def read_admin(spark: SparkSession, path: str) -> DataFrame:
    return typed_admin(_csv(spark, path, schemas.ADMIN_CSV))


def typed_weekly(raw: DataFrame) -> DataFrame:
    return raw.select(
        "state", "district", soft("week", "int").alias("week"),
        F.coalesce(F.expr("nullif(model, '')"), F.lit("MME")).alias("model"),
        soft("precip_anom_mm_day", "double").alias("precip"), soft("t2m_anom_degC", "double").alias("t2m"),
        F.coalesce("init_date", F.lit("")).alias("init_date"),
    )


def read_weekly(spark: SparkSession, path: str) -> DataFrame:
    return typed_weekly(_csv(spark, path, schemas.WEEKLY_CSV))


def typed_odds(raw: DataFrame) -> DataFrame:
    odds = ("p_wetter", "p_near", "p_drier", "p_heavy", "p_dryspell", "p_hot")
    return raw.select(
        "state", "district", soft("week", "int").alias("week"), *[soft(c, "double").alias(c) for c in odds],
        soft("n_members", "double").cast("long").alias("n_members"), "models", "init_date",
    )


def read_odds(spark: SparkSession, path: str) -> DataFrame:
    return typed_odds(_csv(spark, path, schemas.ODDS_CSV))


def typed_observed(raw: DataFrame) -> DataFrame:
    """Rounded half to even and clipped to -100..300; unreadable values are 0, blank onset is normal."""
    fields = ("rainfall_since_june_1_pct_departure", "rainfall_last_7_days_pct_departure", "rainfall_last_14_days_pct_departure")

    def clip(c: str) -> Column:
        v = F.coalesce(F.bround(soft(c, "double")), F.lit(0.0))
        return F.greatest(F.lit(-100), F.least(F.lit(300), v)).cast("int").alias(c)

    return raw.select(
        "state", "district", *[clip(c) for c in fields],
        F.coalesce(F.expr("nullif(monsoon_onset_status, '')"), F.lit("normal")).alias("monsoon_onset_status"),
        F.coalesce("obs_asof", F.lit("")).alias("obs_asof"),
    )


def read_observed(spark: SparkSession, path: str) -> DataFrame:
    return typed_observed(_csv(spark, path, schemas.OBSERVED_CSV))


def typed_seasonal(raw: DataFrame) -> DataFrame:
    """Rain terciles with a usable lead and both outer odds."""
    return raw.where("variable = 'p'").select(
        "state", "district", "model", soft("lead", "int").alias("lead"),
        soft("p_above", "double").alias("p_above"), soft("p_below", "double").alias("p_below"),
    ).dropna(subset=["lead", "p_above", "p_below"])


def read_seasonal(spark: SparkSession, path: str) -> DataFrame:
    return typed_seasonal(_csv(spark, path, schemas.SEASONAL_CSV))


def plan_actions(raw: DataFrame) -> DataFrame:
    """Contingency records to flat actions; an item may be plain text or an object with ``action``.

    The older form of a plan is one flat list, of kind ``flat``.
    """
    per_scenario = raw.select("state", "district", F.explode("scenarios").alias("scenario", "lists"))
    kinds = F.array(
        F.struct(F.lit("crop").alias("kind"), F.col("lists.crop_actions").alias("items")),
        F.struct(F.lit("livestock").alias("kind"), F.col("lists.livestock_actions").alias("items")),
        F.struct(F.lit("flat").alias("kind"), F.col(f"lists.{schemas.FLAT_PLAN}").alias("items")),
    )
    rows = per_scenario.select("state", "district", "scenario", F.inline(kinds)).select(
        "state", "district", "scenario", "kind", F.posexplode("items").alias("pos", "item")
    )
    parsed = F.from_json("item", "action string, crop string, farming_situation string")
    is_object = F.startswith(F.trim("item"), F.lit("{"))
    return rows.withColumn("_p", F.when(is_object, parsed)).select(
        "state", "district", "scenario", "kind", "pos",
        F.coalesce("_p.action", "item").alias("action"),
        F.coalesce("_p.crop", F.lit("")).alias("crop"),
        F.coalesce("_p.farming_situation", F.lit("")).alias("farming_situation"),
    )


def read_contingency(spark: SparkSession, path: str) -> DataFrame:
    """Contingency records of an array. Items are read as text, so both item forms load under one schema."""
    return read_array(spark, path, schemas.CONTINGENCY)


def catalog_rows(raw: DataFrame) -> DataFrame:
    """Translation catalog exploded to one row per entry and language."""
    e = raw.select(F.posexplode("actions").alias("pos", "action_id", "e"))
    return e.select("pos", "action_id", F.col("e.source_text").alias("source_text"), F.explode_outer("e.translations").alias("lang", "text"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return catalog_rows(spark.read.schema(schemas.CATALOG).option("multiLine", True).json(path))


def polygon_rows(features: DataFrame, state_field: str, district_field: str) -> DataFrame:
    """Features to open outline rings and holes under one pair of names; a multipolygon gives several parts."""
    f = features.select(F.struct("properties", "geometry").alias("f"))
    point = "array<double>"
    g = f.select(
        F.col("f.properties")[state_field].alias("state"),
        F.col("f.properties")[district_field].alias("district"),
        F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json("f.geometry.coordinates", f"array<array<{point}>>")))
        .otherwise(F.from_json("f.geometry.coordinates", f"array<array<array<{point}>>>"))
        .alias("parts"),
    )

    def opened(ring: Column) -> Column:
        points = F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
        return F.when(F.get(ring, F.lit(0)) == F.element_at(ring, -1), F.slice(points, 1, F.size(points) - 1)).otherwise(points)

    rings = g.select("state", "district", F.posexplode("parts").alias("part", "rings")).withColumn("rings", F.transform("rings", opened))
    return rings.select(
        "state", "district", "part", F.get("rings", F.lit(0)).alias("ring"), F.slice("rings", 2, F.greatest(F.size("rings") - 1, F.lit(0))).alias("holes")
    )


def read_polygons(spark: SparkSession, path: str, state_field: str = "NAME_1", district_field: str = "NAME_2") -> DataFrame:
    """District outlines of a feature collection; tasks share one file."""
    return polygon_rows(read_array(spark, path, schemas.FEATURE, FEATURES), state_field, district_field)
