"""Observed rainfall departures from normal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfold.functions.signals import onset_status


def pct_departure(observed: Column, normal: Column) -> Column:
    """Percent departure of sums, 0 where the normal is under 0.5, clipped to -100..300."""
    pct = F.bround((observed - normal) / normal * 100.0)
    return F.when(normal < 0.5, F.lit(0)).otherwise(
        F.greatest(F.lit(-100), F.least(F.lit(300), pct)).cast("int")
    )


def with_normals(obs: DataFrame, doy_clim: DataFrame, keys: list[str], date: str, normal: str) -> DataFrame:
    """Daily observations with the normal of their day of year."""
    return obs.withColumn("doy", F.dayofyear(date)).join(
        doy_clim.select(*keys, "doy", normal), [*keys, "doy"], "left"
    )


def last_rows(df: DataFrame, keys: list[str], date: str, n: int) -> DataFrame:
    """Last ``n`` daily rows per key: rows, not calendar days."""
    w = Window.partitionBy(*keys).orderBy(F.col(date).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def departures(daily: DataFrame, keys: list[str], date: str, observed: str, normal: str, as_of: Column) -> DataFrame:
    """Season, last-7-row and last-14-row departures with the onset proxy.

    ``daily`` is already one row per key and day, so a season bounds each key.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(date).desc())
    ranked = daily.withColumn("_rn", F.row_number().over(w))

    def total(column: str, n: int | None) -> Column:
        v = F.col(column) if n is None else F.when(F.col("_rn") <= n, F.col(column))
        return F.coalesce(F.sum(v), F.lit(0.0))

    out = ranked.groupBy(*keys).agg(
        pct_departure(total(observed, None), total(normal, None)).alias("rainfall_since_june_1_pct_departure"),
        pct_departure(total(observed, 7), total(normal, 7)).alias("rainfall_last_7_days_pct_departure"),
        pct_departure(total(observed, 14), total(normal, 14)).alias("rainfall_last_14_days_pct_departure"),
    )
    return out.withColumn(
        "monsoon_onset_status", onset_status(F.col("rainfall_since_june_1_pct_departure"))
    ).withColumn("obs_asof", F.date_format(as_of, "yyyy-MM-dd"))
