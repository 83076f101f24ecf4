"""Day-of-year, weekly, hindcast and calendar-month climatologies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR_DAYS = 366


def doy_mean(df: DataFrame, keys: list[str], date: str, variables: list[str], years: tuple[int, int] | None = None) -> DataFrame:
    """Mean per day of year over the years; a single partial aggregation."""
    if years:
        df = df.where(F.year(date).between(*years))
    return df.groupBy(*keys, F.dayofyear(date).alias("doy")).agg(*[F.avg(v).alias(v) for v in variables])


def complete_doys(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """All 366 days per key; missing days filled by periodic linear interpolation.

    A key has at most 366 rows here, so its calendar is a bounded map that is
    expanded in place: no calendar join and no ordering across keys.
    """
    points = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("doy", F.col(value).cast("double").alias("v")))).alias("_pts")
    )
    n = F.size("_pts")
    first, last = F.get("_pts", F.lit(0)), F.get("_pts", n - 1)
    wrapped = F.concat(
        F.array(F.struct((last["doy"] - YEAR_DAYS).alias("doy"), last["v"].alias("v"))),
        F.col("_pts"),
        F.array(F.struct((first["doy"] + YEAR_DAYS).alias("doy"), first["v"].alias("v"))),
    )
    points = points.withColumn("_w", wrapped)
    return (
        points.select(
            *keys,
            F.explode(
                F.expr(
                    f"""flatten(transform(sequence(1, size(_w) - 1), i ->
                      transform(filter(sequence(_w[i-1].doy + 1, _w[i].doy), d -> d between 1 and {YEAR_DAYS}), d ->
                        named_struct('doy', d, 'v', _w[i-1].v + (_w[i].v - _w[i-1].v)
                          * (d - _w[i-1].doy) / (_w[i].doy - _w[i-1].doy)))))"""
                )
            ).alias("_p"),
        )
        .select(*keys, F.col("_p.doy").alias("doy"), F.col("_p.v").alias(value))
    )


def smooth_doys(df: DataFrame, keys: list[str], value: str, half_width: int = 7) -> DataFrame:
    """Circular centred mean over day of year.

    Every day hands its value to the ``2 * half_width + 1`` days around it, so the
    smoother is one map-side combined aggregation instead of a per-key window.
    """
    offset = F.explode(F.sequence(F.lit(-half_width), F.lit(half_width)))
    spread = df.where(F.col(value).isNotNull()).select(*keys, "doy", value, offset.alias("_o"))
    target = F.pmod(F.col("doy") + F.col("_o") - 1, F.lit(YEAR_DAYS)) + 1
    return spread.groupBy(*keys, target.alias("doy")).agg(F.avg(value).alias(value))


def doy_climatology(df: DataFrame, keys: list[str], date: str, value: str, years: tuple[int, int] | None = None) -> DataFrame:
    """Mean by day, completed, then smoothed over 15 days."""
    return smooth_doys(complete_doys(doy_mean(df, keys, date, [value], years), keys, value), keys, value)


def weekly_clim(doy: DataFrame, keys: list[str], init: Column, weeks: int, variables: list[str], has_366: bool = True) -> DataFrame:
    """Climatology of each forecast week: the mean of its seven valid days.

    The week calendar is an array literal per row of the day table's keys, so
    the join is on day of year against at most ``7 * weeks`` calendar rows.
    """
    day = F.explode(F.sequence(F.lit(1), F.lit(weeks * 7)))
    calendar = doy.sparkSession.range(1).select(init.cast("date").alias("_init"), day.alias("_d"))
    valid = F.dayofyear(F.date_add("_init", F.col("_d")))
    if not has_366:
        valid = F.when(valid == YEAR_DAYS, F.lit(YEAR_DAYS - 1)).otherwise(valid)
    calendar = calendar.select(F.ceil(F.col("_d") / 7).alias("week"), valid.alias("doy"))
    return doy.join(calendar, "doy").groupBy(*keys, "week").agg(*[F.avg(v).alias(v) for v in variables])


def hindcast_climatology(df: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """Mean over member and year."""
    return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in variables])


def calendar_month_anomaly(df: DataFrame, keys: list[str], month: str, t: str, p: str, valid_months: tuple[str, str]) -> DataFrame:
    """Observed anomaly per valid month against its calendar-month mean; rain per day."""
    m = F.month(month)
    clim = df.groupBy(*keys, m.alias("_m")).agg(F.avg(t).alias("_ct"), F.avg(p).alias("_cp"))
    target = df.where(F.col(month).between(*[F.lit(v).cast("date") for v in valid_months])).withColumn("_m", m)
    return target.join(clim, [*keys, "_m"]).select(
        *keys,
        month,
        (F.col(t) - F.col("_ct")).alias(t),
        ((F.col(p) - F.col("_cp")) / F.day(F.last_day(month))).alias(p),
    )


def hindcast_year_anomaly(df: DataFrame, keys: list[str], year: int, factors: dict[str, float]) -> DataFrame:
    """Ensemble mean of one hindcast year minus the all-year mean, in one pass.

    Empty when the year is absent.
    """
    is_year = F.col("year") == year
    aggs = [F.max(is_year).alias("_has")]
    for v in factors:
        aggs += [F.avg(F.when(is_year, F.col(v))).alias(f"_y_{v}"), F.avg(v).alias(f"_a_{v}")]
    out = df.groupBy(*keys).agg(*aggs).where("_has")
    return out.select(
        *keys, *[((F.col(f"_y_{v}") - F.col(f"_a_{v}")) * f).alias(v) for v, f in factors.items()]
    )
