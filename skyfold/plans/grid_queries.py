"""Grid, climatology, forecast and departure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyfold.functions import dates, signals
from skyfold.operators import climatology, departures, forecast, grid, ordered, quality, region, regrid
from skyfold.plans import views as v
from skyfold.plans.registry import VIEW_SQL, query

VARS = {"t2m": "mean", "precip": "mean"}


def r(name: str, digits: int = 6):
    """Rounded for quantities that cannot sit on a tie of the last digit."""
    return F.round(F.col(name), digits).alias(name)


def up(name, digits: int = 6):
    """Rounded after a nudge, for means of short decimals that would sit on a tie."""
    col = F.col(name) if isinstance(name, str) else name
    out = F.round(col + 1e-9, digits)
    return out.alias(name) if isinstance(name, str) else out


def weekly_members(spark, sf):
    return grid.to_weekly(v.lead(spark, sf), ["model", "member", "cell"], VARS)


def weekly_means(spark, sf):
    return grid.to_weekly(v.lead(spark, sf), ["model", "cell"], VARS)


def mean_anomaly(spark, sf):
    return forecast.weekly_anomaly(weekly_means(spark, sf), v.clim_weekly(spark, sf), ["cell", "week"], ["t2m", "precip"])


def cell_weights(spark, sf):
    return v.cells(spark, sf).select("state", "district", "cell", F.cos(F.radians("lat")).alias("w"))


def regional_models(spark, sf):
    return region.regional_mean(
        mean_anomaly(spark, sf), cell_weights(spark, sf), ["cell"], ["model", "week"], ["t2m", "precip"]
    )


VIEW_SQL["v_regional"] = """
SELECT state, district, model, week, sum(w * t2m) / sum(w) AS t2m, sum(w * precip) / sum(w) AS precip
FROM v_anom_mean JOIN v_weights USING (cell) GROUP BY ALL"""

VIEW_SQL["v_regional_members"] = """
SELECT state, district, model, member, week, sum(w * t2m) / sum(w) AS t2m, sum(w * precip) / sum(w) AS precip
FROM v_anom JOIN v_weights USING (cell) GROUP BY ALL"""

SIGNAL = "CASE WHEN precip >= 3 THEN 'above_normal' WHEN precip <= -3 THEN 'below_normal' ELSE 'near_normal' END"


@query(
    "flagship_weekly_outlook",
    f"""SELECT state, district, week, round(precip + 1e-9, 6) AS precip, round(t2m + 1e-9, 6) AS t2m, n_models, {SIGNAL} AS signal
    FROM (SELECT state, district, week, avg(precip) AS precip, avg(t2m) AS t2m, count(DISTINCT model) AS n_models
          FROM v_regional GROUP BY ALL)""",
)
def flagship(spark, sf):
    mme = forecast.multi_model_mean(regional_models(spark, sf), ["state", "district", "week"], ["t2m", "precip"])
    return mme.select(
        "state", "district", "week", up("precip"), up("t2m"), "n_models",
        signals.rain_signal(F.col("precip")).alias("signal"),
    )


@query(
    "sc10_grid_scan",
    """SELECT model, count(*) AS n, min(lead_hours) AS first_lead, max(lead_hours) AS last_lead,
       round(avg(precip), 6) AS precip FROM v_lead GROUP BY model""",
)
def sc10(spark, sf):
    return v.lead(spark, sf).groupBy("model").agg(
        F.count("*").alias("n"), F.min("lead_hours").alias("first_lead"), F.max("lead_hours").alias("last_lead"),
        F.round(F.avg("precip"), 6).alias("precip"),
    )


@query(
    "pf1_bbox_crop",
    """SELECT cell, lat, lon FROM v_cells WHERE lat BETWEEN 8.0 AND 30.0 AND lon BETWEEN 67.0 AND 90.0""",
)
def pf1(spark, sf):
    return grid.crop(v.cells(spark, sf).select("cell", "lat", "lon"), 30.0, 67.0, 8.0, 90.0, wrap360=True)


@query("pf2_coord_names", "SELECT cell, round(lat + lon, 6) AS s FROM v_cells")
def pf2(spark, sf):
    odd = v.cells(spark, sf).withColumnsRenamed({"lat": "latitude", "lon": "x"})
    return grid.standard_coords(odd).select("cell", F.round(F.col("lat") + F.col("lon"), 6).alias("s"))


@query(
    "pf3_fill_mask",
    """SELECT cell, count(*) AS n, count(CASE WHEN rain - 5 >= 0 THEN 1 END) AS n_valid,
       round(avg(CASE WHEN rain - 5 >= 0 THEN rain - 5 END) + 1e-9, 6) AS rain FROM v_obs_daily GROUP BY cell""",
)
def pf3(spark, sf):
    masked = v.obs_daily(spark, sf).withColumn("rain", grid.mask_fill(F.col("rain") - 5))
    return masked.groupBy("cell").agg(
        F.count("*").alias("n"), F.count("rain").alias("n_valid"), up(F.avg("rain")).alias("rain")
    )


@query("pf4_lead_cap", "SELECT model, count(*) AS n FROM v_lead WHERE lead_hours <= 240 GROUP BY model")
def pf4(spark, sf):
    return grid.lead_cap(v.lead(spark, sf), 10).groupBy("model").agg(F.count("*").alias("n"))


@query(
    "pf5_months_years",
    """SELECT year(date) AS y, month(date) AS m, count(*) AS n FROM v_obs_daily
       WHERE month(date) IN (6, 7, 8, 9) AND year(date) BETWEEN 1996 AND 1999 GROUP BY ALL""",
)
def pf5(spark, sf):
    kept = grid.months_and_years(v.obs_daily(spark, sf), "date", [6, 7, 8, 9], (1996, 1999))
    return kept.groupBy(F.year("date").alias("y"), F.month("date").alias("m")).agg(F.count("*").alias("n"))


@query("pf6_select_variables", "SELECT model, round(sum(t2m), 4) AS t2m, 'wind' AS missing FROM v_lead GROUP BY model")
def pf6(spark, sf):
    kept, missing = grid.select_variables(v.lead(spark, sf), ["t2m", "wind"], ["model"])
    return kept.groupBy("model").agg(F.round(F.sum("t2m"), 4).alias("t2m"), F.lit(",".join(missing)).alias("missing"))


@query(
    "pf7_units",
    """SELECT year, lead, count(*) AS n, round(avg(t - 273.15), 5) AS celsius, round(avg(p * 86400000), 3) AS mm_day,
       round(avg(p * 86400), 6) AS mm_day_mass, round(avg(p * 1e9 / day(last_day((make_date(CAST(year AS BIGINT), 6, 1) + to_months(CAST(lead AS INT)))))), 3) AS per_day,
       round(avg(p * 1e6 * 1000), 3) AS mm
       FROM v_hind GROUP BY year, lead""",
)
def pf7(spark, sf):
    h = v.hindcast(spark, sf)
    month = F.add_months(F.make_date("year", F.lit(6), F.lit(1)), F.col("lead"))
    return h.groupBy("year", "lead").agg(
        F.count("*").alias("n"),
        F.round(F.avg(grid.kelvin_to_celsius(F.col("t"))), 5).alias("celsius"),
        F.round(F.avg(grid.m_s_to_mm_day(F.col("p"))), 3).alias("mm_day"),
        F.round(F.avg(grid.kg_m2_s_to_mm_day(F.col("p"))), 6).alias("mm_day_mass"),
        F.round(F.avg(grid.per_month_to_per_day(F.col("p") * 1e9, month)), 3).alias("per_day"),
        F.round(F.avg(grid.metres_to_mm(F.col("p") * 1e6)), 3).alias("mm"),
    )


@query("pf32_metric_mode", """SELECT model, week, 'absolute' AS metric, count(*) AS n, round(avg(precip * 2.0), 6) AS value
       FROM v_weekly_mean GROUP BY ALL""")
def pf32(spark, sf):
    weekly = weekly_means(spark, sf)
    # one model has no climatology, so every model falls back to absolute values
    clim = weekly.where("model <> 'click'").select("model", "cell", "week", F.lit(1.0).alias("precip"))
    out = forecast.anomaly_or_absolute(weekly, clim, ["model", "cell", "week"], "precip", "percent", scale=2.0)
    return out.groupBy("model", "week", "metric").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("value"))


@query("pf32_metric_percent", """SELECT model, week, 'percent' AS metric, round(avg(f.precip / c.precip * 100), 5) AS value
       FROM v_weekly_mean f JOIN v_clim_weekly c USING (cell, week) GROUP BY ALL""")
def pf32_percent(spark, sf):
    weekly = weekly_means(spark, sf)
    clim = weekly.select("model", "cell", "week").join(
        v.clim_weekly(spark, sf).select("cell", "week", "precip"), ["cell", "week"]
    )
    out = forecast.anomaly_or_absolute(weekly, clim, ["model", "cell", "week"], "precip", "percent")
    return out.groupBy("model", "week", "metric").agg(F.round(F.avg("value"), 5).alias("value"))


@query(
    "pf35_slice_by_label",
    """SELECT cell, round(avg(t), 5) AS t FROM v_hind
       WHERE strftime((make_date(CAST(year AS BIGINT), 6, 1) + to_months(CAST(lead AS INT))), '%b %Y') = 'Aug 1999' GROUP BY cell""",
)
def pf35(spark, sf):
    label = dates.valid_month_label(F.make_date("year", F.lit(6), F.lit(1)), F.col("lead"))
    return v.hindcast(spark, sf).where(label == "Aug 1999").groupBy("cell").agg(F.round(F.avg("t"), 5).alias("t"))


@query(
    "ag5_ensemble_mean",
    "SELECT cell, week, round(avg(t2m) + 1e-9, 6) AS t2m, round(avg(precip) + 1e-9, 6) AS precip FROM v_weekly GROUP BY cell, week",
)
def ag5(spark, sf):
    return grid.ensemble_mean(weekly_members(spark, sf), ["cell", "week"], ["t2m", "precip"]).select("cell", "week", up("t2m"), up("precip"))


@query("ag6_weekly_mean", "SELECT model, cell, week, round(t2m, 6) AS t2m, round(precip, 6) AS precip FROM v_weekly_mean")
def ag6(spark, sf):
    return weekly_means(spark, sf).select("model", "cell", "week", r("t2m"), r("precip"))


@query(
    "ag7_weekly_sum_per_day",
    """SELECT model, cell, CAST(ceil(lead_hours / 168.0) AS BIGINT) AS week, round(sum(precip) / 7.0::DOUBLE, 6) AS precip
       FROM v_lead WHERE lead_hours > 0 AND lead_hours <= 840 GROUP BY ALL""",
)
def ag7(spark, sf):
    return grid.to_weekly(v.lead(spark, sf), ["model", "cell"], {"precip": "sum_per_day"}).select("model", "cell", "week", r("precip"))


VIEW_SQL["v_accum"] = """
SELECT cell, lead_hours, sum(precip) AS total FROM
 (SELECT cell, CAST(ceil(lead_hours / 24.0) AS BIGINT) * 24 AS lead_hours, precip FROM v_lead) GROUP BY ALL"""


def accumulated(spark, sf):
    daily = (F.ceil(F.col("lead_hours") / 24.0) * 24).alias("lead_hours")
    return v.lead(spark, sf).groupBy("cell", daily).agg(F.sum("precip").alias("total"))


@query(
    "wn4_deaccumulate",
    """SELECT e.cell, e.lead_hours // 168 AS week, round((e.total - coalesce(s.total, 0)) / 7.0::DOUBLE, 6) AS total
       FROM v_accum e LEFT JOIN v_accum s ON s.cell = e.cell AND s.lead_hours = e.lead_hours - 168
       WHERE e.lead_hours % 168 = 0""",
)
def wn4(spark, sf):
    return grid.deaccumulate_weekly(accumulated(spark, sf), ["cell"], "total").select("cell", "week", r("total"))


@query(
    "wn5_lead_by_order",
    """SELECT model, day, CAST(row_number() OVER (PARTITION BY model ORDER BY day) * 24 AS BIGINT) AS lead_hours, n
       FROM (SELECT event_type AS model, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL)""",
)
def wn5(spark, sf):
    days = v.table(spark, sf, "events").groupBy(F.col("event_type").alias("model"), F.col("ts").cast("date").alias("day")).agg(
        F.count("*").alias("n")
    )
    return grid.ordered_leads(days, ["model"], "day").select("model", "day", "lead_hours", "n")


@query(
    "fn14_lead_hours",
    """SELECT lead_hours, count(*) AS n, CAST(ceil(lead_hours / 168.0) AS BIGINT) AS week FROM v_lead GROUP BY lead_hours""",
)
def fn14(spark, sf):
    hours = grid.lead_from_times(F.lit(v.INIT).cast("timestamp_ntz"), F.col("ts")) + 1
    return v.table(spark, sf, "events").groupBy(hours.alias("lead_hours")).agg(F.count("*").alias("n")).select(
        "lead_hours", "n", grid.week_of(F.col("lead_hours")).alias("week")
    )


@query(
    "fn15_init_from_valid",
    "SELECT event_type AS model, CAST(min(CAST(ts AS DATE)) - 1 AS DATE) AS init FROM events GROUP BY event_type",
)
def fn15(spark, sf):
    return v.table(spark, sf, "events").groupBy(F.col("event_type").alias("model")).agg(
        dates.init_from_first_valid(F.min(F.col("ts").cast("date"))).alias("init")
    )


@query(
    "fn16_flat_index",
    """SELECT p_partkey AS idx, 6.0::DOUBLE + floor(p_partkey / 33.0) AS lat, 66.0::DOUBLE + (p_partkey % 33) AS lon FROM part""",
)
def fn16(spark, sf):
    lat, lon = grid.unflatten(F.col("p_partkey"), 6.0, 66.0, 33, 1.0)
    return v.table(spark, sf, "part").select(F.col("p_partkey").alias("idx"), lat.alias("lat"), lon.alias("lon"))


@query(
    "fn16_regular_grid",
    """SELECT i AS idx, 6.0::DOUBLE + floor(i / 33.0) * 0.5 AS lat, 66.0::DOUBLE + (i % 33) * 0.5 AS lon, coalesce(n, 0) AS n FROM range(0, 33 * 17) t(i)
       LEFT JOIN (SELECT p_partkey % 561 AS i, count(*) AS n FROM part GROUP BY 1) USING (i)""",
)
def fn16_grid(spark, sf):
    points = grid.regular_grid(spark, 6.0, 14.0, 66.0, 82.0, 0.5)
    hits = v.table(spark, sf, "part").groupBy((F.col("p_partkey") % 561).alias("idx")).agg(F.count("*").alias("n"))
    return points.join(hits, "idx", "left").select("idx", "lat", "lon", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "rs3_members_from_columns",
    """SELECT k, member, coalesce(CASE member WHEN 'm01' THEN t1 WHEN 'm02' THEN t2 ELSE t3 END, wk1) AS t
       FROM v_record, (VALUES ('m01'), ('m02'), ('m03')) m(member)""",
)
def rs3(spark, sf):
    rec = v.records(spark, sf).select(
        "k",
        F.col("week1_rainfall_anomaly_mm_day").alias("t"),
        F.col("week1_tmax_anomaly_degC").alias("t_member01"),
        F.col("week2_tmax_anomaly_degC").alias("t_member02"),
        F.col("week3_tmax_anomaly_degC").alias("t_member03"),
    )
    return grid.members_from_columns(rec, ["k"], "t")


@query("st1_union_all", "SELECT 'weekly' AS src, count(*) AS n FROM v_weekly UNION ALL SELECT 'mean', count(*) FROM v_weekly_mean")
def st1(spark, sf):
    members = weekly_members(spark, sf).select(F.lit("weekly").alias("src"), "cell", "week", "t2m")
    means = weekly_means(spark, sf).select(F.lit("mean").alias("src"), "cell", "week", "t2m")
    return members.unionByName(means).groupBy("src").agg(F.count("*").alias("n"))


@query(
    "st2_common_weeks",
    """SELECT week FROM v_weekly_mean GROUP BY week
       HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM v_weekly_mean)""",
)
def st2(spark, sf):
    return grid.common_weeks(weekly_means(spark, sf))


@query("st3_all_weeks", "SELECT DISTINCT week FROM v_weekly_mean")
def st3(spark, sf):
    return weekly_means(spark, sf).select("week").distinct()


@query(
    "st5_pool_members",
    "SELECT state, district, week, count(precip) AS n_pool, round(avg(precip) + 1e-9, 6) AS precip FROM v_regional_members GROUP BY ALL",
)
def st5(spark, sf):
    return member_regional(spark, sf).groupBy("state", "district", "week").agg(
        F.count("precip").alias("n_pool"), up(F.avg("precip")).alias("precip")
    )


def member_regional(spark, sf):
    anom = forecast.weekly_anomaly(weekly_members(spark, sf), v.clim_weekly(spark, sf), ["cell", "week"], ["t2m", "precip"])
    return region.regional_mean(anom, cell_weights(spark, sf), ["cell"], ["model", "member", "week"], ["t2m", "precip"])


@query(
    "jn18_weekly_anomaly",
    "SELECT model, cell, week, round(t2m, 6) AS t2m, round(precip, 6) AS precip FROM v_anom_mean",
)
def jn18(spark, sf):
    return mean_anomaly(spark, sf).select("model", "cell", "week", r("t2m"), r("precip"))


@query("ag1_regional_mean", """SELECT state, district, model, week, round(sum(w * t2m) / sum(w) + 1e-9, 6) AS t2m,
       round(sum(w * x) / sum(CASE WHEN x IS NOT NULL THEN w END) + 1e-9, 6) AS precip
       FROM (SELECT *, CASE WHEN precip > -4 THEN precip END AS x FROM v_anom_mean JOIN v_weights USING (cell)) GROUP BY ALL""")
def ag1(spark, sf):
    holes = mean_anomaly(spark, sf).withColumn("precip", F.when(F.col("precip") > -4, F.col("precip")))
    return region.regional_mean(holes, cell_weights(spark, sf), ["cell"], ["model", "week"], ["t2m", "precip"]).select(
        "state", "district", "model", "week", up("t2m"), up("precip")
    )


@query("ag2_null_propagating_mean", """SELECT district, model, week,
       round(CASE WHEN bool_or(bad) THEN NULL ELSE sum(w * t2m) / sum(w) END + 1e-9, 6) AS t2m
       FROM (SELECT a.*, b.bad FROM (SELECT *, CASE WHEN t2m > -48 THEN t2m END AS x FROM v_anom_mean) a
             JOIN (SELECT model, week, bool_or(t2m <= -48) AS bad FROM v_anom_mean GROUP BY ALL) b USING (model, week))
       JOIN v_weights USING (cell) GROUP BY district, model, week""")
def ag2(spark, sf):
    holes = mean_anomaly(spark, sf).withColumn("t2m", F.when(F.col("t2m") > -48, F.col("t2m")))
    return region.slice_propagating_mean(
        holes, cell_weights(spark, sf), ["cell"], ["model", "week"], "t2m", ["district"]
    ).select("district", "model", "week", up("t2m"))


@query(
    "ag3_multi_model_mean",
    """SELECT state, district, model, week, round(t2m + 1e-9, 6) AS t2m, round(precip + 1e-9, 6) AS precip, 1 AS n_models FROM v_regional
       UNION ALL SELECT state, district, 'MME', week, round(avg(t2m) + 1e-9, 6), round(avg(precip) + 1e-9, 6), count(DISTINCT model)
       FROM v_regional GROUP BY state, district, week""",
)
def ag3(spark, sf):
    both = forecast.with_multi_model(regional_models(spark, sf), ["state", "district", "week"], ["t2m", "precip"])
    return both.select("state", "district", "model", "week", up("t2m"), up("precip"), "n_models")


@query(
    "ag4_threshold_odds",
    """SELECT state, district, week, w AS p_wetter, d AS p_drier, round(round_even(1.0 - w - d, 3), 3) AS p_near, h AS p_heavy,
       ds AS p_dryspell, hot AS p_hot, n AS n_members, models FROM (
       SELECT state, district, week, round_even(avg(CAST(precip >= 1 AS INT)), 3) AS w, round_even(avg(CAST(precip <= -1 AS INT)), 3) AS d,
       round_even(avg(CAST(precip >= 7 AS INT)), 3) AS h, round_even(avg(CAST(precip <= -3 AS INT)), 3) AS ds,
       round_even(avg(CAST(t2m >= 1.5 AS INT)), 3) AS hot, count(precip) AS n,
       array_to_string(list_sort(list(DISTINCT model)), ',') AS models FROM v_regional_members GROUP BY ALL)""",
)
def ag4(spark, sf):
    odds = forecast.threshold_odds(member_regional(spark, sf), ["state", "district", "week"])
    return odds.withColumn("p_near", F.round("p_near", 3))


# --- climatology ----------------------------------------------------------

VIEW_SQL["v_doy"] = """
SELECT n_name AS district, dayofyear(date) AS doy, avg(rain) AS rain
FROM v_obs_daily JOIN customer ON cell = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE year(date) BETWEEN 1995 AND 2000 GROUP BY ALL"""


def district_daily(spark, sf):
    """Daily regional rain and the cells behind it."""
    w = cell_weights(spark, sf).select("district", "cell", "w")
    return region.regional_mean(v.obs_daily(spark, sf), w, ["cell"], ["date"], ["rain"], ["district"])


def district_obs(spark, sf):
    return v.obs_daily(spark, sf).join(cell_weights(spark, sf).select("district", "cell"), "cell")


def doy_rain(spark, sf):
    return climatology.doy_mean(district_obs(spark, sf), ["district"], "date", ["rain"], (1995, 2000))


@query("ag8_doy_climatology", "SELECT district, doy, round(rain + 1e-9, 6) AS rain FROM v_doy")
def ag8(spark, sf):
    return doy_rain(spark, sf).select("district", "doy", up("rain"))


VIEW_SQL["v_doy_full"] = """
WITH k AS (SELECT DISTINCT district FROM v_doy),
 w AS (SELECT district, doy + 366 * o AS doy, rain FROM v_doy, (VALUES (-1), (0), (1)) t(o)),
 c AS (SELECT district, doy FROM k, range(1, 367) r(doy)),
 b AS (SELECT c.district, c.doy,
   (SELECT max(w.doy) FROM w WHERE w.district = c.district AND w.doy <= c.doy) AS lo,
   (SELECT min(w.doy) FROM w WHERE w.district = c.district AND w.doy >= c.doy) AS hi FROM c)
SELECT b.district, b.doy, CASE WHEN lo = hi THEN l.rain
  ELSE l.rain + (h.rain - l.rain) * (b.doy - lo) / (hi - lo) END AS rain
FROM b JOIN w l ON l.district = b.district AND l.doy = lo JOIN w h ON h.district = b.district AND h.doy = hi"""


@query("wn2_doy_gap_fill", "SELECT district, doy, round(rain + 1e-9, 5) AS rain FROM v_doy_full")
def wn2(spark, sf):
    return climatology.complete_doys(doy_rain(spark, sf), ["district"], "rain").select("district", "doy", up("rain", 5))


@query(
    "wn1_doy_smoother",
    """SELECT district, doy, round(m + 1e-9, 5) AS rain FROM (
       SELECT district, doy, avg(rain) OVER (PARTITION BY district ORDER BY doy RANGE BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS m
       FROM (SELECT district, doy + 366 * o AS doy, rain FROM v_doy_full, (VALUES (-1), (0), (1)) t(o)))
       WHERE doy BETWEEN 1 AND 366""",
)
def wn1(spark, sf):
    full = climatology.complete_doys(doy_rain(spark, sf), ["district"], "rain")
    return climatology.smooth_doys(full, ["district"], "rain").select("district", "doy", up("rain", 5))


@query(
    "jn19_weekly_clim_for_init",
    """SELECT district, week, round(avg(rain) + 1e-9, 5) AS rain FROM v_doy_full JOIN
       (SELECT CAST(ceil(d / 7.0) AS BIGINT) AS week, dayofyear(DATE '2024-01-01' + CAST(d AS INT)) AS doy FROM range(1, 36) r(d)) USING (doy)
       GROUP BY ALL""",
)
def jn19(spark, sf):
    full = climatology.complete_doys(doy_rain(spark, sf), ["district"], "rain")
    return climatology.weekly_clim(full, ["district"], F.lit(v.INIT), 5, ["rain"]).select("district", "week", up("rain", 5))


@query(
    "jn20_obs_with_normal",
    """SELECT o.cell, count(*) AS n, round(sum(o.rain) + 1e-9, 5) AS rain, round(sum(c.rain) + 1e-9, 4) AS normal
       FROM v_obs_daily o JOIN v_weights w ON o.cell = w.cell
       LEFT JOIN v_doy c ON c.district = w.district AND c.doy = dayofyear(o.date) GROUP BY o.cell""",
)
def jn20(spark, sf):
    joined = departures.with_normals(
        district_obs(spark, sf), doy_rain(spark, sf).withColumnRenamed("rain", "normal"), ["district"], "date", "normal"
    )
    return joined.groupBy("cell").agg(
        F.count("*").alias("n"), up(F.sum("rain"), 5).alias("rain"), up(F.sum("normal"), 4).alias("normal")
    )


VIEW_SQL["v_season"] = """
SELECT d.district, d.date, d.rain, c.rain AS normal FROM
 (SELECT district, date, sum(w * rain) / sum(w) AS rain FROM v_obs_daily JOIN v_weights USING (cell) GROUP BY ALL) d
 LEFT JOIN v_doy c ON c.district = d.district AND c.doy = dayofyear(d.date)
WHERE d.date BETWEEN DATE '2001-06-01' AND DATE '2001-08-01'"""


def season_daily(spark, sf):
    daily = district_daily(spark, sf).where(F.col("date").between("2001-06-01", "2001-08-01"))
    return departures.with_normals(
        daily, doy_rain(spark, sf).withColumnRenamed("rain", "normal"), ["district"], "date", "normal"
    )


@query(
    "wn3_last_rows",
    """SELECT district, date, round(rain + 1e-9, 6) AS rain FROM
       (SELECT *, row_number() OVER (PARTITION BY district ORDER BY date DESC) AS rn FROM v_season) WHERE rn <= 14""",
)
def wn3(spark, sf):
    return departures.last_rows(season_daily(spark, sf), ["district"], "date", 14).select("district", "date", up("rain"))


_DEP = """CASE WHEN {n} < 0.5 THEN 0 ELSE CAST(greatest(-100, least(300, round_even(({o} - {n}) / {n} * 100, 0))) AS BIGINT) END"""


@query(
    "ag14_departures",
    f"""WITH s AS (SELECT district, coalesce(sum(rain), 0) AS o, coalesce(sum(normal), 0) AS n,
          coalesce(sum(rain) FILTER (rn <= 7), 0) AS o7, coalesce(sum(normal) FILTER (rn <= 7), 0) AS n7,
          coalesce(sum(rain) FILTER (rn <= 14), 0) AS o14, coalesce(sum(normal) FILTER (rn <= 14), 0) AS n14
        FROM (SELECT *, row_number() OVER (PARTITION BY district ORDER BY date DESC) AS rn FROM v_season) GROUP BY district)
      SELECT district, {_DEP.format(o='o', n='n')} AS rainfall_since_june_1_pct_departure,
        {_DEP.format(o='o7', n='n7')} AS rainfall_last_7_days_pct_departure,
        {_DEP.format(o='o14', n='n14')} AS rainfall_last_14_days_pct_departure,
        CASE WHEN {_DEP.format(o='o', n='n')} <= -60 THEN 'not_started' WHEN {_DEP.format(o='o', n='n')} <= -25 THEN 'delayed'
          WHEN {_DEP.format(o='o', n='n')} >= 25 THEN 'active' ELSE 'normal' END AS monsoon_onset_status,
        '2001-08-01' AS obs_asof FROM s""",
)
def ag14(spark, sf):
    return departures.departures(
        season_daily(spark, sf), ["district"], "date", "rain", "normal", F.lit("2001-08-01").cast("date")
    )


# --- seasonal -------------------------------------------------------------


def hind_regional(spark, sf):
    w = v.supplier_regions(spark, sf)
    mean = region.regional_mean(v.hindcast(spark, sf), w, ["cell"], ["lead", "year", "member"], ["t", "p"], ["district"])
    return mean.withColumn("t", F.round("t", 6))


@query("ag9_hindcast_climatology", """SELECT cell, lead, round(avg(t) + 1e-9, 5) AS t, round(avg(p) * 1e6 + 1e-9, 5) AS p FROM v_hind
       WHERE year <= 2000 GROUP BY cell, lead""")
def ag9(spark, sf):
    c = climatology.hindcast_climatology(v.hindcast(spark, sf).where("year <= 2000"), ["cell", "lead"], ["t", "p"])
    return c.select("cell", "lead", up("t", 5), up(F.col("p") * 1e6, 5).alias("p"))


VIEW_SQL["v_terc"] = """
WITH q AS (SELECT district, lead, quantile_cont(t, 1/3.0) AS q33, quantile_cont(t, 2/3.0) AS q67 FROM v_hind_reg WHERE year <= 2000 GROUP BY ALL)
SELECT f.district, f.lead, avg(CAST(t < q33 AS INT)) AS b, avg(CAST(t > q67 AS INT)) AS a FROM v_hind_reg f JOIN q USING (district, lead)
WHERE f.year = 2001 GROUP BY ALL"""


def tercile_table(spark, sf):
    h = hind_regional(spark, sf)
    limits = forecast.tercile_limits(h.where("year <= 2000"), ["district", "lead"], "t", bounded=True)
    return forecast.tercile_odds(h.where("year = 2001"), limits, ["district", "lead"], "t")


@query("ag10_terciles", "SELECT district, lead, round(b, 6) AS p_below, round(1 - b - a, 6) AS p_near, round(a, 6) AS p_above FROM v_terc")
def ag10(spark, sf):
    return tercile_table(spark, sf).select("district", "lead", r("p_below"), r("p_near"), r("p_above"))


@query(
    "ag11_most_likely",
    """SELECT district, lead, CASE WHEN b >= n - 1e-12 AND b >= a - 1e-12 THEN 0 WHEN n >= a - 1e-12 THEN 1 ELSE 2 END AS category,
       round(greatest(b, n, a), 6) AS p_max FROM (SELECT *, 1 - b - a AS n FROM v_terc)""",
)
def ag11(spark, sf):
    t = tercile_table(spark, sf)
    rounded = [F.round(F.col(c), 9) for c in ("p_below", "p_near", "p_above")]
    return t.select(
        "district", "lead", forecast.most_likely(*rounded).alias("category"),
        F.round(F.greatest("p_below", "p_near", "p_above"), 6).alias("p_max"),
    )


@query(
    "ag12_ensemble_anomaly",
    """SELECT district, lead, round(f.t - c.t, 5) AS t, round((f.p - c.p) * 86400000, 3) AS p FROM
       (SELECT district, lead, avg(t) AS t, avg(p) AS p FROM v_hind_reg WHERE year = 2001 GROUP BY ALL) f JOIN
       (SELECT district, lead, avg(t) AS t, avg(p) AS p FROM v_hind_reg WHERE year <= 2000 GROUP BY ALL) c USING (district, lead)""",
)
def ag12(spark, sf):
    h = hind_regional(spark, sf)
    out = forecast.ensemble_anomaly(
        h.where("year = 2001"), h.where("year <= 2000"), ["district", "lead"], {"t": 1.0, "p": grid.M_S_TO_MM_DAY}
    )
    return out.select("district", "lead", r("t", 5), r("p", 3))


@query(
    "ag13_pct_of_normal",
    """SELECT cell, lead, round(avg(CASE WHEN year = 2001 THEN p END) / nullif(avg(CASE WHEN year <= 2000 THEN p END), 0) * 100, 4) AS pct
       FROM v_hind GROUP BY cell, lead""",
)
def ag13(spark, sf):
    means = v.hindcast(spark, sf).groupBy("cell", "lead").agg(
        F.avg(F.when(F.col("year") == 2001, F.col("p"))).alias("f"),
        F.avg(F.when(F.col("year") <= 2000, F.col("p"))).alias("c"),
    )
    return means.select("cell", "lead", F.round(signals.pct_of_normal(F.col("f"), F.col("c")), 4).alias("pct"))


VIEW_SQL["v_acc"] = """
SELECT h.district, h.lead, corr(h.t, o.t2m) AS acc, count(*) AS n_years FROM
 (SELECT district, lead, year, avg(t) AS t FROM v_hind_reg GROUP BY ALL) h
 JOIN v_obs_month o ON o.district = h.district AND o.month = CAST(make_date(CAST(h.year AS BIGINT), 6, 1) + to_months(CAST(h.lead AS INT)) AS DATE)
GROUP BY ALL"""


def skill_pairs(spark, sf):
    h = grid.ensemble_mean(hind_regional(spark, sf), ["district", "lead", "year"], ["t"])
    wanted = h.withColumn("valid", F.add_months(F.make_date("year", F.lit(6), F.lit(1)), F.col("lead")))
    obs = v.obs_monthly(spark, sf).select("district", F.col("month").alias("obs_month"), "t2m")
    return regrid.asof_nearest_month(wanted, obs, ["district"], "valid", "obs_month", 20)


@query(
    "jn17_asof_month",
    """SELECT h.district, h.lead, h.year, o.month AS obs_month, round(o.t2m + 1e-9, 5) AS t2m
       FROM (SELECT DISTINCT district, lead, year FROM v_hind_reg) h
       JOIN v_obs_month o ON o.district = h.district AND o.month = CAST(make_date(CAST(h.year AS BIGINT), 6, 1) + to_months(CAST(h.lead AS INT)) AS DATE)""",
)
def jn17(spark, sf):
    return skill_pairs(spark, sf).select("district", "lead", "year", "obs_month", up("t2m", 5))


@query(
    "jn17_nearest_month",
    """SELECT district, day, obs_month, round(t2m + 1e-9, 5) AS t2m FROM (SELECT n.n_name AS district, d.day, o.month AS obs_month, o.t2m,
         row_number() OVER (PARTITION BY n.n_name, d.day ORDER BY abs(date_diff('day', d.day, o.month)), o.month) AS rn
       FROM nation n, (SELECT unnest([DATE '1991-03-10', DATE '1995-06-20', DATE '2001-01-01']) AS day) d JOIN v_obs_month o ON o.district = n.n_name) WHERE rn = 1""",
)
def jn17_nearest(spark, sf):
    days = F.explode(F.array(*(F.lit(d).cast("date") for d in ("1991-03-10", "1995-06-20", "2001-01-01")))).alias("day")
    wanted = v.table(spark, sf, "nation").select(F.col("n_name").alias("district"), days)
    obs = v.obs_monthly(spark, sf).select("district", F.col("month").alias("obs_month"), "t2m")
    return regrid.asof_nearest_month(wanted, obs, ["district"], "day", "obs_month", None).select("district", "day", "obs_month", up("t2m", 5))


@query("ag15_anomaly_correlation", "SELECT district, lead, round(acc, 5) AS acc, n_years FROM v_acc WHERE n_years > 2")
def ag15(spark, sf):
    acc = forecast.anomaly_correlation(skill_pairs(spark, sf), ["district", "lead"], "t", "t2m")
    return acc.where("n_years > 2").select("district", "lead", r("acc", 5), "n_years")


@query(
    "ag16_regional_skill",
    """SELECT r_name AS state, lead, round(sum(w * acc) / sum(w) + 1e-9, 5) AS acc FROM
       (SELECT district, lead, acc FROM v_acc WHERE n_years > 2) a JOIN nation ON n_name = district JOIN region ON r_regionkey = n_regionkey
       JOIN (SELECT n_name AS nm, cos(radians(6.0::DOUBLE + n_nationkey)) AS w FROM nation) ON nm = district GROUP BY ALL""",
)
def ag16(spark, sf):
    acc = forecast.anomaly_correlation(skill_pairs(spark, sf), ["district", "lead"], "t", "t2m").where("n_years > 2")
    nation, reg = v.table(spark, sf, "nation"), v.table(spark, sf, "region")
    w = nation.join(reg, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("state"), F.col("n_name").alias("district"), F.cos(F.radians(6.0 + F.col("n_nationkey"))).alias("w")
    )
    return region.regional_mean(acc, w, ["district"], ["lead"], ["acc"], ["state"]).select("state", "lead", up("acc", 5))


@query(
    "pf33_low_skill",
    "SELECT lead, count(*) AS n, sum(CASE WHEN acc >= 0.3 AND NOT isnan(acc) THEN 0 ELSE 1 END)::BIGINT AS n_low FROM v_acc GROUP BY lead",
)
def pf33(spark, sf):
    acc = forecast.anomaly_correlation(skill_pairs(spark, sf), ["district", "lead"], "t", "t2m")
    return acc.groupBy("lead").agg(F.count("*").alias("n"), F.sum(signals.low_skill(F.nanvl("acc", F.lit(None)))).alias("n_low"))


VIEW_SQL["v_sets"] = """
SELECT l_suppkey AS cell, sum(l_quantity) AS era, sum(l_extendedprice) / 1000.0::DOUBLE AS chirps, sum(l_tax * 500) AS imd
FROM lineitem GROUP BY l_suppkey"""


def datasets(spark, sf):
    return v.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("cell")).agg(
        F.sum("l_quantity").alias("era"),
        (F.sum("l_extendedprice") / 1000.0).alias("chirps"),
        F.sum(F.col("l_tax") * 500).alias("imd"),
    )


_PAIR = """SELECT '{a}' AS a, '{b}' AS b, count(*) AS n_cells, round(corr({a}, {b}), 5) AS r, round(avg({a}) - avg({b}), 4) AS bias,
 round((avg({a}) - avg({b})) / avg({b}) * 100, 4) AS bias_pct, round(avg({a}), 4) AS mean_a, round(avg({b}), 4) AS mean_b
 FROM v_sets WHERE era IS NOT NULL AND chirps IS NOT NULL AND imd IS NOT NULL"""


@query("pf16_tercile_sums", "SELECT district, lead FROM v_terc WHERE lead % 3 = 2")
def pf16_sums(spark, sf):
    odds = tercile_table(spark, sf)
    shifted = odds.withColumn("p_near", F.col("p_near") + F.when(F.col("lead") % 3 == 2, 0.2).otherwise(0.0))
    return quality.odds_sum_violations(shifted, "p_below", "p_near", "p_above").select("district", "lead")


@query(
    "ag17_dataset_pairs",
    " UNION ALL ".join(_PAIR.format(a=a, b=b) for a, b in (("era", "chirps"), ("era", "imd"), ("chirps", "imd"))),
)
def ag17(spark, sf):
    p = forecast.dataset_pairs(datasets(spark, sf), ["era", "chirps", "imd"])
    return p.select("a", "b", "n_cells", r("r", 5), r("bias", 4), r("bias_pct", 4), r("mean_a", 4), r("mean_b", 4))


@query(
    "ag18_seasonal_totals",
    "SELECT cell, year(date) AS year, round(sum(CASE WHEN rain >= 15 THEN rain END) + 1e-9, 5) AS rain FROM v_obs_daily WHERE month(date) IN (6,7,8,9) GROUP BY ALL",
)
def ag18(spark, sf):
    season = grid.months_and_years(v.obs_daily(spark, sf), "date", [6, 7, 8, 9])
    masked = season.select("cell", F.year("date").alias("year"), F.when(F.col("rain") >= 15, F.col("rain")).alias("rain"))
    return forecast.seasonal_totals(masked, ["cell", "year"], "rain").select("cell", "year", up("rain", 5))


@query(
    "ag19_observed_month_anomaly",
    """SELECT o.district, o.month, round(o.t2m - c.t + 1e-9, 5) AS t2m, round((o.precip - c.p) / day(last_day(o.month)) + 1e-9, 5) AS precip
       FROM v_obs_month o JOIN (SELECT district, month(month) AS m, avg(t2m) AS t, avg(precip) AS p FROM v_obs_month GROUP BY ALL) c
       ON c.district = o.district AND c.m = month(o.month) WHERE o.month BETWEEN DATE '1999-06-01' AND DATE '2000-05-01'""",
)
def ag19(spark, sf):
    out = climatology.calendar_month_anomaly(
        v.obs_monthly(spark, sf), ["district"], "month", "t2m", "precip", ("1999-06-01", "2000-05-01")
    )
    return out.select("district", "month", up("t2m", 5), up("precip", 5))


@query(
    "ag20_hindcast_year",
    """SELECT cell, lead, round(avg(t) FILTER (year = 1999) - avg(t) + 1e-9, 5) AS t,
       round((avg(p) FILTER (year = 1999) - avg(p)) * 86400000 + 1e-9, 3) AS p FROM v_hind GROUP BY cell, lead HAVING bool_or(year = 1999)""",
)
def ag20(spark, sf):
    out = climatology.hindcast_year_anomaly(v.hindcast(spark, sf), ["cell", "lead"], 1999, {"t": 1.0, "p": grid.M_S_TO_MM_DAY})
    return out.select("cell", "lead", up("t", 5), up("p", 3))


@query(
    "ag21_season_collapse",
    "SELECT cell, 'JAS 2001' AS label, round(avg(t) + 1e-9, 5) AS t FROM (SELECT cell, lead, avg(t) AS t FROM v_hind WHERE year = 2001 GROUP BY ALL) WHERE lead BETWEEN 1 AND 3 GROUP BY cell",
)
def ag21(spark, sf):
    by_lead = grid.ensemble_mean(v.hindcast(spark, sf).where("year = 2001"), ["cell", "lead"], ["t"])
    label = dates.season_label(F.lit("2001-06-01").cast("date"))
    return forecast.season_collapse(by_lead, ["cell"], ["t"]).select("cell", label.alias("label"), up("t", 5))


@query(
    "ag22_robust_limits",
    """SELECT week, round(quantile_cont(abs(precip), 0.98), 5) AS symmetric, round(quantile_cont(precip, 0.02), 5) AS low,
       round(quantile_cont(precip, 0.98), 5) AS high FROM v_anom_mean GROUP BY week""",
)
def ag22(spark, sf):
    return forecast.robust_limits(mean_anomaly(spark, sf), ["week"], "precip").select("week", r("symmetric", 5), r("low", 5), r("high", 5))


@query(
    "ag22_limits_whole_map",
    """SELECT round(quantile_cont(abs(l_extendedprice - 30000), 0.98), 4) AS symmetric, round(quantile_cont(l_extendedprice - 30000, 0.02), 4) AS low,
       round(quantile_cont(l_extendedprice - 30000, 0.98), 4) AS high FROM lineitem""",
)
def ag22_all(spark, sf):
    vals = v.table(spark, sf, "lineitem").select((F.col("l_extendedprice") - 30000).alias("x"))
    return forecast.robust_limits(vals, [], "x").select(r("symmetric", 4), r("low", 4), r("high", 4))


@query(
    "jn21_combine_models",
    """SELECT cell, label, round((a.t + b.t) / 2 + 1e-9, 5) AS t FROM
       (SELECT cell, strftime((make_date(CAST(year AS BIGINT), 6, 1) + to_months(CAST(lead AS INT))), '%b %Y') AS label, avg(t) AS t FROM v_hind WHERE member <= 3 GROUP BY ALL) a JOIN
       (SELECT cell, strftime((make_date(CAST(year AS BIGINT), 6, 1) + to_months(CAST(lead AS INT))), '%b %Y') AS label, avg(t) AS t FROM v_hind WHERE member > 3 GROUP BY ALL) b USING (cell, label)""",
)
def jn21(spark, sf):
    label = dates.valid_month_label(F.make_date("year", F.lit(6), F.lit(1)), F.col("lead"))
    h = v.hindcast(spark, sf).withColumn("label", label)
    one = grid.ensemble_mean(h.where("member <= 3"), ["cell", "label"], ["t"])
    two = grid.ensemble_mean(h.where("member > 3"), ["cell", "label"], ["t"])
    return forecast.combine_on_label(one, two, ["cell", "label"], ["t"]).select("cell", "label", up("t", 5))


@query(
    "jn22_cells_valid_in_all",
    "SELECT cell FROM v_sets WHERE era > 10 AND chirps > 20 AND imd IS NOT NULL",
)
def jn22(spark, sf):
    wide = datasets(spark, sf).select(
        "cell", F.when(F.col("era") > 10, F.col("era")).alias("era"), F.when(F.col("chirps") > 20, F.col("chirps")).alias("chirps"), "imd"
    )
    return wide.dropna(subset=["era", "chirps", "imd"]).select("cell")


@query("jn23_all_pairs", " UNION ALL ".join(_PAIR.format(a=a, b=b) for a, b in (("era", "chirps"), ("era", "imd"), ("chirps", "imd"))))
def jn23(spark, sf):
    return ag17(spark, sf)


@query(
    "ag23_seasonal_context",
    """SELECT district, CASE WHEN net >= 0.1 THEN 'above_normal' WHEN net <= -0.1 THEN 'below_normal_risk' ELSE 'normal' END AS context,
       round(round_even(net, 3), 3) AS net, leads FROM (SELECT district, round(avg(a) - avg(b), 9) AS net, count(*) AS leads FROM v_terc WHERE lead IN (0,1,2,3) GROUP BY district)""",
)
def ag23(spark, sf):
    t = tercile_table(spark, sf)
    return forecast.seasonal_context(t, ["district"])


# --- geometry and regridding ----------------------------------------------

VIEW_SQL["v_inside"] = """
SELECT e.state, e.district, p.lat, p.lon FROM v_points p, v_edges e
GROUP BY ALL HAVING sum(CASE WHEN (e.y1 > p.lat) <> (e.y2 > p.lat) AND p.lon < (e.x2 - e.x1) * (p.lat - e.y1) / (e.y2 - e.y1) + e.x1
  THEN 1 ELSE 0 END) % 2 = 1"""


@query("jn9_cells_in_polygon", "SELECT state, district, lat, lon FROM v_inside")
def jn9(spark, sf):
    return region.cells_inside(v.grid_points(spark, sf), v.polygons(spark, sf))


VIEW_SQL["v_centroid"] = """
SELECT state, district, sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3.0 * sum(x1 * y2 - x2 * y1)) AS lon,
  sum((y1 + y2) * (x1 * y2 - x2 * y1)) / (3.0 * sum(x1 * y2 - x2 * y1)) AS lat FROM v_edges GROUP BY ALL"""


@query("fn26_centroid", """SELECT state, district, round(c.lat, 4) AS lat, round(c.lon, 4) AS lon, round(west, 3) AS west, round(east, 3) AS east,
   round(south, 3) AS south, round(north, 3) AS north FROM v_centroid c JOIN (SELECT district, min(x1) AS west, max(x1) AS east,
   min(y1) AS south, max(y1) AS north FROM v_edges GROUP BY district) USING (district)""")
def fn26(spark, sf):
    p = v.polygons(spark, sf)
    c = region.centroids(p).join(region.bounds(p), region.REGION)
    return c.select("state", "district", r("lat", 4), r("lon", 4), r("west", 3), r("east", 3), r("south", 3), r("north", 3))


@query(
    "jn10_nearest_cell_fallback",
    """SELECT state, district, lat, lon, fallback, round(cos(radians(lat)), 8) AS w FROM (
       SELECT state, district, lat, lon, false AS fallback FROM v_inside UNION ALL
       SELECT c.state, c.district, (SELECT arg_min(p.lat, abs(p.lat - c.lat)) FROM v_points p), (SELECT arg_min(p.lon, abs(p.lon - c.lon)) FROM v_points p), true
       FROM v_centroid c WHERE NOT EXISTS (SELECT 1 FROM v_inside i WHERE i.district = c.district))""",
)
def jn10(spark, sf):
    w = region.region_weights(v.grid_points(spark, sf), v.polygons(spark, sf))
    return w.select("state", "district", "lat", "lon", "fallback", r("w", 8))


@query("fn19_cos_weight", "SELECT cell, round(cos(radians(lat)), 8) AS w FROM v_cells")
def fn19(spark, sf):
    from skyfold.functions.geo import cos_weight

    return v.cells(spark, sf).select("cell", F.round(cos_weight(F.col("lat")), 8).alias("w"))


@query("ag33_dissolve", """SELECT r_name AS state, n_name AS district, 1 + (n_nationkey % 3 = 0)::INT AS n_parts, 5 + 3 * (n_nationkey % 3 = 0)::INT AS n_points,
   round(66.013::DOUBLE + (n_nationkey % 5) * 6.4::DOUBLE, 6) AS first_lon FROM nation JOIN region ON n_regionkey = r_regionkey""")
def ag33(spark, sf):
    return region.dissolve(v.parted_polygons(spark, sf)).select(
        "state", "district", "n_parts", F.expr("aggregate(rings, 0L, (s, x) -> s + size(x))").alias("n_points"), F.round(F.col("rings")[0][0]["lon"], 6).alias("first_lon")
    )


@query(
    "ag31_region_coverage",
    """WITH i AS (SELECT district, count(*) AS n FROM v_inside GROUP BY district)
       SELECT r_name AS state, n_name AS district, coalesce(i.n, 1) AS n_cells, i.n IS NULL AS any_fallback
       FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN i ON i.district = n_name""",
)
def ag31(spark, sf):
    w = region.region_weights(v.grid_points(spark, sf), v.polygons(spark, sf))
    return w.groupBy("state", "district").agg(F.count("*").alias("n_cells"), F.bool_or("fallback").alias("any_fallback"))


@query(
    "pf31_state_focus",
    """SELECT array_to_string(list_sort(list(DISTINCT state)), ',') AS names, round(min(x1) - 0.6, 4) AS west, round(max(x1) + 0.6, 4) AS east,
       round(min(y1) - 0.6, 4) AS south, round(max(y1) + 0.6, 4) AS north FROM v_edges
       WHERE contains(lower(state), 'asia') OR contains(lower(state), 'amer')""",
)
def pf31(spark, sf):
    f = region.focus_regions(region.bounds(v.polygons(spark, sf)), ["Asia", " AMER "])
    return f.select("names", r("west", 4), r("east", 4), r("south", 4), r("north", 4))


@query(
    "jn13_nearest_district",
    """WITH s AS (SELECT s_suppkey AS k, 6.0::DOUBLE + (s_suppkey % 67) * 0.47 AS lat, 66.0::DOUBLE + (s_suppkey % 53) * 0.53 AS lon FROM supplier)
       SELECT k, district, round(d2, 6) AS d2 FROM (SELECT s.k, c.district, (s.lat - c.lat) * (s.lat - c.lat) + (s.lon - c.lon) * (s.lon - c.lon) AS d2,
         row_number() OVER (PARTITION BY s.k ORDER BY (s.lat - c.lat) * (s.lat - c.lat) + (s.lon - c.lon) * (s.lon - c.lon), c.state, c.district) AS rn
         FROM s, v_centroid c) WHERE rn = 1""",
)
def jn13(spark, sf):
    k = F.col("s_suppkey")
    q = v.table(spark, sf, "supplier").select(
        k.alias("k"), (6.0 + (k % 67) * 0.47).alias("lat"), (66.0 + (k % 53) * 0.53).alias("lon")
    )
    out = region.nearest_place(q, region.centroids(v.polygons(spark, sf)))
    return out.select("k", F.col("near.district").alias("district"), F.round("near.d2", 6).alias("d2"))


VIEW_SQL["v_src_grid"] = """
SELECT DISTINCT 6.0::DOUBLE + (p_partkey % 20) * 1.7::DOUBLE AS lat, 66.0::DOUBLE + (CAST(floor(p_partkey / 20.0) AS BIGINT) % 20) * 1.7::DOUBLE AS lon,
  CAST((p_partkey % 20) * (CAST(floor(p_partkey / 20.0) AS BIGINT) % 20) AS DOUBLE) AS val FROM part"""


def source_grid(spark, sf):
    p = F.col("p_partkey")
    i, j = p % 20, F.floor(p / 20.0) % 20
    return v.table(spark, sf, "part").select(
        (6.0 + i * 1.7).alias("lat"), (66.0 + j * 1.7).alias("lon"), (i * j).cast("double").alias("val")
    ).distinct()


@query(
    "jn15_nearest_grid",
    """WITH a AS (SELECT t.lat, (SELECT s.lat FROM v_src_grid s ORDER BY abs(s.lat - t.lat), s.lat DESC LIMIT 1) AS slat FROM (SELECT DISTINCT lat FROM v_points) t),
       b AS (SELECT t.lon, (SELECT s.lon FROM v_src_grid s ORDER BY abs(s.lon - t.lon), s.lon DESC LIMIT 1) AS slon FROM (SELECT DISTINCT lon FROM v_points) t)
       SELECT p.lat, p.lon, s.val FROM v_points p JOIN a ON a.lat = p.lat JOIN b ON b.lon = p.lon JOIN v_src_grid s ON s.lat = slat AND s.lon = slon""",
)
def jn15(spark, sf):
    return regrid.align_nearest(source_grid(spark, sf), v.grid_points(spark, sf), ["val"])


@query(
    "jn16_bilinear",
    """SELECT p.lat, p.lon, round(((p.lat - 6.0) / 1.7) * ((p.lon - 66.0) / 1.7), 5) AS val FROM v_points p
       WHERE p.lat <= (SELECT max(lat) FROM v_src_grid) AND p.lon <= (SELECT max(lon) FROM v_src_grid)""",
)
def jn16(spark, sf):
    # the source value is the product of its indices, which bilinear interpolation reproduces exactly
    return regrid.bilinear(source_grid(spark, sf), v.grid_points(spark, sf), ["val"]).select("lat", "lon", r("val", 5))


VIEW_SQL["v_src_nulls"] = """SELECT lat, lon, CASE WHEN (round((lat - 6) / 1.7) + round((lon - 66) / 1.7))::INT % 7 <> 3 THEN val END AS val FROM v_src_grid"""
VIEW_SQL["v_lat_parts"] = """SELECT lat, unnest([lo, hi]) AS slat, unnest([1 - f, f]) AS wlat FROM (SELECT *, CASE WHEN hi = lo THEN 0 ELSE (lat - lo) / (hi - lo) END AS f FROM (
  SELECT lat, (SELECT max(s.lat) FROM v_src_nulls s WHERE s.lat <= t.lat) AS lo, (SELECT min(s.lat) FROM v_src_nulls s WHERE s.lat >= t.lat) AS hi FROM (SELECT DISTINCT lat FROM v_points) t))"""
VIEW_SQL["v_lon_parts"] = VIEW_SQL["v_lat_parts"].replace("lat", "lon")


@query("jn16_null_corners", """SELECT p.lat, p.lon, CASE WHEN abs(sum(CASE WHEN val IS NOT NULL THEN wlat * wlon END) - 1) < 1e-9 THEN round(sum(wlat * wlon * val), 5) END AS val
   FROM v_points p JOIN v_lat_parts a ON a.lat = p.lat AND wlat > 0 JOIN v_lon_parts b ON b.lon = p.lon AND wlon > 0 JOIN v_src_nulls s ON s.lat = slat AND s.lon = slon GROUP BY p.lat, p.lon""")
def jn16_nulls(spark, sf):
    i, j = F.round((F.col("lat") - 6) / 1.7), F.round((F.col("lon") - 66) / 1.7)
    holed = source_grid(spark, sf).withColumn("val", F.when((i + j).cast("int") % 7 != 3, F.col("val")))
    return regrid.bilinear(holed, v.grid_points(spark, sf), ["val"]).select("lat", "lon", r("val", 5))


@query(
    "jn11_match_polygons",
    """SELECT r.k, r.req, count(p.district) AS n, min(p.state) AS state FROM
       (SELECT c_custkey AS k, n_name AS req, CASE WHEN c_custkey % 2 = 0 THEN r_name ELSE 'ELSEWHERE' END AS st FROM customer JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey) r
       JOIN (SELECT DISTINCT state, district FROM v_edges) p ON p.district = r.req GROUP BY ALL""",
)
def jn11(spark, sf):
    c = v.table(spark, sf, "customer")
    n, g = v.table(spark, sf, "nation"), v.table(spark, sf, "region")
    names = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(g, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("c_custkey").alias("k"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("r_name")).otherwise("ELSEWHERE").alias("state"),
        F.concat(F.substring("n_name", 1, 3), F.lit(" "), F.expr("substring(n_name, 4)")).alias("district"),
        F.col("n_name").alias("req"),
    )
    m = region.match_polygons(names, v.polygons(spark, sf))
    return m.groupBy("k", "req").agg(F.count("poly").alias("n"), F.min("poly.state").alias("state"))


@query(
    "jn12_resolve_names",
    """WITH roster AS (SELECT DISTINCT r_name AS state, CASE WHEN n_nationkey < 10 THEN 'Shared' ELSE n_name END AS district FROM nation JOIN region ON n_regionkey = r_regionkey),
       q AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'shared' WHEN c_custkey % 4 = 1 THEN 'nowhere' ELSE lower(n_name) END AS district
             FROM customer JOIN nation ON c_nationkey = n_nationkey)
       SELECT q.id, q.district, count(DISTINCT r.state) AS n_states,
         CASE count(DISTINCT r.state) WHEN 0 THEN 'not_found' WHEN 1 THEN 'ok' ELSE 'ambiguous' END AS status,
         CASE WHEN count(DISTINCT r.state) = 1 THEN min(r.district) || ' district, ' || min(r.state) END AS label
       FROM q LEFT JOIN roster r ON regexp_replace(lower(r.district), '[^a-z0-9]', '', 'g') = regexp_replace(lower(q.district), '[^a-z0-9]', '', 'g') GROUP BY ALL""",
)
def jn12(spark, sf):
    n, g, c = v.table(spark, sf, "nation"), v.table(spark, sf, "region"), v.table(spark, sf, "customer")
    roster = n.join(g, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("state"),
        F.when(F.col("n_nationkey") < 10, "Shared").otherwise(F.col("n_name")).alias("district"),
    )
    k = F.col("c_custkey") % 4
    req = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"),
        F.lit(None).cast("string").alias("state"),
        F.when(k == 0, "shared").when(k == 1, "nowhere").otherwise(F.lower("n_name")).alias("district"),
    )
    return region.resolve_names(req, roster).select("id", "district", "n_states", "status", "label")


@query(
    "jn12_name_hints",
    """WITH roster AS (SELECT DISTINCT n_name AS district FROM nation), q AS (SELECT DISTINCT substring(c_name, 1, 0) || lower(substring(n_name, 3, 4)) AS district
       FROM customer JOIN nation ON c_nationkey = n_nationkey)
       SELECT q.district, r.district AS hint FROM q JOIN roster r ON contains(lower(r.district), lower(q.district))""",
)
def jn12_hints(spark, sf):
    n, c = v.table(spark, sf, "nation"), v.table(spark, sf, "customer")
    req = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.lower(F.substring("n_name", 3, 4)).alias("district")).distinct()
    return region.substring_hints(req, n.select(F.col("n_name").alias("district")))
