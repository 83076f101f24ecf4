"""File scans, sinks, repeated stages and streaming ingest on real folders."""

from pyspark.sql import functions as F

from skyfold import schemas
from skyfold.operators import grid, records
from skyfold.plans import source_queries
from skyfold.sources import grids, sinks
from skyfold.sources import records as src
from skyfold.streaming import ingest


def test_roster_falls_back(spark, tmp_path):
    assert src.read_roster(spark, str(tmp_path / "none.csv")).count() == len(src.FALLBACK_DISTRICTS)


def test_observed_csv(spark, tmp_path):
    path = tmp_path / "o.csv"
    path.write_text(
        "state,district,rainfall_since_june_1_pct_departure,rainfall_last_7_days_pct_departure,rainfall_last_14_days_pct_departure,monsoon_onset_status,obs_asof\n"
        "A,B,2.5,999,n/a,,2026-07-08\nA,C,-100.6,3.5,-7,active,\n"
    )
    rows = [tuple(r) for r in src.read_observed(spark, str(path)).orderBy("district").collect()]
    assert rows == [("A", "B", 2, 300, 0, "normal", "2026-07-08"), ("A", "C", -100, 4, -7, "active", "")]


def test_weekly_and_odds_csv(spark, tmp_path):
    w = tmp_path / "w.csv"
    w.write_text("region,state,district,week,valid_week,model,precip_anom_mm_day,t2m_anom_degC,n_models,init_date,geom\nr,S,D,1,x,,1.5,,2,20260711,point\nr,S,D,1,x,GEFS,,0.2,1,20260711,point\n")
    got = {r["model"]: (r["precip"], r["t2m"]) for r in src.read_weekly(spark, str(w)).collect()}
    assert got == {"MME": (1.5, None), "GEFS": (None, 0.2)}


def test_merge_twice_keeps_the_baseline(spark):
    rec = spark.createDataFrame(
        [("S", "D", "2026-06-24", "own note", 1.0, -2.0)], "state string, district string, forecast_date string, imd_source_notes string, a double, b double"
    )
    for w in (1, 2, 3, 4):
        rec = rec.withColumn(f"week{w}_rainfall_anomaly_mm_day", F.col("a")).withColumn(f"week{w}_tmax_anomaly_degC", F.col("b"))
    for c in ("week1_rainfall_signal", "week2_rainfall_signal", "week3_4_rainfall_signal", "tmax_signal", "seasonal_monsoon_context"):
        rec = rec.withColumn(c, F.lit("near_normal"))
    s2s = spark.createDataFrame(
        [("s ", "d", 1, "MME", 4.0, 2.0, "20260711"), ("S", "D", 1, "GEFS", 4.0, None, "20260711"), ("S", "D", 4, "MME", -6.0, 0.0, "20260711")],
        "state string, district string, week int, model string, precip double, t2m double, init_date string",
    )
    context = spark.createDataFrame([("S", "D", "above_normal", 0.125)], "state string, district string, context string, net double")
    once = records.merge_weekly(rec, s2s, context).drop("updated")
    twice = records.merge_weekly(once, s2s, context).first()
    assert twice["forecast_variants"] == once.first()["forecast_variants"]
    base = twice["forecast_variants"][0]
    assert (base["key"], base["source"], base["weeks"][0]["rainfall_mm_day"]) == ("IMD", "own note", 1.0)
    assert [x["key"] for x in twice["forecast_variants"]] == ["IMD", "MME", "GEFS"]
    assert (twice["week1_rainfall_signal"], twice["week3_4_rainfall_signal"], twice["tmax_signal"]) == ("above_normal", "below_normal", "above_normal")
    assert twice["forecast_source"] == "S2S multi-model mean (GEFS) init 2026-07-11; seasonal SEAS5+SFS -> above_normal (net +0.12)"
    assert twice["imd_source_notes"] == "own note [forecast fields: model import]: " + twice["forecast_source"]
    assert twice["week2_rainfall_anomaly_mm_day"] is None


def test_grid_partitions_prune_and_replace(spark, tmp_path):
    path = str(tmp_path / "grid")
    rows = [(m, "2026-07-11", "members", "m1", 24, 10.0, 70.0, 1.0, x) for m, x in (("A", 1.0), ("B", 2.0))]
    make = lambda r: spark.createDataFrame(r, schemas.GRID_LEAD.replace("init_date date", "init_date string")).withColumn("init_date", F.col("init_date").cast("date"))
    grids.write_grid(make(rows), path)
    grids.write_grid(make([(*rows[0][:-1], 9.0)]), path)
    assert {r["model"]: r["precip"] for r in grids.read_grid(spark, path).collect()} == {"A": 9.0, "B": 2.0}
    plan = grids.read_grid(spark, path, ["A"], "2026-07-11")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "model" in plan.split("PartitionFilters")[1].split("]")[0]


def test_stage_written_once(spark, tmp_path):
    path = str(tmp_path / "stage")
    assert sinks.write_if_missing(spark.range(3), path)
    assert not sinks.write_if_missing(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3
    assert sinks.write_if_missing(spark.range(9), path, force=True)
    assert spark.read.parquet(path).count() == 9


def test_ingest_skips_landed_files_and_survives_a_rerun(spark, sf, tmp_path):
    landing, target, marks = (str(tmp_path / n) for n in ("landing", "weekly", "marks"))
    rows = source_queries.grid_table(spark, sf)
    for models in (["click", "view"], ["error"], []):
        if models:
            rows.where(F.col("model").isin(models)).write.mode("append").parquet(landing)
        ingest.ingest(spark, landing, schemas.GRID_LEAD, target, marks, files_per_batch=2).awaitTermination()
    got = ingest.weekly_table(spark, target)
    want = grid.to_weekly(rows.where("model in ('click', 'view', 'error')"), ["model", "init_date", "member", "lat", "lon"], {"t2m": "mean", "precip": "mean"})
    near = got.alias("g").join(want.alias("w"), ["model", "member", "lat", "lon", "week"]).where(
        (F.abs(F.col("g.t2m") - F.col("w.t2m")) < 1e-9) & (F.abs(F.col("g.precip") - F.col("w.precip")) < 1e-9)
    )
    assert got.count() == want.count() == near.count() > 0
