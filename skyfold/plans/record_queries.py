"""Record, matching, rule and advisory queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyfold.functions import labels, signals, text
from skyfold.operators import advisory, dedup, forecast, matching, ordered, records, rules
from skyfold.plans import views as v
from skyfold.plans.grid_queries import r, up, weekly_means
from skyfold.plans.registry import VIEW_SQL, query
from skyfold.plans.scratch import scratch
from skyfold.sources import library as lib

CONTEXTS = [
    {"user_type": "farmer", "crop": "rice", "irrigation_status": "rainfed", "crop_stage": "not_sown"},
    {"user_type": "farmer", "crop": "rice", "irrigation_status": "rainfed", "crop_stage": "vegetative"},
    {"user_type": "farmer", "crop": "", "irrigation_status": "assured_irrigation", "crop_stage": "flowering"},
    {"user_type": "farmer", "crop": "rice", "irrigation_status": "rainfed", "crop_stage": "harvesting"},
    {"user_type": "livestock_owner", "irrigation_status": "unknown"},
    {"user_type": "outdoor_worker", "irrigation_status": "unknown"},
    {"user_type": "ngo_/_extension_worker", "irrigation_status": "unknown"},
    {"user_type": "health_worker", "irrigation_status": "unknown"},
]


def prepared(spark, sf):
    return rules.with_inputs(v.records(spark, sf))


def sql_text(s):
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


VIEW_SQL["v_contexts"] = (
    "SELECT * FROM (VALUES "
    + ", ".join(
        f"({i}, {sql_text(c['user_type'].replace('_/_', '_'))}, {sql_text(c.get('crop'))}, {sql_text(c['irrigation_status'])}, {sql_text(c.get('crop_stage'))})"
        for i, c in enumerate(CONTEXTS)
    )
    + ") t(context_id, user_type, crop, irrigation, ctx_stage)"
)

# --- rules ----------------------------------------------------------------

_TRAJ = """(wk1 <= -3)::INT + (wk2 <= -3)::INT + (wk3 <= -3)::INT + (wk4 <= -3)::INT AS below,
  (wk1 >= 3)::INT + (wk2 >= 3)::INT + (wk3 >= 3)::INT + (wk4 >= 3)::INT AS above, (wk2 + wk3 + wk4) / 3.0 AS later,
  wk1 <= -3 AND (wk2 + wk3 + wk4) / 3.0 > -1 AS relief, wk1 >= -1 AND (wk2 + wk3 + wk4) / 3.0 <= -3 AS drying,
  greatest(wk1, wk2, wk3, wk4) AS peak"""
VIEW_SQL["v_traj"] = f"SELECT *, 0 AS context_id, {_TRAJ} FROM v_record"
VIEW_SQL["v_rc"] = f"""SELECT * EXCLUDE (stage, ctx_stage), ctx_stage AS stage, {_TRAJ} FROM v_record, v_contexts"""


def signed_sql(x, d):
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '+' END || format('{{:.{d}f}}', abs({x})))"


def unsigned_sql(x, d):
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || format('{{:.{d}f}}', abs({x})))"


def _wk(i):
    x = f"wk{i}"
    return (
        f"'Wk{i}=' || CASE WHEN {x} >= 3 THEN '+' || {unsigned_sql(x, 0)} || ' (above)' WHEN {x} <= -3 THEN {unsigned_sql(x, 0)} || ' (below)' "
        f"ELSE {signed_sql(x, 0)} || ' (near normal)' END"
    )


OUTLOOK = "('4-week outlook (mm/day anomaly): ' || " + " || ', ' || ".join(_wk(i) for i in (1, 2, 3, 4)) + ")"


def _dep(prefix, x):
    return f"('{prefix} is ' || abs({x}) || '% ' || CASE WHEN {x} < 0 THEN 'below' ELSE 'above' END || ' normal')"


def _join(*parts):
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda z: z IS NOT NULL), ' | ')"


_STAGE = "('Crop stage: ' || coalesce(stage, 'unknown'))"
_R14 = _dep("Rainfall in last 14 days", "r14")
_SCEN = [
    (
        "heat_stress", "Heat stress", "heat_wave OR tmax = 'above_normal' OR tmin = 'above_normal' OR humidity = 'high'",
        "heat_wave AND humidity = 'high'", "heat_wave OR (tmax = 'above_normal' AND tmin = 'above_normal')",
        "CASE WHEN heat_wave OR tmax = 'above_normal' THEN 'High' ELSE 'Medium' END",
        _join("CASE WHEN heat_wave THEN 'Heat wave warning in effect' END", "CASE WHEN tmax = 'above_normal' THEN 'Above-normal maximum temperatures' END",
              "CASE WHEN tmin = 'above_normal' THEN 'Above-normal minimum temperatures' END", "CASE WHEN humidity = 'high' THEN 'High humidity and heat index' END"),
    ),
    (
        "delayed_monsoon", "Delayed monsoon / delayed sowing", "onset IN ('not_started', 'delayed') AND since_jun1 <= -25 AND s1 = 'below_normal'",
        "below >= 3 AND since_jun1 <= -40", "below >= 2 OR since_jun1 <= -35", "'High'",
        _join(_dep("Rainfall since June 1", "since_jun1"), "CASE onset WHEN 'delayed' THEN 'Monsoon onset status is delayed' WHEN 'not_started' THEN 'Monsoon has not started yet' END",
              OUTLOOK, f"CASE WHEN relief THEN '{rules.SAYS_RELIEF}' WHEN below >= 3 THEN '{rules.SAYS_DRY}' END"),
    ),
    (
        "early_season_dry_spell", "Early-season dry spell", "stage IN ('recently_sown', 'vegetative') AND r14 <= -30 AND s1 = 'below_normal'",
        "r14 <= -50 AND below >= 3", "(r14 <= -50 AND relief) OR r14 <= -40", "'High'",
        _join(_R14, _STAGE, OUTLOOK, f"CASE WHEN relief THEN '{rules.SAYS_RELIEF_HOLD}' WHEN below >= 3 THEN '{rules.SAYS_DRY}' END"),
    ),
    (
        "mid_season_break", "Mid-season monsoon break",
        "stage IN ('vegetative', 'flowering') AND onset IN ('active', 'weak') AND r14 <= -40 AND s1 = 'below_normal'",
        "below >= 3 AND r14 <= -60", "below >= 2 OR r14 <= -50", "'High'",
        _join(_R14, _STAGE, "('Monsoon status: ' || onset)", OUTLOOK, f"CASE WHEN relief THEN '{rules.SAYS_RELIEF_BREAK}' WHEN below >= 3 THEN '{rules.SAYS_DRY_BREAK}' END"),
    ),
    (
        "terminal_drought", "Terminal drought / early withdrawal risk", "stage IN ('flowering', 'harvesting') AND r14 <= -40 AND s1 = 'below_normal'",
        "below >= 3 AND r14 <= -50", "below >= 2 OR r14 <= -50", "'High'",
        _join(_R14, f"({_STAGE} || ' (critical reproductive phase)')", OUTLOOK, f"CASE WHEN below >= 3 THEN '{rules.SAYS_DRY_TERMINAL}' WHEN relief THEN '{rules.SAYS_RELIEF_PARTIAL}' END"),
    ),
    (
        "excess_rainfall_waterlogging", "Excess rainfall / waterlogging", "(heavy_rain OR peak >= 7) AND NOT (since_jun1 <= -20 AND peak < 7)",
        "heavy_rain AND (above >= 3 OR peak >= 7)", "heavy_rain OR peak >= 10 OR above >= 3",
        "CASE WHEN heavy_rain OR greatest(wk1, wk2) >= 7 THEN 'High' ELSE 'Medium' END",
        _join("CASE WHEN heavy_rain THEN 'Heavy rainfall warning in effect' END", f"('Peak rainfall anomaly: +' || {unsigned_sql('peak', 0)} || ' mm/day above normal')",
              OUTLOOK, f"CASE WHEN above >= 3 THEN '{rules.SAYS_WET}' END"),
    ),
]


def _scen_sql(source):
    parts = [
        f"SELECT k, context_id, '{name}' AS scenario, '{display}' AS display_name, {i} AS rule_pos, "
        f"CASE WHEN {severe} THEN 'Severe' WHEN {alert} THEN 'Alert' ELSE 'Watch' END AS risk_level, {conf} AS confidence, {reasons} AS reasons FROM {source} WHERE {fires}"
        for i, (name, display, fires, severe, alert, conf, reasons) in enumerate(_SCEN)
    ]
    return (
        "SELECT *, row_number() OVER (PARTITION BY k, context_id ORDER BY CASE risk_level WHEN 'Severe' THEN 3 WHEN 'Alert' THEN 2 ELSE 1 END DESC, rule_pos) - 1 AS scenario_rank FROM ("
        + " UNION ALL ".join(parts) + ")"
    )


VIEW_SQL["v_scen"] = _scen_sql("v_traj")
VIEW_SQL["v_scen_ctx"] = _scen_sql("v_rc")


def _one_rule(name):
    def run(spark, sf):
        fired = rules.classify(v.records(spark, sf), {name: rules.RULES[name]})
        return fired.select("k", "scenario", "risk_level", "confidence")

    return run


for _i, (_name, *_rest) in enumerate(_SCEN, 1):
    query(f"sr{_i}_{_name}", f"SELECT k, scenario, risk_level, confidence FROM v_scen WHERE scenario = '{_name}'")(_one_rule(_name))


@query("sr7_reasons", "SELECT k, scenario, reasons FROM v_scen")
def sr7(spark, sf):
    return rules.classify(v.records(spark, sf)).select("k", "scenario", F.array_join("reasons", " | ").alias("reasons"))


@query("sr8_classify_all", "SELECT k, scenario_rank, scenario, display_name, risk_level, confidence FROM v_scen")
def sr8(spark, sf):
    return rules.classify(v.records(spark, sf)).select(
        "k", "scenario_rank", "scenario", "display_name", "risk_level", "confidence"
    )


@query("sl1_severity_order", "SELECT k, array_to_string(list(scenario ORDER BY scenario_rank), '>') AS scenarios FROM v_scen GROUP BY k")
def sl1(spark, sf):
    s = F.transform(rules.scenarios(), lambda x: x["scenario"])
    return prepared(spark, sf).select("k", s.alias("s")).where(F.size("s") > 0).select("k", F.array_join("s", ">").alias("scenarios"))


@query("ag24_trajectory", """SELECT k, below AS below_count, above AS above_count, round((wk1 + wk2 + wk3 + wk4) / 4, 6) AS avg_anomaly, round(later, 6) AS later,
   relief, drying, below >= 3 AS all_dry, above >= 3 AS all_wet, peak FROM v_traj""")
def ag24(spark, sf):
    x = rules.inputs()
    avg = (x.weeks[0] + x.weeks[1] + x.weeks[2] + x.weeks[3]) / 4.0
    return prepared(spark, sf).select(
        "k", x.below_count.alias("below_count"), x.above_count.alias("above_count"), F.round(avg, 6).alias("avg_anomaly"),
        F.round(x.later, 6).alias("later"), x.relief.alias("relief"), x.drying.alias("drying"),
        x.all_dry.alias("all_dry"), x.all_wet.alias("all_wet"), x.peak.alias("peak"),
    )


@query("ag25_overall_risk", """SELECT r.k, coalesce(max(CASE WHEN scenario_rank = 0 THEN risk_level END), 'Low') AS overall_risk
   FROM v_record r LEFT JOIN v_scen s ON s.k = r.k GROUP BY r.k""")
def ag25(spark, sf):
    return prepared(spark, sf).select("k", rules.overall_risk(rules.scenarios()).alias("overall_risk"))


@query("jn33_records_by_contexts", """SELECT context_id, user_type, count(*) AS n, count(DISTINCT k) AS n_records FROM v_rc GROUP BY ALL""")
def jn33(spark, sf):
    ctx = advisory.prepare_contexts(v.records(spark, sf), CONTEXTS)
    return ctx.groupBy("context_id", "user_type").agg(F.count("*").alias("n"), F.count_distinct("k").alias("n_records"))


@query("ud1_extra_rule", """SELECT k, scenario_rank, scenario FROM (SELECT k, scenario, row_number() OVER (PARTITION BY k ORDER BY sev DESC, pos) - 1 AS scenario_rank FROM (
   SELECT k, scenario, rule_pos AS pos, CASE risk_level WHEN 'Severe' THEN 3 WHEN 'Alert' THEN 2 ELSE 1 END AS sev FROM v_scen
   UNION ALL SELECT k, 'cold_week', 6, 2 FROM v_record WHERE t1 <= -3))""")
def ud1(spark, sf):
    def cold_week(x):
        t = F.col("week1_tmax_anomaly_degC")
        return rules.Rule("Cold week", F.coalesce(t <= -3.0, F.lit(False)), F.lit("Alert"), F.lit("High"), (F.lit("Cold week ahead"),), ("local",))

    return rules.classify(v.records(spark, sf), {**rules.RULES, "cold_week": cold_week}).select("k", "scenario_rank", "scenario")


# --- merge of model output -------------------------------------------------

VIEW_SQL["v_s2s"] = """
WITH m AS (SELECT cell, week, model, round(precip + 1e-9, 3) AS precip, round(t2m + 1e-9, 3) AS t2m FROM v_anom_mean),
 a AS (SELECT * FROM m UNION ALL SELECT cell, week, 'MME', round(avg(precip) + 1e-9, 3), round(avg(t2m) + 1e-9, 3) FROM m GROUP BY cell, week)
SELECT upper(n_name) || ' ' AS state, CASE WHEN c_custkey % 10 = 0 THEN c_name || ' NEW' ELSE upper(c_name) END AS district,
  lower(n_name) AS ks, lower(CASE WHEN c_custkey % 10 = 0 THEN c_name || ' NEW' ELSE c_name END) AS kd, c_custkey AS k,
  week, model, precip, t2m FROM a JOIN customer ON cell = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


def s2s(spark, sf):
    return s2s_of(spark, sf, weekly_means(spark, sf))


def s2s_places(spark, sf):
    """Cells with the district that each of them is."""
    c, n = v.table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"), v.table(spark, sf, "nation").select("n_nationkey", "n_name")
    name = F.when(F.col("c_custkey") % 10 == 0, F.concat("c_name", F.lit(" NEW"))).otherwise(F.upper("c_name"))
    named = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("cell"), F.concat(F.upper("n_name"), F.lit(" ")).alias("state"), name.alias("district")
    )
    return v.cells(spark, sf).select("cell", "lat", "lon").join(named, "cell")


def s2s_of(spark, sf, means):
    """Weekly model rows of the districts, and their multi-model mean, from means by model, cell and week."""
    anomaly = forecast.weekly_anomaly(means, v.clim_weekly(spark, sf), ["cell", "week"], ["t2m", "precip"])
    m = anomaly.select("cell", "week", "model", up("precip", 3), up("t2m", 3))
    mme = m.groupBy("cell", "week").agg(up(F.avg("precip"), 3).alias("precip"), up(F.avg("t2m"), 3).alias("t2m"))
    both = m.unionByName(mme.withColumn("model", F.lit("MME")))
    return both.join(s2s_places(spark, sf), "cell").select(
        "state", "district", "week", "model", "precip", "t2m", F.lit("20240101").alias("init_date"),
    )


VIEW_SQL["v_s2s_wide"] = """SELECT ks, kd, min(state) AS state, min(district) AS district,
  max(precip) FILTER (model = 'MME' AND week = 1) AS p1, max(precip) FILTER (model = 'MME' AND week = 2) AS p2,
  max(precip) FILTER (model = 'MME' AND week = 3) AS p3, max(precip) FILTER (model = 'MME' AND week = 4) AS p4,
  max(t2m) FILTER (model = 'MME' AND week = 1) AS q1,
  array_to_string(list_sort(list(DISTINCT model) FILTER (model <> 'MME')), ',') AS models FROM v_s2s GROUP BY ks, kd"""

_SIG = "CASE WHEN {0} >= {1} THEN 'above_normal' WHEN {0} <= -{1} THEN 'below_normal' ELSE 'near_normal' END"


@query("jn1_merge_weekly", f"""SELECT r.k, s.ks IS NOT NULL AS updated, CASE WHEN s.ks IS NOT NULL THEN s.p1 ELSE r.wk1 END AS wk1, CASE WHEN s.ks IS NOT NULL THEN s.p4 ELSE r.wk4 END AS wk4,
   CASE WHEN s.ks IS NOT NULL THEN {_SIG.format('s.p1', 3)} ELSE r.s1 END AS s1, CASE WHEN s.ks IS NOT NULL THEN {_SIG.format('s.q1', 1.5)} ELSE r.tmax END AS tmax,
   CASE WHEN s.ks IS NOT NULL THEN '2024-01-01' ELSE r.forecast_date END AS forecast_date,
   CASE WHEN s.ks IS NOT NULL THEN 'S2S multi-model mean (' || models || ') init 2024-01-01' END AS forecast_source,
   CASE WHEN s.ks IS NOT NULL THEN note || ' [forecast fields: model import]: S2S multi-model mean (' || models || ') init 2024-01-01' ELSE note END AS note
   FROM v_record r LEFT JOIN v_s2s_wide s ON s.ks = lower(trim(r.state)) AND s.kd = lower(trim(r.district))""")
def jn1(spark, sf):
    m = records.merge_weekly(v.records(spark, sf), s2s(spark, sf))
    return m.select(
        "k", "updated", F.col("week1_rainfall_anomaly_mm_day").alias("wk1"), F.col("week4_rainfall_anomaly_mm_day").alias("wk4"),
        F.col("week1_rainfall_signal").alias("s1"), F.col("tmax_signal").alias("tmax"), "forecast_date", "forecast_source",
        F.col("imd_source_notes").alias("note"),
    )


VIEW_SQL["v_odds_rows"] = """SELECT ks, kd, week, round_even(avg((precip >= 1)::INT), 3) AS w, count(*) AS n,
  array_to_string(list_sort(list(DISTINCT model)), ',') AS models FROM v_s2s WHERE model <> 'MME' GROUP BY ALL"""


def odds_rows(spark, sf):
    m = s2s(spark, sf).where("model <> 'MME'").select("state", "district", "week", "model", "precip", "t2m")
    return forecast.threshold_odds(m, ["state", "district", "week"]).withColumn("init_date", F.lit("20240101"))


@query("jn2_attach_odds_and_observed", """SELECT r.k, o.n_weeks, o.w_sum, coalesce(b.dep, r.since_jun1) AS since_june, coalesce(b.onset, r.onset) AS onset, b.src AS observed_source
   FROM v_record r LEFT JOIN (SELECT ks, kd, count(*) AS n_weeks, round(sum(w), 4) AS w_sum FROM v_odds_rows GROUP BY ALL) o ON o.ks = lower(r.state) AND o.kd = lower(r.district)
   LEFT JOIN (SELECT s_nationkey AS nk, s_suppkey AS sk, CAST(round_even(s_acctbal / 100.0, 0) AS BIGINT) AS dep, 'active' AS onset,
     'IMD 0.25deg gridded rainfall vs 1991-2020 normal, asof 2024-07-01' AS src FROM supplier) b ON b.sk = r.k""")
def jn2(spark, sf):
    recs = v.records(spark, sf)
    sup = v.table(spark, sf, "supplier")
    dep = F.bround(F.col("s_acctbal") / 100.0).cast("int")
    observed = recs.join(sup, F.col("k") == F.col("s_suppkey")).select(
        "state", "district", dep.alias("rainfall_since_june_1_pct_departure"), dep.alias("rainfall_last_7_days_pct_departure"),
        dep.alias("rainfall_last_14_days_pct_departure"), F.lit("active").alias("monsoon_onset_status"), F.lit("2024-07-01").alias("obs_asof"),
    )
    out = records.attach_observed(records.attach_odds(recs, odds_rows(spark, sf)), observed)
    weeks = F.col("weekly_probabilities.weeks")
    return out.select(
        "k", F.when(weeks.isNotNull(), F.size(weeks)).alias("n_weeks"),
        F.round(F.aggregate(F.transform(weeks, lambda w: w["p_wetter"]), F.lit(0.0), lambda a, b: a + b), 4).alias("w_sum"),
        F.col("rainfall_since_june_1_pct_departure").alias("since_june"), F.col("monsoon_onset_status").alias("onset"), "observed_source",
    )


@query("sc7_nested_odds", """SELECT ks, kd, count(*) AS n_weeks, min(week) AS first_week, array_to_string(list(week ORDER BY week), ',') AS weeks,
   arg_max(n, week) AS n_members, min(models) || ' ensemble' AS source FROM v_odds_rows GROUP BY ks, kd""")
def sc7(spark, sf):
    p = F.col("weekly_probabilities")
    return records.nest_odds(odds_rows(spark, sf)).select(
        F.col("_ks").alias("ks"), F.col("_kd").alias("kd"), F.size(p["weeks"]).alias("n_weeks"), p["weeks"][0]["week"].alias("first_week"),
        F.array_join(F.transform(p["weeks"], lambda w: w["week"].cast("string")), ",").alias("weeks"), p["n_members"].alias("n_members"), p["source"].alias("source"),
    )


@query("jn3_seed_missing", """SELECT state, district, since_june, onset FROM (SELECT state, district, since_jun1 AS since_june, onset FROM v_record)
   UNION ALL SELECT s.state, s.district, 0, 'normal' FROM v_s2s_wide s WHERE NOT EXISTS (SELECT 1 FROM v_record r WHERE lower(trim(r.state)) = s.ks AND lower(trim(r.district)) = s.kd)""")
def jn3(spark, sf):
    return records.seed_missing(v.records(spark, sf), s2s(spark, sf)).select(
        "state", "district", F.col("rainfall_since_june_1_pct_departure").alias("since_june"), F.col("monsoon_onset_status").alias("onset")
    )


@query("jn4_map_values", f"""SELECT c_custkey AS ck, r.wk1 AS value, CASE WHEN r.wk1 IS NULL THEN 'n/a' ELSE {signed_sql('r.wk1', 1)} || ' mm/day' END AS label
   FROM (SELECT c_custkey, lower(replace(replace(c_name, '#', ''), '-', '')) AS md, lower(replace(n_name, '_', '')) AS ms, c_custkey % 2 = 0 AS same FROM customer JOIN nation ON c_nationkey = n_nationkey) s
   LEFT JOIN (SELECT *, lower(replace(replace(district, '#', ''), '-', '')) AS md, lower(replace(state, '_', '')) AS ms FROM v_record) r ON r.md = s.md AND r.ms = s.ms AND s.same""")
def jn4(spark, sf):
    c, n = v.table(spark, sf, "customer"), v.table(spark, sf, "nation")
    name = F.when(F.col("c_custkey") % 2 == 0, F.upper(F.replace("c_name", F.lit("#"), F.lit(" ")))).otherwise("elsewhere")
    shapes = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("ck"), F.replace("n_name", F.lit("_"), F.lit(" ")).alias("state"), name.alias("district")
    )
    value = F.col("week1_rainfall_anomaly_mm_day")
    return records.map_values(shapes, v.records(spark, sf), value, signals.value_label(value, 1, "mm/day")).select("ck", "value", "label")


@query("jn5_lookup_or_default", """SELECT q.s_suppkey AS sk, coalesce(r.since_jun1, 0) AS since_june, coalesce(r.onset, 'normal') AS onset, r.k IS NOT NULL AS found
   FROM supplier q LEFT JOIN v_record r ON r.k = q.s_suppkey AND q.s_suppkey % 2 = 0""")
def jn5(spark, sf):
    recs = v.records(spark, sf)
    q = v.table(spark, sf, "supplier").join(recs.select("k", "state", "district"), F.col("s_suppkey") == F.col("k"), "left").select(
        F.col("s_suppkey").alias("sk"), F.upper("state").alias("state"),
        F.when(F.col("s_suppkey") % 2 == 0, F.lower("district")).otherwise("none").alias("district"),
    )
    out = records.lookup_or_default(q, recs, ["rainfall_since_june_1_pct_departure", "monsoon_onset_status"])
    return out.select("sk", F.col("rainfall_since_june_1_pct_departure").alias("since_june"), F.col("monsoon_onset_status").alias("onset"), "found")


@query("jn34_variant_week_value", """SELECT r.k, CASE WHEN v.n > 0 THEN v.precip ELSE r.wk2 END AS value FROM v_record r LEFT JOIN
   (SELECT kd, ks, max(precip) FILTER (week = 2 AND model = 'click') AS precip, count(*) FILTER (week = 2 AND model = 'click') AS n FROM v_s2s GROUP BY ALL) v
   ON v.ks = lower(r.state) AND v.kd = lower(r.district) AND v.n > 0""")
def jn34(spark, sf):
    recs = v.records(spark, sf)
    merged = records.merge_weekly(recs, s2s(spark, sf)).select("k", "forecast_variants")
    both = recs.select("k", F.col("week2_rainfall_anomaly_mm_day").alias("top")).join(merged, "k")
    return both.select("k", records.variant_week_value(F.lit("click"), "rainfall_mm_day", 2, "top").alias("value"))


@query("jn35_baseline_kept", """SELECT r.k, r.wk1 AS base_wk1, r.note AS base_source, 2 + s.n AS n_variants FROM v_record r JOIN
   (SELECT ks, kd, count(DISTINCT model) FILTER (model <> 'MME') AS n FROM v_s2s GROUP BY ALL) s ON s.ks = lower(r.state) AND s.kd = lower(r.district)""")
def jn35(spark, sf):
    once = records.merge_weekly(v.records(spark, sf), s2s(spark, sf)).drop("updated")
    twice = records.merge_weekly(once, s2s(spark, sf)).where("updated")
    base = F.col("forecast_variants")[0]
    return twice.select("k", base["weeks"][0]["rainfall_mm_day"].alias("base_wk1"), base["source"].alias("base_source"), F.size("forecast_variants").alias("n_variants"))


@query("ag32_variant_lists", """SELECT r.k, 'IMD,MME,' || s.models AS keys, s.n_weeks AS mme_weeks FROM v_record r JOIN
   (SELECT ks, kd, array_to_string(list_sort(list(DISTINCT model) FILTER (model <> 'MME')), ',') AS models, count(*) FILTER (model = 'MME') AS n_weeks FROM v_s2s GROUP BY ALL) s
   ON s.ks = lower(r.state) AND s.kd = lower(r.district)""")
def ag32(spark, sf):
    m = records.merge_weekly(v.records(spark, sf), s2s(spark, sf)).where("updated")
    return m.select("k", F.array_join(F.transform("forecast_variants", lambda x: x["key"]), ",").alias("keys"), F.size(F.col("forecast_variants")[1]["weeks"]).alias("mme_weeks"))


@query("ag26_weeks34_signal", f"""SELECT ks, kd, {_SIG.format('x', 3)} AS signal FROM (SELECT ks, kd, (coalesce(p3, 0) + coalesce(p4, 0)) / nullif((p3 IS NOT NULL)::INT + (p4 IS NOT NULL)::INT, 0) AS x FROM v_s2s_wide)""")
def ag26(spark, sf):
    late = s2s(spark, sf).where(F.col("week").isin(3, 4) & (F.col("model") == "MME"))
    base = s2s(spark, sf).select(text.merge_key(F.col("state")).alias("ks"), text.merge_key(F.col("district")).alias("kd")).distinct()
    avg = late.groupBy(text.merge_key(F.col("state")).alias("ks"), text.merge_key(F.col("district")).alias("kd")).agg(F.avg("precip").alias("x"))
    return base.join(avg, ["ks", "kd"], "left").select("ks", "kd", signals.rain_signal(F.col("x")).alias("signal"))


@query("rs1_weeks_to_wide", "SELECT ks, kd, p1, p2, p3, p4 FROM v_s2s_wide")
def rs1(spark, sf):
    mme = s2s(spark, sf).select(text.merge_key(F.col("state")).alias("ks"), text.merge_key(F.col("district")).alias("kd"), "week",
                                F.when(F.col("model") == "MME", F.col("precip")).alias("precip"))
    return records.weeks_to_wide(mme, ["ks", "kd"], {"precip": "p{w}"})


@query("rs2_weeks_to_long", """SELECT k, week, rain, temp FROM (SELECT k, 1 AS week, wk1 AS rain, t1 AS temp FROM v_record UNION ALL SELECT k, 2, wk2, t2 FROM v_record
   UNION ALL SELECT k, 3, wk3, t3 FROM v_record UNION ALL SELECT k, 4, wk4, t4 FROM v_record)""")
def rs2(spark, sf):
    return records.weeks_to_long(v.records(spark, sf), ["k"], {"rain": "week{w}_rainfall_anomaly_mm_day", "temp": "week{w}_tmax_anomaly_degC"})


@query("rs4_flatten_variants", """SELECT r.k, s.model AS key, s.week, s.precip AS rain FROM v_record r JOIN v_s2s s ON s.ks = lower(r.state) AND s.kd = lower(r.district)
   UNION ALL SELECT r.k, 'IMD', w, CASE w WHEN 1 THEN wk1 WHEN 2 THEN wk2 WHEN 3 THEN wk3 ELSE wk4 END FROM v_record r, range(1, 5) t(w)
   WHERE EXISTS (SELECT 1 FROM v_s2s s WHERE s.ks = lower(r.state) AND s.kd = lower(r.district))""")
def rs4(spark, sf):
    m = records.merge_weekly(v.records(spark, sf), s2s(spark, sf)).where("updated")
    return m.select("k", F.explode("forecast_variants").alias("v")).select("k", F.col("v.key").alias("key"), F.explode("v.weeks").alias("w")).select(
        "k", "key", F.col("w.week").alias("week"), F.col("w.rainfall_mm_day").alias("rain")
    )


@query("fn22_nested_access", "SELECT r.k, s.precip AS value FROM v_record r JOIN v_s2s s ON s.ks = lower(r.state) AND s.kd = lower(r.district) AND s.model = 'MME' AND s.week = 3")
def fn22(spark, sf):
    m = records.merge_weekly(v.records(spark, sf), s2s(spark, sf)).where("updated")
    mme = F.filter("forecast_variants", lambda x: x["key"] == "MME")[0]
    w3 = F.get(F.filter(mme["weeks"], lambda w: w["week"] == 3), F.lit(0))
    return m.where(w3.isNotNull()).select("k", w3["rainfall_mm_day"].alias("value"))


@query("pf17_numeric_sources", """SELECT r.k, s.model AS key FROM v_record r JOIN (SELECT DISTINCT ks, kd, model FROM v_s2s) s ON s.ks = lower(r.state) AND s.kd = lower(r.district)
   UNION ALL SELECT r.k, 'IMD' FROM v_record r WHERE EXISTS (SELECT 1 FROM v_s2s s WHERE s.ks = lower(r.state) AND s.kd = lower(r.district))""")
def pf17(spark, sf):
    m = records.merge_weekly(v.records(spark, sf), s2s(spark, sf)).where("updated")
    return records.numeric_sources(m, ["k"]).select("k", "key")


@query("jn32_update_numeric", """SELECT r.k, coalesce(CAST(CASE WHEN o.n % 2 = 0 THEN o.n END AS DOUBLE), r.since_jun1) AS since_june FROM v_record r
   LEFT JOIN (SELECT o_custkey AS ck, count(*) AS n FROM orders GROUP BY 1) o ON o.ck = r.k""")
def jn32(spark, sf):
    recs = v.records(spark, sf)
    n = v.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    upd = recs.select("k", "state", "district").join(n, F.col("k") == F.col("o_custkey")).select(
        "state", "district", F.when(F.col("n") % 2 == 0, F.col("n").cast("string")).otherwise("n/a").alias("value")
    )
    return records.update_numeric(recs, upd, "rainfall_since_june_1_pct_departure").select("k", F.col("rainfall_since_june_1_pct_departure").alias("since_june"))


@query("jn31_roster_diff", """SELECT coalesce(a.n, b.n) AS district, CASE WHEN b.n IS NULL THEN 'left_only' ELSE 'right_only' END AS side FROM
   (SELECT DISTINCT c_name || '/' || c_mktsegment AS n FROM customer) a FULL JOIN (SELECT DISTINCT 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || '/BUILDING' AS n FROM orders) b ON a.n = b.n
   WHERE a.n IS NULL OR b.n IS NULL""")
def jn31(spark, sf):
    left = v.table(spark, sf, "customer").select(F.lit("x").alias("state"), F.concat_ws("/", "c_name", "c_mktsegment").alias("district"))
    right = v.table(spark, sf, "orders").select(
        F.lit("x").alias("state"), F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit("/BUILDING")).alias("district")
    )
    return records.roster_diff(left, right).select("district", "side")


@query("st4_except", """SELECT DISTINCT c_nationkey AS nk, c_mktsegment AS seg FROM customer EXCEPT SELECT s_nationkey, CASE WHEN s_acctbal > 0 THEN 'BUILDING' ELSE 'MACHINERY' END FROM supplier""")
def st4(spark, sf):
    a = v.table(spark, sf, "customer").select(F.col("c_nationkey").alias("nk"), F.col("c_mktsegment").alias("seg")).distinct()
    b = v.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nk"), F.when(F.col("s_acctbal") > 0, "BUILDING").otherwise("MACHINERY").alias("seg"))
    return a.exceptAll(b.distinct())


# --- matching --------------------------------------------------------------

def alias_tables(spark, sf):
    n = v.table(spark, sf, "nation")
    states = n.select(F.lower("n_name").alias("alias"), F.concat(F.lit("State "), (F.col("n_nationkey") % 7).cast("string")).alias("name"), F.col("n_nationkey").alias("pos"))
    districts = v.table(spark, sf, "supplier").select(
        F.concat(F.lit("Customer#"), F.lpad((F.col("s_suppkey") % 40).cast("string"), 9, "0")).alias("alias"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("pos")
    )
    return states, districts


@query("jn6_aliases", """SELECT r.k, 'State ' || (n_nationkey % 7) AS resolved_state, coalesce(a.name, r.district) AS resolved_district FROM v_record r JOIN nation ON n_name = r.state
   LEFT JOIN (SELECT 'Customer#' || lpad(CAST(s_suppkey % 40 AS VARCHAR), 9, '0') AS alias, arg_max(s_name, s_suppkey) AS name FROM supplier GROUP BY 1) a ON a.alias = r.district""")
def jn6(spark, sf):
    states, districts = alias_tables(spark, sf)
    return matching.apply_aliases(v.records(spark, sf).select("k", "state", "district"), states, districts).select("k", "resolved_state", "resolved_district")


def fuzzy_inputs(spark, sf):
    """Part names as a roster by brand; the requests are the same names with a letter dropped."""
    p = v.table(spark, sf, "part")
    roster = p.select(F.col("p_brand").alias("state"), F.concat_ws(" ", "p_name", "p_type").alias("district")).distinct()
    full = F.concat_ws(" ", "p_name", "p_type")
    cut = 1 + F.col("p_partkey") % 5
    typed = F.when(F.col("p_partkey") % 3 == 0, F.upper(full)).otherwise(
        F.concat(F.substring(full, F.lit(1), cut), F.substring(full, cut + 2, F.length(full)))
    )
    return p.select(F.col("p_partkey").alias("id"), F.lower("p_brand").alias("state"), typed.alias("district")), roster


# a name without one of its n letters is at 2(n - 1) / (2n - 1) of the name it came from
VIEW_SQL["v_typed"] = """SELECT p_partkey AS id, lower(p_name || ' ' || p_type) AS match, p_partkey % 3 = 0 AS whole, length(p_name || ' ' || p_type) AS n FROM part"""


@query("jn7_fuzzy_match", "SELECT id, match, CASE WHEN whole THEN 1.0::DOUBLE ELSE round(2.0::DOUBLE * (n - 1) / (2 * n - 1), 6) END AS score FROM v_typed")
def jn7(spark, sf):
    names, roster = fuzzy_inputs(spark, sf)
    return matching.fuzzy_best(names, roster).select("id", "match", F.round("score", 6).alias("score"))


@query("jn8_exact_fuzzy_default", """SELECT id, match, CASE WHEN whole THEN 'exact' ELSE 'fuzzy' END AS how,
   CASE WHEN whole THEN 1.0::DOUBLE ELSE round(2.0::DOUBLE * (n - 1) / (2 * n - 1), 6) END AS score FROM v_typed""")
def jn8(spark, sf):
    names, roster = fuzzy_inputs(spark, sf)
    return matching.resolve_plans(names, roster).select("id", "match", "how", F.round("score", 6).alias("score"))


# --- sentences and advisory -------------------------------------------------

_T3 = "CASE WHEN {0} >= 3 THEN 'above normal' WHEN {0} <= -3 THEN 'below normal' ELSE 'near normal' END"
_L5 = "CASE WHEN {0} >= 7 THEN '{1[0]}' WHEN {0} >= 3 THEN '{1[1]}' WHEN {0} <= -7 THEN '{1[2]}' WHEN {0} <= -3 THEN '{1[3]}' ELSE '{1[4]}' END"
EN, HI = signals.OUTLOOK_LABELS_EN, signals.OUTLOOK_LABELS_HI


VIEW_SQL["v_summary_en"] = f"""SELECT k, CASE WHEN since_jun1 < -20 THEN 'Rainfall has been ' || abs(since_jun1) || '% below normal since June 1'
   WHEN since_jun1 > 20 THEN 'Rainfall has been ' || since_jun1 || '% above normal since June 1' ELSE 'Rainfall has been near normal since June 1' END || ', ' ||
   CASE WHEN below = 4 THEN 'the 4-week outlook shows persistently below-normal rainfall' WHEN above = 4 THEN 'the 4-week outlook shows sustained above-normal rainfall'
   WHEN relief THEN 'this week''s rainfall is ' || {_T3.format('wk1')} || ' but the outlook improves over weeks 2-4'
   WHEN drying THEN 'this week''s rainfall is ' || {_T3.format('wk1')} || ' but the outlook dries out over weeks 2-4'
   ELSE 'the 4-week rainfall outlook is mixed (' || {_T3.format('wk1')} || ' this week, ' || {_T3.format('wk4')} || ' by week 4)' END ||
   CASE WHEN heat_wave THEN ', and Heat stress is elevated with heat wave warnings in effect' WHEN tmax = 'above_normal' THEN ', and Above-normal temperatures are expected' ELSE '' END || '.' AS summary FROM v_traj"""


@query("ad1_summary_en", "SELECT k, summary FROM v_summary_en")
def ad1(spark, sf):
    return prepared(spark, sf).select("k", advisory.summary_en().alias("summary"))


VIEW_SQL["v_summary_hi"] = """SELECT k, CASE WHEN since_jun1 < -20 THEN '1 जून से वर्षा सामान्य से ' || abs(since_jun1) || '% कम रही है' WHEN since_jun1 > 20 THEN '1 जून से वर्षा सामान्य से ' || since_jun1 || '% अधिक रही है'
   ELSE '1 जून से वर्षा सामान्य के आसपास रही है' END || '। ' || CASE WHEN below = 4 THEN '4 सप्ताह के पूर्वानुमान में लगातार सामान्य से कम वर्षा दिख रही है' WHEN above = 4 THEN '4 सप्ताह के पूर्वानुमान में लगातार सामान्य से अधिक वर्षा दिख रही है'
   ELSE '4 सप्ताह का वर्षा पूर्वानुमान मिला-जुला है' END || CASE WHEN heat_wave THEN '। लू का खतरा बढ़ा हुआ है और लू की चेतावनी लागू है' WHEN tmax = 'above_normal' THEN '। सामान्य से अधिक तापमान की संभावना है' ELSE '' END || '।' AS summary FROM v_traj"""


@query("ad2_summary_hi", "SELECT k, summary FROM v_summary_hi")
def ad2(spark, sf):
    return prepared(spark, sf).select("k", advisory.summary_hi().alias("summary"))


_DESC = """CASE WHEN l2 = l3 AND l3 = l4 THEN l2 || ' rainfall throughout weeks 2-4' WHEN l2 = l3 THEN l2 || ' in weeks 2-3, shifting to ' || l4 || ' by week 4'
   WHEN l3 = l4 THEN l2 || ' in week 2, then ' || l3 || ' through weeks 3-4' ELSE l2 || ' in week 2, ' || l3 || ' in week 3, ' || l4 || ' by week 4' END"""
VIEW_SQL["v_labels"] = "SELECT *, " + ", ".join(f"{_L5.format(f'wk{i}', EN)} AS l{i}" for i in (1, 2, 3, 4)) + " FROM v_traj"
VIEW_SQL["v_desc"] = f"SELECT *, {_DESC} AS d FROM v_labels"


@query("wn13_weeks_2_4_phrase", "SELECT k, d AS phrase FROM v_desc")
def wn13(spark, sf):
    labels = tuple(signals.outlook_label(w) for w in rules.inputs().weeks[1:])
    return prepared(spark, sf).select("k", advisory.describe_later_weeks(labels).alias("phrase"))


VIEW_SQL["v_narrative_en"] = f"""SELECT k, 'This week: rainfall ' || l1 || ' (' || {signed_sql('wk1', 1)} || ' mm/day) ' ||
   CASE WHEN relief THEN 'Outlook improves — ' || d || '. Some relief expected.' WHEN drying THEN 'Caution — while this week is ' || l1 || ', the outlook dries: ' || d || '.'
   WHEN below = 4 THEN 'Persistent dry conditions expected across all 4 weeks.' WHEN above = 4 THEN 'Sustained above-normal rainfall expected across all 4 weeks.'
   ELSE upper(d[1]) || d[2:] || '.' END || CASE WHEN since_jun1 <= -30 THEN ' Season-to-date rainfall is ' || abs(since_jun1) || '% below normal — any above-normal rain is helpful for deficit recovery.'
   WHEN since_jun1 >= 20 THEN ' Season-to-date rainfall is ' || since_jun1 || '% above normal — additional heavy rain increases waterlogging risk.' ELSE '' END ||
   CASE WHEN t1 >= 2 THEN ' Temperatures are elevated (' || {signed_sql('t1', 1)} || '°C above normal this week).'
   WHEN t1 <= -2 THEN ' Temperatures are cooler than normal (' || {signed_sql('t1', 1)} || '°C this week), likely due to cloud cover.' ELSE '' END AS narrative FROM v_desc"""


@query("ad3_outlook_en", "SELECT k, narrative FROM v_narrative_en")
def ad3(spark, sf):
    return prepared(spark, sf).select("k", advisory.narrative_en().alias("narrative"))


VIEW_SQL["v_narrative_hi"] = f"""SELECT k, 'इस सप्ताह: वर्षा ' || {_L5.format('wk1', HI)} || ' (' || {signed_sql('wk1', 1)} || ' मिमी/दिन) ' ||
   CASE WHEN relief THEN 'पूर्वानुमान में सुधार है; अगले सप्ताहों में कुछ राहत की उम्मीद है।' WHEN drying THEN 'सावधानी: आगे के सप्ताहों में वर्षा कम हो सकती है।'
   WHEN below = 4 THEN 'सभी 4 सप्ताह में लगातार सूखी स्थिति की संभावना है।' WHEN above = 4 THEN 'सभी 4 सप्ताह में लगातार सामान्य से अधिक वर्षा की संभावना है।'
   ELSE 'सप्ताह 2-4 में वर्षा ' || {_L5.format('later', HI)} || ' रहने की संभावना है।' END ||
   CASE WHEN since_jun1 <= -30 THEN ' अब तक की वर्षा सामान्य से ' || abs(since_jun1) || '% कम है; अधिक वर्षा से कमी की भरपाई में मदद मिलेगी।'
   WHEN since_jun1 >= 20 THEN ' अब तक की वर्षा सामान्य से ' || since_jun1 || '% अधिक है; अतिरिक्त भारी वर्षा से जलभराव का जोखिम बढ़ सकता है।' ELSE '' END ||
   CASE WHEN t1 >= 2 THEN ' इस सप्ताह तापमान सामान्य से अधिक (' || {signed_sql('t1', 1)} || '°C) रहने की संभावना है।'
   WHEN t1 <= -2 THEN ' इस सप्ताह तापमान सामान्य से कम (' || {signed_sql('t1', 1)} || '°C) रहने की संभावना है।' ELSE '' END AS narrative FROM v_traj"""


@query("ad3_outlook_hi", "SELECT k, narrative FROM v_narrative_hi")
def ad3_hi(spark, sf):
    return prepared(spark, sf).select("k", advisory.narrative_hi().alias("narrative"))


def plan_rows(spark, sf):
    """Plan actions per district from orders: one action per order."""
    o = v.table(spark, sf, "orders")
    names = F.array(*[F.lit(n) for n in rules.RULES])
    recs = v.records(spark, sf).select("k", "state", "district")
    k = F.col("o_orderkey")
    return o.join(recs, F.col("o_custkey") == F.col("k")).select(
        "state", "district", F.get(names, (k % 6).cast("int")).alias("scenario"),
        F.when(k % 4 == 0, "livestock").otherwise("crop").alias("kind"), k.alias("pos"),
        F.concat(F.lit("Plan step "), k.cast("string"), F.lit(" for "), "o_orderpriority").alias("action"),
        F.when(k % 2 == 0, "Basmati Rice - late").otherwise("Maize").alias("crop"),
    )


_NAMES = "[" + ", ".join(f"'{n}'" for n in rules.RULES) + "]"
VIEW_SQL["v_plan"] = f"""SELECT o_custkey AS k, ({_NAMES})[CAST(o_orderkey % 6 AS INT) + 1] AS scenario, CASE WHEN o_orderkey % 4 = 0 THEN 'livestock' ELSE 'crop' END AS kind,
  o_orderkey AS pos, 'Plan step ' || o_orderkey || ' for ' || o_orderpriority AS action, CASE WHEN o_orderkey % 2 = 0 THEN 'Basmati Rice - late' ELSE 'Maize' END AS crop FROM orders"""


def _any(col, phrases):
    return "(" + " OR ".join(f"contains(lower({col}), '{p}')" for p in phrases) + ")"


_FITS = f"""coalesce(NOT ((stage IN ('flowering', 'flowering_reproductive', 'harvesting') AND {_any('text', advisory.SOWING_KEYWORDS)} AND NOT contains(lower(text), 're-sow'))
  OR (stage IN ('recently_sown', 'vegetative', 'not_sown') AND {_any('text', advisory.HARVEST_KEYWORDS)}) OR (stage IN ('not_sown', 'recently_sown') AND {_any('text', advisory.FLOWERING_KEYWORDS)})), true)"""
VIEW_SQL["v_fired"] = """SELECT s.k, s.context_id, s.scenario, s.scenario_rank AS rank, c.user_type, c.crop, c.irrigation, c.ctx_stage AS stage FROM v_scen_ctx s JOIN v_contexts c USING (context_id)"""
VIEW_SQL["v_lib_actions"] = f"""SELECT f.k, f.context_id, l.category, f.rank, CASE WHEN l.audience = 'all' THEN 1 ELSE 2 END AS block, l.pos, l.text, f.stage FROM v_fired f
  JOIN v_library l ON l.scenario = f.scenario AND l.audience IN ('all', f.user_type)
  WHERE NOT (l.audience = 'all' AND f.user_type = 'livestock_owner' AND {_any('l.text', advisory.CROP_KEYWORDS)})"""
VIEW_SQL["v_water_actions"] = f"""SELECT k, context_id, 'do_now' AS category, rank, 3 AS block, 0 AS pos, '{advisory.RAINFED_NOW}' AS text, stage FROM v_fired
   WHERE user_type = 'farmer' AND irrigation = 'rainfed' AND scenario IN {advisory.RAINFED_SCENARIOS}
  UNION ALL SELECT k, context_id, 'prepare', rank, 3, 0, '{advisory.RAINFED_PREPARE}', stage FROM v_fired WHERE user_type = 'farmer' AND irrigation = 'rainfed' AND scenario IN {advisory.RAINFED_SCENARIOS}
  UNION ALL SELECT k, context_id, 'do_now', rank, 3, 0, '{advisory.IRRIGATED_NOW}', stage FROM v_fired WHERE user_type = 'farmer' AND irrigation = 'assured_irrigation' AND scenario IN {advisory.IRRIGATED_SCENARIOS}"""
VIEW_SQL["v_people_actions"] = f"""SELECT f.k, f.context_id, l.category, f.rank, 5 AS block, l.pos, l.text, f.stage FROM v_fired f
  JOIN v_community l ON l.scenario = f.scenario AND l.audience = f.user_type"""
VIEW_SQL["v_plan_actions"] = """SELECT f.k, f.context_id, CASE WHEN p.kind = 'livestock' OR coalesce(f.crop, '') = '' OR contains(lower(p.crop), lower(f.crop)) THEN 'do_now' ELSE 'prepare' END AS category,
  f.rank, 4 AS block, p.pos, p.action AS text, f.stage FROM v_fired f JOIN v_plan p ON p.k = f.k AND p.scenario = f.scenario
  AND p.kind = CASE f.user_type WHEN 'farmer' THEN 'crop' WHEN 'livestock_owner' THEN 'livestock' END"""
VIEW_SQL["v_actions"] = f"""SELECT k, context_id, category, rank, block, pos, text FROM (SELECT * FROM v_lib_actions UNION ALL SELECT * FROM v_water_actions UNION ALL SELECT * FROM v_people_actions
  UNION ALL SELECT * FROM v_plan_actions) WHERE {_FITS}"""


def ctx_records(spark, sf):
    return advisory.prepare_contexts(v.records(spark, sf), CONTEXTS)


def keyed(df, spark, sf):
    """Replace the long name keys by the record number for compact output."""
    ids = v.records(spark, sf).select("k", "state", "district")
    return df.join(ids, ["state", "district"]).drop("state", "district")


def named_records(spark, sf):
    """Records with all record numbers of their name, which :func:`by_number` makes rows of: long action rows need no join."""
    recs = v.records(spark, sf)
    ks = recs.groupBy("state", "district").agg(F.collect_list(F.struct("k")).alias("ks"))
    return recs.drop("k").join(ks, ["state", "district"])


def by_number(rows):
    return rows.select(*(c for c in rows.columns if c not in ("state", "district", "ks")), F.inline("ks"))


def all_actions(spark, sf, records=None, keep=()):
    """Action rows of all records; plans meet the records before the contexts multiply them."""
    records = v.records(spark, sf) if records is None else records
    planned = records.join(advisory.district_plans(plan_rows(spark, sf), bags=False), ["state", "district"], "left")
    ctx = advisory.prepare_contexts(planned, CONTEXTS)
    return advisory.scenario_actions(ctx, CONTEXTS, v.action_library(spark, sf), v.community_library(spark, sf), keep=keep)


#: The contexts without a crop stage, so that the stage filter lets everything pass.
ANY_STAGE = [{**c, "crop_stage": None} for c in CONTEXTS]


@query("ad4_scenario_actions", "SELECT * FROM v_actions")
def ad4(spark, sf):
    return by_number(all_actions(spark, sf, named_records(spark, sf), ("ks",))).drop("evergreen", "concept")


@query("jn24_library_join", "SELECT k, context_id, category, rank, block, pos, text FROM v_lib_actions UNION ALL SELECT k, context_id, category, rank, block, pos, text FROM v_people_actions")
def jn24(spark, sf):
    path = scratch(spark, "library")
    v.action_library(spark, sf).write.option("header", True).csv(path)
    ctx = advisory.prepare_contexts(named_records(spark, sf), CONTEXTS)
    out = advisory.scenario_actions(ctx, ANY_STAGE, lib.read_action_library(spark, path), v.community_library(spark, sf), keep=("ks",))
    return by_number(out.where("block <> 3")).drop("evergreen", "concept")


@query("jn25_plan_by_crop", "SELECT k, context_id, category, rank, pos, text FROM v_plan_actions")
def jn25(spark, sf):
    ctx = ctx_records(spark, sf).withColumn("crop_stage", F.lit(None).cast("string"))
    out = advisory.scenario_actions(ctx, ANY_STAGE, v.action_library(spark, sf), v.community_library(spark, sf), plan_rows(spark, sf))
    return keyed(out.where("block = 4"), spark, sf).select("k", "context_id", "category", "rank", "pos", "text")


_FIELD = "user_type IN ('farmer', 'livestock_owner')"
_OFF = "user_type IN ('village_official', 'ngo_extension_worker')"
_BASE = [
    (f"wk1 >= 3 AND {_FIELD}", "do_now", sql_text(advisory.BASE_GOOD)),
    (f"wk1 >= 3 AND {_FIELD} AND since_jun1 <= -20", "do_now", sql_text(advisory.BASE_RECOVERY)),
    (f"wk1 > -3 AND wk1 < 3 AND {_FIELD}", "do_now", sql_text(advisory.BASE_NORMAL)),
    (f"later <= -3 AND {_FIELD}", "prepare", sql_text(advisory.BASE_DRYING)),
    (f"later <= -3 AND {_FIELD}", "prepare", sql_text(advisory.BASE_DRYING_2)),
    (f"later <= -3 AND {_OFF}", "prepare", sql_text(advisory.BASE_DRYING_COMMUNITY)),
    (f"later >= 3 AND {_FIELD}", "prepare", sql_text(advisory.BASE_WETTING)),
    (f"later >= 3 AND {_FIELD}", "prepare", sql_text(advisory.BASE_WETTING_2)),
    (f"since_jun1 <= -30 AND {_FIELD}", "prepare", "'Season-to-date rainfall is ' || abs(since_jun1) || '% below normal — prioritize moisture conservation'"),
    ("true", "do_now", sql_text(advisory.BASE_MONITOR)),
]
VIEW_SQL["v_quiet"] = "SELECT * FROM v_rc r WHERE NOT EXISTS (SELECT 1 FROM v_scen_ctx s WHERE s.k = r.k AND s.context_id = r.context_id)"
VIEW_SQL["v_baseline"] = " UNION ALL ".join(
    f"SELECT k, context_id, '{cat}' AS category, {txt} AS text, {i} AS i FROM v_quiet WHERE {cond}" for i, (cond, cat, txt) in enumerate(_BASE)
)


@query("ad5_baseline_actions", "SELECT k, context_id, category, text, row_number() OVER (PARTITION BY k, context_id ORDER BY i) - 1 AS pos FROM v_baseline")
def ad5(spark, sf):
    ctx = advisory.prepare_contexts(named_records(spark, sf), CONTEXTS)
    return by_number(advisory.baseline_actions(ctx, ("ks",))).select("k", "context_id", "category", "text", "pos")


@query("pf22_relevant_for_livestock", "SELECT category, text, count(*) AS n FROM v_lib_actions WHERE context_id = 4 AND block = 1 GROUP BY ALL")
def pf22(spark, sf):
    ctx = ctx_records(spark, sf).where("user_type = 'livestock_owner'")
    out = advisory.scenario_actions(ctx, CONTEXTS, v.action_library(spark, sf), v.community_library(spark, sf))
    return out.where("block = 1").groupBy("category", "text").agg(F.count("*").alias("n"))


VIEW_SQL["v_stage_lines"] = f"""SELECT doc_id, pos, line, ([{', '.join(sql_text(s) for s in v._STAGES)}])[CAST((doc_id + pos) % 5 AS INT) + 1] AS stage FROM v_lines"""


def staged_lines(spark, sf):
    """Document lines with keyword-bearing prefixes and a crop stage."""
    stages = F.array(*[F.lit(s) for s in v._STAGES])
    return v.lines(spark, sf).withColumn("stage", F.get(stages, ((F.col("doc_id") + F.col("pos")) % 5).cast("int")))


_WORDS = ("sow ", "Harvest ", "PANICLE ", "re-sow ", "monitor IMD ", "plain ")
VIEW_SQL["v_key_lines"] = f"""SELECT doc_id, pos, stage, ([{', '.join(sql_text(w) for w in _WORDS)}])[CAST((doc_id * 7 + pos) % 6 AS INT) + 1] || line AS text FROM v_stage_lines"""


def key_lines(spark, sf):
    words = F.array(*[F.lit(w) for w in _WORDS])
    return staged_lines(spark, sf).withColumn("text", F.concat(F.get(words, ((F.col("doc_id") * 7 + F.col("pos")) % 6).cast("int")), "line"))


@query("pf23_crop_stage_filter", f"SELECT stage, count(*) AS n, sum(length(text)) AS chars FROM v_key_lines WHERE {_FITS} GROUP BY stage")
def pf23(spark, sf):
    return key_lines(spark, sf).where(advisory.fits_crop_stage(F.col("text"), F.col("stage"))).groupBy("stage").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")
    )


@query("ad6_stage_filter_in_order", f"SELECT doc_id, array_to_string(list(pos ORDER BY pos), ',') AS kept FROM v_key_lines WHERE {_FITS} GROUP BY doc_id")
def ad6(spark, sf):
    kept = F.filter(
        F.transform(
            F.split("text", "\n"),
            lambda line, i: F.struct(
                i.alias("pos"),
                F.concat(F.get(F.array(*[F.lit(w) for w in _WORDS]), ((F.col("doc_id") * 7 + i) % 6).cast("int")), line).alias("text"),
                F.get(F.array(*[F.lit(s) for s in v._STAGES]), ((F.col("doc_id") + i) % 5).cast("int")).alias("stage"),
            ),
        ),
        lambda x: advisory.fits_crop_stage(x["text"], x["stage"]),
    )
    out = v.table(spark, sf, "documents").select("doc_id", kept.alias("k")).where(F.size("k") > 0)
    return out.select("doc_id", F.array_join(F.transform("k", lambda x: x["pos"].cast("string")), ",").alias("kept"))


@query("pf24_evergreen_split", f"SELECT stage, CASE WHEN {_any('text', advisory.EVERGREEN)} THEN 'general_guidance' ELSE 'do_now' END AS category, count(*) AS n FROM v_key_lines GROUP BY ALL")
def pf24(spark, sf):
    return key_lines(spark, sf).groupBy("stage", advisory.evergreen_category(F.col("text"), F.lit("do_now")).alias("category")).agg(F.count("*").alias("n"))


@query("dd1_exact_dedup", "SELECT doc_id, line, min(pos) AS pos FROM v_lines GROUP BY doc_id, line")
def dd1(spark, sf):
    return dedup.exact_first(v.lines(spark, sf).select("doc_id", "line", "pos"), ["doc_id"], "line", "pos")


_ORIGIN = "CASE category WHEN 'do_now' THEN 1 WHEN 'prepare' THEN 2 ELSE 3 END"


def split_sql(source):
    """Actions under their final category, each text once at its first place."""
    return f"""SELECT k, context_id, cat AS category, text, min(ROW(CASE WHEN cat = 'general_guidance' THEN o ELSE 0 END, rank, block, pos)) AS ord FROM (
  SELECT *, {_ORIGIN} AS o, CASE WHEN {_any('text', advisory.EVERGREEN)} THEN 'general_guidance' ELSE category END AS cat FROM {source}) GROUP BY ALL"""


VIEW_SQL["v_split"] = split_sql("v_actions")
_CONCEPT = "CASE " + " ".join(f"WHEN {_any('text', g)} THEN {i}" for i, g in enumerate(dedup.CONCEPTS)) + " END"


def merged_sql(source):
    """One text per concept and list, in order."""
    return f"""WITH u AS (SELECT *, {_CONCEPT} AS c, row_number() OVER (PARTITION BY k, context_id, category ORDER BY ord) AS n FROM {source})
   SELECT k, context_id, category, text, row_number() OVER (PARTITION BY k, context_id, category ORDER BY n) AS place FROM (
     SELECT k, context_id, category, text, n FROM u WHERE c IS NULL UNION ALL
     SELECT k, context_id, category, first(text ORDER BY length(text) DESC, n), min(n) FROM u WHERE c IS NOT NULL GROUP BY k, context_id, category, c)"""


@query("dd2_concept_dedup", merged_sql("v_split"))
def dd2(spark, sf):
    from pyspark.sql import Window

    keys = [*advisory.RECORD_KEY, "category"]
    # dealt anew as action rows: partitions sized before the contexts and lists multiply the rows would be sorted whole in a task.
    # The keys stand the other way round than in the join with the plans, whose partitioning would do otherwise.
    rows = advisory.separate_evergreen(all_actions(spark, sf, v.records(spark, sf))).repartition("district", "state")
    merged = dedup.concept_longest(dedup.exact_first(rows, [*keys, "concept"], "text", "order"), keys, "text", "order", known="concept")
    placed = merged.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("order")))
    return keyed(placed.drop("order"), spark, sf)


_STOP_LIST = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


def fold_sql(source):
    """The greedy overlap fold of ordered lists (``id, ts``) as a recursion over their places: ``id, kt``."""
    words = f"list_distinct(list_filter(string_split_regex(lower(t), '\\s+'), lambda w: length(w) > 2 AND NOT list_contains([{_STOP_LIST}], w)))"
    hit = "len(o) > 0 AND 2 * len(list_intersect(o, bag)) >= least(len(o), len(bag))"
    return f"""(WITH RECURSIVE s AS (SELECT id, ts, list_transform(ts, lambda t: {words}) AS bags FROM {source}),
  f(id, i, kt, kb) AS (SELECT id, 0, []::VARCHAR[], []::VARCHAR[][] FROM s
   UNION ALL SELECT id, i + 1,
     CASE WHEN near IS NULL THEN list_append(kt, t) WHEN length(t) > length(kt[near]) THEN list_concat(list_append(kt[:near - 1], t), kt[near + 1:]) ELSE kt END,
     CASE WHEN near IS NULL THEN list_append(kb, bag) WHEN length(t) > length(kt[near]) THEN list_concat(list_append(kb[:near - 1], bag), kb[near + 1:]) ELSE kb END
   FROM (SELECT id, i, kt, kb, t, bag, CASE WHEN len(bag) > 0 THEN nullif(coalesce(list_position(list_transform(kb, lambda o: {hit}), true), 0), 0) END AS near
     FROM (SELECT f.id, i, kt, kb, ts[i + 1] AS t, bags[i + 1] AS bag FROM f JOIN s ON s.id = f.id WHERE i < len(ts))))
  SELECT f.id, kt FROM f JOIN s ON s.id = f.id WHERE i = len(ts))"""


@query("dd3_overlap_fold", f"""SELECT id AS doc_id, len(kt) AS n_kept, array_to_string(kt, ' | ') AS kept
   FROM {fold_sql("(SELECT doc_id AS id, string_split(text, chr(10)) AS ts FROM documents)")}""")
def dd3(spark, sf):
    kept = dedup.overlap_fold(F.split("text", "\n"))
    return v.table(spark, sf, "documents").select("doc_id", kept.alias("k")).select(
        "doc_id", F.size("k").alias("n_kept"), F.array_join("k", " | ").alias("kept")
    )


@query("fn8_significant_words", """SELECT doc_id, pos, len(list_distinct(list_filter(string_split_regex(lower(line), '\\s+'), lambda w: length(w) > 2 AND NOT list_contains(["""
       + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + """], w)))) AS n FROM v_lines""")
def fn8(spark, sf):
    return v.lines(spark, sf).select("doc_id", "pos", F.size(text.significant_words(F.col("line"))).alias("n"))


def full_advisories(spark, sf):
    return advisory.advisories(
        v.records(spark, sf), CONTEXTS, v.action_library(spark, sf), v.community_library(spark, sf), plan_rows(spark, sf)
    )


def hindi_catalog(spark, sf):
    """Translations of every second library text, under spellings that the catalog's key evens out."""
    text_ = F.col("text")
    return v.action_library(spark, sf).where("pos % 4 < 2").select(
        "pos", F.concat(F.lit("  "), F.upper(text_), F.lit(".")).alias("source_text"), F.lit("hi").alias("lang"), F.concat(F.lit("हि "), text_).alias("text")
    )


def hindi_sql(t):
    """Hindi of a text: catalog, own texts, known phrases replaced. Needs ``known``, the catalog as a map, in scope."""
    own = "CASE " + t + " " + " ".join(f"WHEN {sql_text(en)} THEN {sql_text(hi)}" for en, hi in advisory.ACTIONS_HI.items())
    replaced = t
    for en, hi in advisory.PHRASES_HI.items():
        replaced = f"replace({replaced}, {sql_text(en)}, {sql_text(hi)})"
    return f"coalesce(known[{t}], {own} ELSE {replaced} END)"


VIEW_SQL["v_known_hi"] = "SELECT map(list(text), list('हि ' || text)) AS known FROM (SELECT DISTINCT text FROM v_library WHERE pos % 4 < 2)"


def lists_sql(source, hindi=False):
    """Capped lists with their overflow notes: ``k, context_id`` and one text per category."""
    over = {c: f"len({c}) - {n}" for c, n in advisory.CAPS.items()}
    templates = text.ACTION_TEMPLATES_HI if hindi else text.ACTION_TEMPLATES
    note = {c: "'" + templates[key].replace("%d", f"' || ({over[c]}) || '") + "'" for c, key in (("do_now", "additional_contingency"), ("prepare", "additional_preparatory"))}
    key = "k || '/' || context_id || '/' || category"
    folded = fold_sql(f"(SELECT {key} AS id, list(text ORDER BY place) AS ts FROM ({merged_sql(f'({split_sql(source)})')}) GROUP BY ALL)")
    columns = ", ".join(f"coalesce(any_value(kt) FILTER (WHERE split_part(id, '/', 3) = '{c}'), []) AS {c}" for c in advisory.CATEGORIES)

    def said(items):
        return f"list_transform({items}, lambda t: {hindi_sql('t')})" if hindi else items

    capped = ", ".join(f"array_to_string({said(f'{c}[:{n}]')}, ' | ') AS {c}" for c, n in advisory.CAPS.items())
    return f"""SELECT k, context_id, {capped}, array_to_string({said('avoid')}, ' | ') AS avoid, array_to_string(list_concat({said('general_guidance')}, list_filter([now_note,
     CASE WHEN {over['prepare']} > 0 AND now_note IS NULL AND len(list_filter(general_guidance, lambda g: contains(g, 'Additional contingency measures'))) = 0 THEN {note['prepare']} END],
     lambda z: z IS NOT NULL)), ' | ') AS general_guidance
   FROM (SELECT *, CASE WHEN {over['do_now']} > 0 THEN {note['do_now']} END AS now_note FROM (
     SELECT split_part(id, '/', 1)::BIGINT AS k, split_part(id, '/', 2)::INT AS context_id, {columns} FROM {folded} GROUP BY 1, 2)){', v_known_hi' if hindi else ''}"""


def said(c, language="en"):
    return F.array_join(advisory.shown(F.col(c), language), " | ").alias(c)


def told_rows(spark, sf):
    """Every district and context with the entries of its fired scenarios; plans meet the records before the contexts multiply them."""
    catalog = hindi_catalog(spark, sf)
    planned = v.records(spark, sf).join(advisory.district_plans(plan_rows(spark, sf), catalog), ["state", "district"], "left")
    ctx = advisory.prepare_contexts(planned, CONTEXTS)
    rows = advisory.with_entries(ctx, CONTEXTS, v.action_library(spark, sf), v.community_library(spark, sf), catalog=catalog)
    return rows.withColumn("entries", F.flatten("entries")).select(*advisory.RECORD_KEY, "entries")


@query("ad7_action_lists", f"SELECT state, district, l.* EXCLUDE (k) FROM ({lists_sql('v_actions')}) l JOIN v_record USING (k)")
def ad7(spark, sf):
    lists = advisory.assemble(told_rows(spark, sf).where(F.size("entries") > 0))
    return lists.select(*advisory.RECORD_KEY, *(said(c) for c in advisory.CATEGORIES))


@query("ad7_action_records", f"""SELECT state, district, context_id, trim(left(trim(regexp_replace(lower(t), '[^a-z0-9]+', '_', 'g'), '_'), 120)) AS action_id, t AS text_en, {hindi_sql('t')} AS text_hi, 'action_pipeline' AS source
   FROM (SELECT state, district, context_id, unnest(string_split(do_now, ' | ')) AS t FROM ({lists_sql('v_actions')}) JOIN v_record USING (k) WHERE do_now <> ''), v_known_hi""")
def ad7_records(spark, sf):
    lists = advisory.assemble(told_rows(spark, sf))
    return lists.select(*advisory.RECORD_KEY, F.inline("do_now"))


VIEW_SQL["v_all_actions"] = """SELECT k, context_id, category, rank, block, pos, text FROM v_actions
  UNION ALL SELECT k, context_id, category, 0, 0, i, text FROM v_baseline"""


@query("ad8_advisories", f"""SELECT r.state, r.district, r.context_id, coalesce(s.overall_risk, 'Low') AS overall_risk, coalesce(s.confidence, 'Low') AS confidence,
   summary AS forecast_summary, narrative AS outlook_narrative, coalesce(s.main_concerns, '') AS main_concerns, l.do_now, l.prepare, l.avoid, l.general_guidance
   FROM v_rc r JOIN v_summary_en USING (k) JOIN v_narrative_en USING (k)
   LEFT JOIN (SELECT k, context_id, max(CASE WHEN scenario_rank = 0 THEN risk_level END) AS overall_risk, max(CASE WHEN scenario_rank = 0 THEN confidence END) AS confidence,
     string_agg(display_name, '; ' ORDER BY scenario_rank) AS main_concerns FROM v_scen_ctx GROUP BY ALL) s ON s.k = r.k AND s.context_id = r.context_id
   LEFT JOIN ({lists_sql('v_all_actions')}) l ON l.k = r.k AND l.context_id = r.context_id""")
def ad8(spark, sf):
    return full_advisories(spark, sf).select(
        "state", "district", "context_id", "overall_risk", "confidence", "forecast_summary", "outlook_narrative",
        F.array_join("main_concerns", "; ").alias("main_concerns"), *(said(c) for c in advisory.CATEGORIES),
    )


_SCENARIO_HI = "CASE scenario " + " ".join(f"WHEN '{k}' THEN '{n}'" for k, n in labels.SCENARIOS_HI.items()) + " END"


@query("ad8_advisories_hi", f"""SELECT r.state, r.district, r.context_id, summary AS forecast_summary, narrative AS outlook_narrative, coalesce(s.main_concerns, '') AS main_concerns,
   '{advisory.FORECAST_SOURCE}; {advisory.AGRICULTURE_SOURCE}; {advisory.HEALTH_SOURCE}' AS sources, l.do_now, l.prepare, l.avoid, l.general_guidance
   FROM v_rc r JOIN v_summary_hi USING (k) JOIN v_narrative_hi USING (k)
   LEFT JOIN (SELECT k, context_id, string_agg({_SCENARIO_HI}, '; ' ORDER BY scenario_rank) AS main_concerns FROM v_scen_ctx GROUP BY ALL) s ON s.k = r.k AND s.context_id = r.context_id
   LEFT JOIN ({lists_sql('v_all_actions', hindi=True)}) l ON l.k = r.k AND l.context_id = r.context_id""")
def ad8_hi(spark, sf):
    adv = advisory.advisories(
        v.records(spark, sf), CONTEXTS, v.action_library(spark, sf), v.community_library(spark, sf), plan_rows(spark, sf), "hi", hindi_catalog(spark, sf)
    )
    notes = F.concat_ws("; ", *(F.col(f"source_notes.{c}") for c in ("forecast_source", "agriculture_source", "health_source")))
    return adv.select(
        *advisory.RECORD_KEY, "forecast_summary", "outlook_narrative", F.array_join("main_concerns", "; ").alias("main_concerns"), notes.alias("sources"),
        *(said(c, "hi") for c in advisory.CATEGORIES),
    )


@query("pf25_guardrail_phrases", "SELECT k, 'summary' AS field FROM v_record WHERE false")
def pf25(spark, sf):
    adv = full_advisories(spark, sf)
    body = F.concat_ws(" ", *(advisory.shown(F.col(c)) for c in advisory.CATEGORIES), "forecast_summary")
    hits = adv.where(advisory.guardrail_hits(body)).select("state", "district")
    return keyed(hits, spark, sf).select("k", F.lit("summary").alias("field"))


_PLANTED = "CASE WHEN pos % 3 = 0 THEN upper(([" + ", ".join(sql_text(p) for p in advisory.FORBIDDEN) + f"])[CAST(pos % {len(advisory.FORBIDDEN)} AS INT) + 1]) || ' ' || line ELSE line END"


@query("pf25_planted_phrases", f"SELECT doc_id, count_if({_any('t', advisory.FORBIDDEN)})::BIGINT AS n FROM (SELECT doc_id, {_PLANTED} AS t FROM v_lines) GROUP BY doc_id")
def pf25_planted(spark, sf):
    phrase = F.get(F.array(*(F.lit(p) for p in advisory.FORBIDDEN)), F.col("pos") % len(advisory.FORBIDDEN))
    lines = v.lines(spark, sf).withColumn("t", F.when(F.col("pos") % 3 == 0, F.concat(F.upper(phrase), F.lit(" "), "line")).otherwise(F.col("line")))
    return lines.groupBy("doc_id").agg(F.count_if(advisory.guardrail_hits(F.col("t"))).alias("n"))


@query("sl2_caps_with_overflow", """SELECT doc_id, least(n, 12) AS shown, greatest(n - 12, 0) AS over, CASE WHEN n > 12 THEN 'Additional contingency measures (' || (n - 12) ||
   ' items) are available — consult your local KVK extension officer.' END AS note FROM (SELECT doc_id, count(DISTINCT line) AS n FROM v_lines GROUP BY doc_id)""")
def sl2(spark, sf):
    out = advisory.capped(line_lists(spark, sf, F.lit("do_now")))
    note = F.get("general_guidance", F.lit(0))["text_en"]
    over = F.coalesce(F.regexp_extract(note, r"\((\d+) items\)", 1).cast("int"), F.lit(0))
    return out.select("doc_id", F.size("do_now").alias("shown"), over.alias("over"), note.alias("note"))


def line_lists(spark, sf, category):
    """Every document's distinct lines as one of its action lists."""
    lines = F.transform(F.array_distinct(F.split("text", "\n")), lambda t: F.struct(t.alias("text"), t.alias("text_hi")))
    none = F.filter(lines, lambda x: F.lit(False))
    return v.table(spark, sf, "documents").select(
        "doc_id", *(advisory.action_records(F.when(category == c, lines).otherwise(none)).alias(c) for c in advisory.CATEGORIES)
    )


_ACTION_NOTE = {c: "'" + text.ACTION_TEMPLATES[k].replace("%d", "' || n || '") + "'" for c, k in (("do_now", "additional_contingency"), ("prepare", "additional_preparatory"))}


@query("sl2_assembled_lists", f"""SELECT doc_id, CASE WHEN c = 'do_now' THEN least(total, 12) ELSE 0 END AS n_now, CASE WHEN c = 'prepare' THEN least(total, 8) ELSE 0 END AS n_prepare,
   CASE WHEN n > 0 THEN CASE c WHEN 'do_now' THEN {_ACTION_NOTE['do_now']} ELSE {_ACTION_NOTE['prepare']} END ELSE '' END AS guidance
   FROM (SELECT *, total - CASE c WHEN 'do_now' THEN 12 ELSE 8 END AS n FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'do_now' ELSE 'prepare' END AS c, count(DISTINCT line) AS total FROM v_lines GROUP BY doc_id))""")
def sl2_assembled(spark, sf):
    out = advisory.capped(line_lists(spark, sf, F.when(F.col("doc_id") % 2 == 0, "do_now").otherwise("prepare")))
    return out.select(
        "doc_id", F.size("do_now").alias("n_now"), F.size("prepare").alias("n_prepare"), F.array_join(advisory.shown(F.col("general_guidance")), " ").alias("guidance")
    )


@query("sl3_first_six", "SELECT doc_id, array_to_string(parts[1:6], '|') AS shown, greatest(len(parts) - 6, 0) AS held FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)")
def sl3(spark, sf):
    first, held = advisory.first_and_overflow(F.split("text", "\n"))
    return v.table(spark, sf, "documents").select("doc_id", F.array_join(first, "|").alias("shown"), held.alias("held"))


@query("wn15_first_per_group", """SELECT state, district, rank FROM (SELECT state, district, row_number() OVER (PARTITION BY state ORDER BY k) AS rank FROM v_record) WHERE rank <= 3""")
def wn15(spark, sf):
    recs = v.records(spark, sf).select("k", "state", "district")
    return ordered.first_n(recs, ["state"], [F.col("k")], 3).select("state", "district", "rank")


@query("wn12_keep_first", "SELECT low, doc_id, pos FROM (SELECT lower(line) AS low, doc_id, pos, row_number() OVER (PARTITION BY lower(line), source ORDER BY doc_id, pos) AS rn FROM v_lines) WHERE rn = 1")
def wn12(spark, sf):
    first = ordered.keep_first(v.lines(spark, sf), [F.lower("line"), F.col("source")], F.struct("doc_id", "pos"))
    return first.select(F.lower("line").alias("low"), "doc_id", "pos")
