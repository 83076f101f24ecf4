"""Scenario, severity and advisory cases on hand-made records."""

import pytest
from pyspark.sql import functions as F

from skyfold.operators import advisory, rules
from skyfold.plans import views as v

NEUTRAL = {
    "state": "S", "district": "D", "forecast_date": "2026-06-24",
    "rainfall_since_june_1_pct_departure": 0, "rainfall_last_7_days_pct_departure": 0, "rainfall_last_14_days_pct_departure": 0,
    "monsoon_onset_status": "normal", "week1_rainfall_signal": "near_normal", "week2_rainfall_signal": "near_normal",
    "week3_4_rainfall_signal": "near_normal", "tmax_signal": "near_normal", "tmin_signal": "near_normal",
    "heat_wave_warning": False, "heavy_rain_warning": False, "humidity_heat_index_signal": "normal",
    **{f"week{i}_rainfall_anomaly_mm_day": 0.0 for i in range(1, 5)}, **{f"week{i}_tmax_anomaly_degC": 0.0 for i in range(1, 5)},
}
SCHEMA = ", ".join(
    f"{k} {'boolean' if isinstance(x, bool) else 'int' if isinstance(x, int) else 'double' if isinstance(x, float) else 'string'}"
    for k, x in NEUTRAL.items()
)


def record(spark, stage=None, **changes):
    row = {**NEUTRAL, **changes}
    df = spark.createDataFrame([tuple(row[k] for k in NEUTRAL)], SCHEMA)
    return df.withColumn("crop_stage", F.lit(stage).cast("string"))


def fired(spark, stage=None, **changes):
    return {r["scenario"]: r["risk_level"] for r in rules.classify(record(spark, stage, **changes)).collect()}


DRY = {f"week{i}_rainfall_anomaly_mm_day": -4.0 for i in range(1, 5)}


@pytest.mark.parametrize(
    "stage, changes, want",
    [
        (None, {}, {}),
        (None, {"heat_wave_warning": True, "humidity_heat_index_signal": "high"}, {"heat_stress": "Severe"}),
        (None, {"tmax_signal": "above_normal", "tmin_signal": "above_normal"}, {"heat_stress": "Alert"}),
        (None, {"tmin_signal": "above_normal"}, {"heat_stress": "Watch"}),
        (
            None,
            {**DRY, "monsoon_onset_status": "delayed", "rainfall_since_june_1_pct_departure": -45, "week1_rainfall_signal": "below_normal"},
            {"delayed_monsoon": "Severe"},
        ),
        ("not_sown", {**DRY, "rainfall_last_14_days_pct_departure": -60, "week1_rainfall_signal": "below_normal"}, {}),
        ("vegetative", {"rainfall_last_14_days_pct_departure": -45, "week1_rainfall_signal": "below_normal"}, {"early_season_dry_spell": "Alert"}),
        (
            "flowering_reproductive",
            {**DRY, "monsoon_onset_status": "active", "rainfall_last_14_days_pct_departure": -55, "week1_rainfall_signal": "below_normal"},
            {"mid_season_break": "Alert", "terminal_drought": "Severe"},
        ),
        (None, {"week1_rainfall_anomaly_mm_day": 6.9}, {}),
        (None, {"week3_rainfall_anomaly_mm_day": 8.0}, {"excess_rainfall_waterlogging": "Watch"}),
        (None, {"heavy_rain_warning": True, "week1_rainfall_anomaly_mm_day": 7.0}, {"excess_rainfall_waterlogging": "Severe"}),
        (None, {"heavy_rain_warning": True, "rainfall_since_june_1_pct_departure": -30}, {}),
        (None, {"week1_rainfall_anomaly_mm_day": None, "week2_rainfall_anomaly_mm_day": None}, {}),
    ],
)
def test_scenarios(spark, stage, changes, want):
    assert fired(spark, stage, **changes) == want


def test_order_and_overall_risk(spark):
    df = record(spark, heavy_rain_warning=True, week1_rainfall_anomaly_mm_day=8.0, tmin_signal="above_normal")
    rows = rules.classify(df).orderBy("scenario_rank").collect()
    assert [r["scenario"] for r in rows] == ["excess_rainfall_waterlogging", "heat_stress"]
    assert rules.with_inputs(df).select(rules.overall_risk(rules.scenarios())).first()[0] == "Severe"
    assert rules.with_inputs(record(spark)).select(rules.overall_risk(rules.scenarios())).first()[0] == "Low"


def test_number_text_rounds_half_to_even(spark):
    df = rules.with_inputs(record(spark, week1_rainfall_anomaly_mm_day=2.5, week2_rainfall_anomaly_mm_day=-0.4, week3_rainfall_anomaly_mm_day=4.5))
    text = df.select(rules.inputs().outlook).first()[0]
    assert text.endswith("Wk1=+2 (near normal), Wk2=-0 (near normal), Wk3=+4 (above), Wk4=+0 (near normal)")


CONTEXTS = [{"user_type": "farmer", "crop": "rice", "irrigation_status": "rainfed", "crop_stage": s} for s in ("not_sown", "vegetative", "flowering", "harvesting")]
CONTEXTS += [{"user_type": u, "irrigation_status": "unknown"} for u in ("livestock_owner", "outdoor_worker", "village_official", "health_worker")]


def test_every_context_is_well_formed(spark, sf):
    adv = advisory.advisories(v.records(spark, sf), CONTEXTS, v.action_library(spark, sf), v.community_library(spark, sf))
    rows = adv.collect()
    assert len(rows) == v.records(spark, sf).count() * len(CONTEXTS)
    for r in rows:
        assert r["overall_risk"] in ("Low", "Watch", "Alert", "Severe")
        assert len(r["outlook_weeks"]) == 4 and r["disclaimer"]
        lists = [r[c] for c in advisory.CATEGORIES]
        assert all(isinstance(x, list) for x in lists) and len(r["do_now"]) <= 12 and len(r["prepare"]) <= 8
        assert all(a["action_id"] and a["text_en"] and a["text_hi"] and a["source"] for x in lists for a in x)
        text = " ".join([*(a["text_en"] for x in lists for a in x), r["forecast_summary"]]).lower()
        assert not any(p in text for p in advisory.FORBIDDEN)


def test_caps_leave_one_note(spark):
    from pyspark.sql import functions as F

    def records(c):
        return advisory.action_records(F.transform(c, lambda t: F.struct(t.alias("text"), t.alias("text_hi"))))

    rows = [([f"n{i}" for i in range(n)], [f"p{i}" for i in range(11)], [], []) for n in (15, 3)]
    lists = spark.createDataFrame(rows, ", ".join(f"{c} array<string>" for c in ("do_now", "prepare", "avoid", "general_guidance")))
    out = advisory.capped(lists.select(*(records(c).alias(c) for c in lists.columns))).orderBy(F.size("do_now").desc()).collect()
    assert [(len(r["do_now"]), len(r["prepare"])) for r in out] == [(12, 8), (3, 8)]
    (now,), (prepare,) = (r["general_guidance"] for r in out)
    assert now["text_en"] == "Additional contingency measures (3 items) are available — consult your local KVK extension officer."
    assert prepare["text_en"] == "Additional preparatory measures (3 items) are available — consult your local KVK extension officer."
    assert (now["action_id"], prepare["action_id"], now["source"]) == ("additional_contingency", "additional_preparatory", "generated") and "(3 वस्तुएँ)" in now["text_hi"]


def test_flat_plans_reach_farmers_of_any_crop(spark, sf):
    """The older flat list of a plan comes first, whatever the crop, and not to others."""
    names = list(rules.RULES)
    plan = [("S", "D", s, kind, k, f"{kind} step {k} of {s}", crop) for s in names for k, (kind, crop) in enumerate([("crop", "Maize"), ("flat", None), ("crop", "Rice"), ("livestock", None)])]
    plans = spark.createDataFrame(plan, "state string, district string, scenario string, kind string, pos int, action string, crop string")
    contexts = [{"user_type": "farmer", "crop": "rice"}, {"user_type": "livestock_owner"}, {"user_type": "health_worker"}]
    none = v.action_library(spark, sf).limit(0)
    hot = record(spark, heat_wave_warning=True)
    rows = advisory.scenario_actions(advisory.prepare_contexts(hot, contexts), contexts, none, none, plans).collect()
    heat = [(r["context_id"], r["category"], r["text"]) for r in rows if "heat_stress" in r["text"]]
    assert heat == [
        (0, "do_now", "flat step 1 of heat_stress"), (0, "prepare", "crop step 0 of heat_stress"), (0, "do_now", "crop step 2 of heat_stress"),
        (1, "do_now", "livestock step 3 of heat_stress"),
    ]
