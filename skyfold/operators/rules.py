"""Scenario rules: one projection classifies every record in every context.

A rule is a bundle of column expressions. Adding a scenario means adding a
function to the registry; no user-defined function and no shuffle is involved.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.functions.signals import signed, unsigned

# Severity order and the sentences of the reasons.
SEVERITY = {"Severe": 4, "Alert": 3, "Watch": 2, "Low": 1}
OBSERVED_SOURCES = ("IMD observed rainfall", "IMD forecast", "ICAR district contingency plan")
DELAY_SOURCES = ("IMD rainfall status", "IMD extended range forecast", "ICAR district contingency plan")
HEAT_SOURCES = ("IMD forecast products",)
RAIN_SOURCES = ("IMD heavy rainfall warnings", "IMD extended range forecast")
SAYS_RELIEF = "Some rainfall improvement expected in weeks 2-4"
SAYS_RELIEF_HOLD = "Rainfall improvement expected in weeks 2-4 — hold off on drastic measures"
SAYS_RELIEF_BREAK = "Break likely short-lived — rainfall improvement expected in weeks 2-4"
SAYS_RELIEF_PARTIAL = "Some rainfall expected in weeks 2-4 — may provide partial relief"
SAYS_DRY = "Dry conditions expected to persist across all 4 weeks"
SAYS_DRY_BREAK = "Extended break expected — dry conditions across all 4 weeks"
SAYS_DRY_TERMINAL = "No rainfall recovery expected in the 4-week outlook"
SAYS_WET = "Above-normal rainfall expected to persist across multiple weeks"

WEEK_FIELDS = tuple(f"week{i}_rainfall_anomaly_mm_day" for i in range(1, 5))


@dataclass(frozen=True)
class Inputs:
    """Names of the derived columns that :func:`with_inputs` adds, as columns."""

    since_june: Column
    last_14: Column
    onset: Column
    onset_raw: Column
    week1_signal: Column
    heat_wave: Column
    heavy_rain: Column
    tmax_above: Column
    tmin_above: Column
    humid: Column
    stage: Column
    stage_raw: Column
    later: Column
    below_count: Column
    above_count: Column
    peak: Column
    relief: Column
    drying: Column
    all_dry: Column
    all_wet: Column
    outlook: Column
    weeks: tuple[Column, ...]


_SCALARS = [f for f in Inputs.__dataclass_fields__ if f != "weeks"]
INPUT_COLUMNS = [f"_in_{f}" for f in _SCALARS] + [f"_in_week{i}" for i in range(1, 5)]


def inputs() -> Inputs:
    """Columns of a frame prepared by :func:`with_inputs`."""
    return Inputs(
        **{f: F.col(f"_in_{f}") for f in _SCALARS}, weeks=tuple(F.col(f"_in_week{i}") for i in range(1, 5))
    )


def with_inputs(df: DataFrame) -> DataFrame:
    """Add defaults for missing fields and the four-week trajectory.

    Derived once here, so that rules and sentences refer to plain columns
    instead of repeating the expressions.
    """
    return with_stage(with_weather(df))


def with_stage(df: DataFrame) -> DataFrame:
    """The part of :func:`with_inputs` that depends on the crop stage, and so on the user context."""
    stage = F.coalesce(F.col("crop_stage"), F.lit(""))
    return df.withColumns(
        {
            "_in_stage": F.when(stage == "flowering_reproductive", "flowering").otherwise(stage),
            "_in_stage_raw": F.coalesce("crop_stage", F.lit("unknown")),
        }
    )


def with_weather(df: DataFrame) -> DataFrame:
    """The part of :func:`with_inputs` that depends on the record alone."""
    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    def equals(name: str, value: str) -> Column:
        return F.coalesce(F.col(name) == value, F.lit(False))

    base = {
        "since_june": F.coalesce("rainfall_since_june_1_pct_departure", F.lit(0)),
        "last_14": F.coalesce("rainfall_last_14_days_pct_departure", F.lit(0)),
        "onset": F.coalesce("monsoon_onset_status", F.lit("normal")),
        "onset_raw": F.coalesce("monsoon_onset_status", F.lit("unknown")),
        "week1_signal": F.coalesce("week1_rainfall_signal", F.lit("near_normal")),
        "heat_wave": flag("heat_wave_warning"),
        "heavy_rain": flag("heavy_rain_warning"),
        "tmax_above": equals("tmax_signal", "above_normal"),
        "tmin_above": equals("tmin_signal", "above_normal"),
        "humid": equals("humidity_heat_index_signal", "high"),
    }
    base |= {f"week{i}": F.coalesce(F.col(f), F.lit(0.0)) for i, f in enumerate(WEEK_FIELDS, 1)}
    w = [F.col(f"_in_week{i}") for i in range(1, 5)]

    def count(hit: Callable[[Column], Column]) -> Column:
        return hit(w[0]).cast("int") + hit(w[1]).cast("int") + hit(w[2]).cast("int") + hit(w[3]).cast("int")

    shape = {
        "later": (w[1] + w[2] + w[3]) / 3.0,
        "below_count": count(lambda x: x <= -3.0),
        "above_count": count(lambda x: x >= 3.0),
        "peak": F.greatest(*w),
        "outlook": weekly_outlook(tuple(w)),
    }
    later = F.col("_in_later")
    course = {
        "relief": (w[0] <= -3.0) & (later > -1.0),
        "drying": (w[0] >= -1.0) & (later <= -3.0),
        "all_dry": F.col("_in_below_count") >= 3,
        "all_wet": F.col("_in_above_count") >= 3,
    }
    for group in (base, shape, course):
        df = df.withColumns({f"_in_{k}": c for k, c in group.items()})
    return df


@dataclass(frozen=True)
class Rule:
    display: str
    fires: Column
    risk: Column
    confidence: Column
    reasons: tuple[Column, ...]
    sources: tuple[str, ...]


def _level(severe: Column, alert: Column) -> Column:
    return F.when(severe, "Severe").when(alert, "Alert").otherwise("Watch")


def _say(when: Column, text: str) -> Column:
    return F.when(when, F.lit(text))


def _rain_is(prefix: str, departure: Column) -> Column:
    side = F.when(departure < 0, "below").otherwise("above")
    return F.concat(F.lit(f"{prefix} is "), F.abs(departure).cast("string"), F.lit("% "), side, F.lit(" normal"))


def weekly_outlook(weeks: tuple[Column, ...]) -> Column:
    """Four-week outlook sentence."""
    parts = []
    for i, w in enumerate(weeks, 1):
        text = (
            F.when(w >= 3.0, F.concat(F.lit("+"), unsigned(w, 0), F.lit(" (above)")))
            .when(w <= -3.0, F.concat(unsigned(w, 0), F.lit(" (below)")))
            .otherwise(F.concat(signed(w, 0), F.lit(" (near normal)")))
        )
        parts.append(F.concat(F.lit(f"Wk{i}="), text))
    return F.concat(F.lit("4-week outlook (mm/day anomaly): "), F.concat_ws(", ", *parts))


def heat_stress(x: Inputs) -> Rule:
    return Rule(
        "Heat stress",
        x.heat_wave | x.tmax_above | x.tmin_above | x.humid,
        _level(x.heat_wave & x.humid, x.heat_wave | (x.tmax_above & x.tmin_above)),
        F.when(x.heat_wave | x.tmax_above, "High").otherwise("Medium"),
        (
            _say(x.heat_wave, "Heat wave warning in effect"),
            _say(x.tmax_above, "Above-normal maximum temperatures"),
            _say(x.tmin_above, "Above-normal minimum temperatures"),
            _say(x.humid, "High humidity and heat index"),
        ),
        HEAT_SOURCES,
    )


def delayed_monsoon(x: Inputs) -> Rule:
    return Rule(
        "Delayed monsoon / delayed sowing",
        x.onset.isin("not_started", "delayed") & (x.since_june <= -25) & (x.week1_signal == "below_normal"),
        _level(x.all_dry & (x.since_june <= -40), (x.below_count >= 2) | (x.since_june <= -35)),
        F.lit("High"),
        (
            _rain_is("Rainfall since June 1", x.since_june),
            F.when(x.onset == "delayed", "Monsoon onset status is delayed").when(
                x.onset == "not_started", "Monsoon has not started yet"
            ),
            x.outlook,
            F.when(x.relief, SAYS_RELIEF).when(x.all_dry, SAYS_DRY),
        ),
        DELAY_SOURCES,
    )


def early_season_dry_spell(x: Inputs) -> Rule:
    return Rule(
        "Early-season dry spell",
        x.stage.isin("recently_sown", "vegetative") & (x.last_14 <= -30) & (x.week1_signal == "below_normal"),
        _level((x.last_14 <= -50) & x.all_dry, x.last_14 <= -40),
        F.lit("High"),
        (
            _rain_is("Rainfall in last 14 days", x.last_14),
            F.concat(F.lit("Crop stage: "), x.stage_raw),
            x.outlook,
            F.when(x.relief, SAYS_RELIEF_HOLD).when(x.all_dry, SAYS_DRY),
        ),
        OBSERVED_SOURCES,
    )


def mid_season_break(x: Inputs) -> Rule:
    return Rule(
        "Mid-season monsoon break",
        x.stage.isin("vegetative", "flowering")
        & x.onset.isin("active", "weak")
        & (x.last_14 <= -40)
        & (x.week1_signal == "below_normal"),
        _level(x.all_dry & (x.last_14 <= -60), (x.below_count >= 2) | (x.last_14 <= -50)),
        F.lit("High"),
        (
            _rain_is("Rainfall in last 14 days", x.last_14),
            F.concat(F.lit("Crop stage: "), x.stage_raw),
            F.concat(F.lit("Monsoon status: "), x.onset_raw),
            x.outlook,
            F.when(x.relief, SAYS_RELIEF_BREAK).when(x.all_dry, SAYS_DRY_BREAK),
        ),
        OBSERVED_SOURCES,
    )


def terminal_drought(x: Inputs) -> Rule:
    return Rule(
        "Terminal drought / early withdrawal risk",
        x.stage.isin("flowering", "harvesting") & (x.last_14 <= -40) & (x.week1_signal == "below_normal"),
        _level(x.all_dry & (x.last_14 <= -50), (x.below_count >= 2) | (x.last_14 <= -50)),
        F.lit("High"),
        (
            _rain_is("Rainfall in last 14 days", x.last_14),
            F.concat(F.lit("Crop stage: "), x.stage_raw, F.lit(" (critical reproductive phase)")),
            x.outlook,
            F.when(x.all_dry, SAYS_DRY_TERMINAL).when(x.relief, SAYS_RELIEF_PARTIAL),
        ),
        OBSERVED_SOURCES,
    )


def excess_rainfall_waterlogging(x: Inputs) -> Rule:
    recovery = (x.since_june <= -20) & (x.peak < 7.0)
    return Rule(
        "Excess rainfall / waterlogging",
        (x.heavy_rain | (x.peak >= 7.0)) & ~recovery,
        _level(
            x.heavy_rain & (x.all_wet | (x.peak >= 7.0)), x.heavy_rain | (x.peak >= 10.0) | x.all_wet
        ),
        F.when(x.heavy_rain | (F.greatest(x.weeks[0], x.weeks[1]) >= 7.0), "High").otherwise("Medium"),
        (
            _say(x.heavy_rain, "Heavy rainfall warning in effect"),
            F.concat(F.lit("Peak rainfall anomaly: +"), unsigned(x.peak, 0), F.lit(" mm/day above normal")),
            x.outlook,
            _say(x.all_wet, SAYS_WET),
        ),
        RAIN_SOURCES,
    )


RULES: dict[str, Callable[[Inputs], Rule]] = {
    "heat_stress": heat_stress,
    "delayed_monsoon": delayed_monsoon,
    "early_season_dry_spell": early_season_dry_spell,
    "mid_season_break": mid_season_break,
    "terminal_drought": terminal_drought,
    "excess_rainfall_waterlogging": excess_rainfall_waterlogging,
}


def severity(level: Column) -> Column:
    expr = F.when(level == "Severe", SEVERITY["Severe"])
    for name in ("Alert", "Watch", "Low"):
        expr = expr.when(level == name, SEVERITY[name])
    return expr.otherwise(0)


def scenarios(rules: dict[str, Callable[[Inputs], Rule]] | None = None) -> Column:
    """Array of fired scenarios, most severe first, rule order on ties. Needs :func:`with_inputs`."""
    x = inputs()
    entries = []
    for pos, (name, build) in enumerate((rules or RULES).items()):
        rule = build(x)
        entries.append(
            F.when(
                rule.fires,
                F.struct(
                    (-severity(rule.risk)).alias("order"),
                    F.lit(pos).alias("rule_pos"),
                    F.lit(name).alias("scenario"),
                    F.lit(rule.display).alias("display_name"),
                    rule.risk.alias("risk_level"),
                    rule.confidence.alias("confidence"),
                    F.array_compact(F.array(*rule.reasons)).alias("reasons"),
                    F.array(*[F.lit(s) for s in rule.sources]).alias("source_layer"),
                ),
            )
        )
    return F.array_sort(F.array_compact(F.array(*entries)))


def classify(records: DataFrame, rules: dict[str, Callable[[Inputs], Rule]] | None = None) -> DataFrame:
    """One row per fired scenario with its rank inside the record and context."""
    ranked = with_inputs(records).withColumn("_s", scenarios(rules))
    return ranked.select(
        *records.columns, F.posexplode("_s").alias("scenario_rank", "_one")
    ).select(*records.columns, "scenario_rank", "_one.*").drop("order")


def overall_risk(fired: Column) -> Column:
    """Highest level of an ordered scenario array, Low when empty."""
    return F.coalesce(F.get(fired, F.lit(0))["risk_level"], F.lit("Low"))


def expand_contexts(records: DataFrame, contexts: list[dict]) -> DataFrame:
    """Every record in every user context; contexts are a short literal list."""
    fields = ("user_type", "crop", "irrigation_status", "crop_stage")
    rows = [
        F.struct(
            F.lit(i).alias("context_id"),
            *[F.lit(c.get(f)).cast("string").alias(f) for f in fields],
        )
        for i, c in enumerate(contexts)
    ]
    base = records.drop(*fields)
    return base.select(*base.columns, F.inline(F.array(*rows)))
