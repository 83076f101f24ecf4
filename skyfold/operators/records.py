"""District records: keyed upsert of model output with field-level precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.functions.dates import compact_to_iso
from skyfold.functions.signals import rain_signal, signed, tmax_signal
from skyfold.functions.text import alnum_key, merge_key, note_base, set_note, translate_label

# Labels and defaults of a record.
MODEL_LABELS = {
    "MME": "Multi-model mean",
    "GEFS": "GEFS (NOAA 35-day)",
    "CFSv2": "CFSv2 (NOAA)",
    "EC46": "EC46 (ECMWF 46-day)",
}
BASELINE_KEY, BASELINE_LABEL, BASELINE_SOURCE = "IMD", "Official IMD guidance", "IMD forecast products"
DEFAULTS = {
    "forecast_date": "",
    "rainfall_since_june_1_pct_departure": 0,
    "rainfall_last_7_days_pct_departure": 0,
    "rainfall_last_14_days_pct_departure": 0,
    "monsoon_onset_status": "normal",
    "week1_rainfall_signal": "near_normal",
    "week2_rainfall_signal": "near_normal",
    "week3_4_rainfall_signal": "near_normal",
    "seasonal_monsoon_context": "normal",
    "tmax_signal": "near_normal",
    "tmin_signal": "near_normal",
    "heat_wave_warning": False,
    "heavy_rain_warning": False,
    "humidity_heat_index_signal": "normal",
    "imd_source_notes": "",
}
OBSERVED_FIELDS = (
    "rainfall_since_june_1_pct_departure",
    "rainfall_last_7_days_pct_departure",
    "rainfall_last_14_days_pct_departure",
    "monsoon_onset_status",
)
WEEKS = (1, 2, 3, 4)
_WEEK_TYPE = "array<struct<week:int,rainfall_mm_day:double,tmax_degC:double>>"
VARIANT_TYPE = f"array<struct<key:string,label:string,source:string,weeks:{_WEEK_TYPE}>>"


def with_keys(df: DataFrame) -> DataFrame:
    return df.withColumn("_ks", merge_key(F.col("state"))).withColumn("_kd", merge_key(F.col("district")))


def weeks_to_wide(df: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    """Long weeks to ``week1..4`` fields; ``values`` maps a column to a name pattern with ``{w}``."""
    aggs = [
        F.max(F.when(F.col("week") == w, F.col(c))).alias(pattern.format(w=w))
        for c, pattern in values.items()
        for w in WEEKS
    ]
    return df.groupBy(*keys).agg(*aggs)


def weeks_to_long(df: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    """Wide week fields back to one row per week."""
    rows = F.array(
        *[
            F.struct(F.lit(w).alias("week"), *[F.col(p.format(w=w)).alias(c) for c, p in values.items()])
            for w in WEEKS
        ]
    )
    return df.select(*keys, F.inline(rows))


def weekly_by_district(s2s: DataFrame) -> DataFrame:
    """Weekly model output folded to one row per district.

    A district holds models x weeks entries, so the collected list is short.
    """
    mme = F.col("model") == "MME"
    wide = [
        F.max(F.when(mme & (F.col("week") == w), F.col(c))).alias(f"_{c}{w}")
        for c in ("precip", "t2m")
        for w in WEEKS
    ]
    keyed = with_keys(s2s)
    return keyed.groupBy("_ks", "_kd").agg(
        *wide,
        F.min("init_date").alias("_init"),
        F.min("state").alias("_state"),
        F.min("district").alias("_district"),
        F.sort_array(
            F.collect_list(
                F.struct("model", F.col("week").cast("int").alias("week"), "precip", "t2m")
            )
        ).alias("_models"),
    )


def _weeks_of(models: str, key: Column) -> Column:
    mine = F.filter(F.col(models), lambda m: m["model"] == key)
    return F.transform(
        mine,
        lambda m: F.struct(
            m["week"].alias("week"), m["precip"].alias("rainfall_mm_day"), m["t2m"].alias("tmax_degC")
        ),
    ).cast(_WEEK_TYPE)


def seed_missing(records: DataFrame, s2s: DataFrame) -> DataFrame:
    """Records plus default records for districts only the models know."""
    known = with_keys(records).select("_ks", "_kd")
    new = (
        with_keys(s2s)
        .groupBy("_ks", "_kd")
        .agg(F.min("state").alias("state"), F.min("district").alias("district"))
        .join(known, ["_ks", "_kd"], "left_anti")
        .select("state", "district", *[F.lit(v).alias(k) for k, v in DEFAULTS.items()])
    )
    return records.unionByName(new, allowMissingColumns=True)


def merge_weekly(records: DataFrame, s2s: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Overwrite forecast fields from the multi-model mean where a district has model output.

    ``context`` carries the seasonal lean per district. Observed fields stay. The
    baseline variant is captured from the record once and kept on later runs.
    """
    base = records
    if "forecast_variants" not in base.columns:
        base = base.withColumn("forecast_variants", F.lit(None).cast(VARIANT_TYPE))
    if "forecast_source" not in base.columns:
        base = base.withColumn("forecast_source", F.lit(None).cast("string"))
    joined = with_keys(base).join(weekly_by_district(s2s), ["_ks", "_kd"], "left")
    if context is None:
        joined = joined.withColumn("_context", F.lit(None).cast("string")).withColumn("_net", F.lit(None).cast("double"))
    else:
        c = with_keys(context).select("_ks", "_kd", F.col("context").alias("_context"), F.col("net").alias("_net"))
        joined = joined.join(c, ["_ks", "_kd"], "left")
    hit = F.col("_models").isNotNull()

    note = note_base(F.col("imd_source_notes"))
    captured = F.struct(
        F.lit(BASELINE_KEY).alias("key"),
        F.lit(BASELINE_LABEL).alias("label"),
        F.when(note == "", BASELINE_SOURCE).otherwise(note).alias("source"),
        F.array(
            *[
                F.struct(
                    F.lit(w).alias("week"),
                    F.col(f"week{w}_rainfall_anomaly_mm_day").alias("rainfall_mm_day"),
                    F.col(f"week{w}_tmax_anomaly_degC").alias("tmax_degC"),
                )
                for w in WEEKS
            ]
        ).cast(_WEEK_TYPE).alias("weeks"),
    )
    prior = F.get(F.filter("forecast_variants", lambda v: v["key"] == BASELINE_KEY), F.lit(0))
    member_models = F.array_sort(
        F.array_distinct(F.filter(F.transform("_models", lambda m: m["model"]), lambda m: m != "MME"))
    )
    joined = joined.withColumn("_baseline", F.coalesce(prior, captured)).withColumn("_names", member_models)

    iso = F.coalesce(compact_to_iso(F.col("_init")), F.col("forecast_date"))
    used = F.when(F.size("_names") > 0, F.array_join("_names", ",")).otherwise("models")
    season = F.coalesce(
        F.concat(F.lit("; seasonal SEAS5+SFS -> "), F.col("_context"), F.lit(" (net "), signed(F.col("_net"), 2), F.lit(")")),
        F.lit(""),
    )
    source = F.concat(F.lit("S2S multi-model mean ("), used, F.lit(") init "), iso, season)
    mme_label = F.when(
        F.size("_names") > 0, F.concat(F.lit("Multi-model mean ("), F.array_join("_names", ","), F.lit(")"))
    ).otherwise("Multi-model mean")
    own = F.transform(
        "_names",
        lambda m: F.struct(
            m.alias("key"),
            translate_label(m, MODEL_LABELS).alias("label"),
            F.lit(None).cast("string").alias("source"),
            _weeks_of("_models", m).alias("weeks"),
        ),
    )
    variants = F.concat(
        F.array("_baseline"),
        F.array(
            F.struct(
                F.lit("MME").alias("key"),
                mme_label.alias("label"),
                source.alias("source"),
                _weeks_of("_models", F.lit("MME")).alias("weeks"),
            )
        ),
        own,
    )
    p = {w: F.col(f"_precip{w}") for w in WEEKS}
    late = (F.coalesce(p[3], F.lit(0.0)) + F.coalesce(p[4], F.lit(0.0))) / F.nullif(
        p[3].isNotNull().cast("int") + p[4].isNotNull().cast("int"), F.lit(0)
    )
    updates: dict[str, Column] = {}
    for w in WEEKS:
        updates[f"week{w}_rainfall_anomaly_mm_day"] = p[w]
        updates[f"week{w}_tmax_anomaly_degC"] = F.col(f"_t2m{w}")
    updates["week1_rainfall_signal"] = rain_signal(p[1])
    updates["week2_rainfall_signal"] = rain_signal(p[2])
    updates["week3_4_rainfall_signal"] = rain_signal(late)
    updates["tmax_signal"] = tmax_signal(F.col("_t2m1"))
    updates["seasonal_monsoon_context"] = F.coalesce("_context", "seasonal_monsoon_context")
    updates["forecast_date"] = iso
    updates["forecast_source"] = source
    updates["imd_source_notes"] = set_note(F.col("imd_source_notes"), source)
    updates["forecast_variants"] = variants
    return joined.select(
        *[
            F.when(hit, updates[c]).otherwise(F.col(c)).alias(c) if c in updates else F.col(c)
            for c in base.columns
        ],
        hit.alias("updated"),
    )


def nest_odds(odds: DataFrame) -> DataFrame:
    """Weekly odds folded to one struct per district, weeks in order."""
    week = F.struct(
        F.col("week").cast("int").alias("week"), "p_wetter", "p_near", "p_drier", "p_heavy", "p_dryspell", "p_hot"
    )
    out = with_keys(odds).groupBy("_ks", "_kd").agg(
        F.max_by("n_members", F.when(F.col("n_members").isNotNull(), F.col("week"))).alias("n_members"),
        F.min("models").alias("models"),
        F.min("init_date").alias("init"),
        F.sort_array(F.collect_list(week)).alias("weeks"),
    )
    source = F.when(F.coalesce("models", F.lit("")) == "", "ensemble").otherwise(
        F.concat(F.col("models"), F.lit(" ensemble"))
    )
    return out.select(
        "_ks", "_kd", F.struct("n_members", "models", "init", source.alias("source"), "weeks").alias("weekly_probabilities")
    )


def attach_odds(records: DataFrame, odds: DataFrame) -> DataFrame:
    return with_keys(records).join(nest_odds(odds), ["_ks", "_kd"], "left").drop("_ks", "_kd")


def attach_observed(records: DataFrame, observed: DataFrame) -> DataFrame:
    """Overwrite the four observed fields where a district has observations."""
    o = with_keys(observed).select(
        "_ks", "_kd", *[F.col(f).alias(f"_o_{f}") for f in OBSERVED_FIELDS], "obs_asof"
    )
    joined = with_keys(records).join(o, ["_ks", "_kd"], "left")
    source = F.concat(F.lit("IMD 0.25deg gridded rainfall vs 1991-2020 normal, asof "), F.col("obs_asof"))
    keep = [
        F.coalesce(F.col(f"_o_{c}"), F.col(c)).alias(c) if c in OBSERVED_FIELDS else F.col(c) for c in records.columns
    ]
    return joined.select(*keep, source.alias("observed_source"))


def lookup_or_default(requests: DataFrame, records: DataFrame, fields: list[str]) -> DataFrame:
    """Record per requested district ignoring case; defaults where there is none."""
    r = records.select(F.lower("state").alias("_ks"), F.lower("district").alias("_kd"), *fields)
    q = requests.withColumn("_ks", F.lower("state")).withColumn("_kd", F.lower("district"))
    joined = q.join(r.withColumn("_hit", F.lit(True)), ["_ks", "_kd"], "left")
    found = F.coalesce("_hit", F.lit(False))
    return joined.select(
        *requests.columns,
        *[F.when(found, F.col(f)).otherwise(F.lit(DEFAULTS.get(f))).alias(f) for f in fields],
        found.alias("found"),
    )


def map_values(shapes: DataFrame, records: DataFrame, value: Column, label: Column) -> DataFrame:
    """Polygon names with a record value and its label, matched on letters and digits."""
    r = records.select(
        alnum_key(F.col("state")).alias("_ms"), alnum_key(F.col("district")).alias("_md"),
        value.alias("value"), label.alias("_label"),
    )
    s = shapes.withColumn("_ms", alnum_key(F.col("state"))).withColumn("_md", alnum_key(F.col("district")))
    return s.join(r, ["_ms", "_md"], "left").select(
        *shapes.columns, "value", F.coalesce("_label", F.lit("n/a")).alias("label")
    )


def variant_week_value(source: Column, field: str, week: int, top_field: str) -> Column:
    """Weekly value of a chosen source; the record's own field when the source or week is absent.

    A present week with a null value stays null.
    """
    variant = F.get(F.filter("forecast_variants", lambda v: v["key"] == source), F.lit(0))
    entry = F.get(F.filter(variant["weeks"], lambda w: w["week"] == week), F.lit(0))
    return F.when(entry.isNotNull(), entry[field]).otherwise(F.col(top_field))


def numeric_sources(records: DataFrame, keys: list[str]) -> DataFrame:
    """Source variants that carry at least one weekly number."""
    has = F.exists("_v.weeks", lambda w: w["rainfall_mm_day"].isNotNull() | w["tmax_degC"].isNotNull())
    return (
        records.select(*keys, F.posexplode("forecast_variants").alias("pos", "_v"))
        .where(has)
        .select(*keys, "pos", F.col("_v.key").alias("key"), F.col("_v.label").alias("label"))
    )


def update_numeric(records: DataFrame, updates: DataFrame, column: str) -> DataFrame:
    """Replace a column by key where the update parses as a number."""
    u = updates.select("state", "district", F.expr("try_cast(value as double)").alias("_u"))
    return records.join(u, ["state", "district"], "left").select(
        *[F.coalesce("_u", F.col(c)).alias(c) if c == column else F.col(c) for c in records.columns]
    )


def roster_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys present on one side only."""
    l = left.select("state", "district").distinct().withColumn("_l", F.lit(1))
    r = right.select("state", "district").distinct().withColumn("_r", F.lit(1))
    return l.join(r, ["state", "district"], "full_outer").where(F.col("_l").isNull() | F.col("_r").isNull()).select(
        "state", "district", F.when(F.col("_r").isNull(), "left_only").otherwise("right_only").alias("side")
    )


def source_table(records: DataFrame, keys: list[str]) -> DataFrame:
    """Weeks of every forecast source of a record: ``label, source, week, rainfall_mm_day, tmax_degC``.

    Sources without any number are left out; a record without a source that has one
    shows its own fields.
    """
    def told(x: Column) -> Column:
        return F.exists(x["weeks"], lambda w: w["rainfall_mm_day"].isNotNull() | w["tmax_degC"].isNotNull())

    own = F.struct(
        F.lit("").alias("key"), F.lit("").alias("label"), F.lit("").alias("source"),
        F.array(
            *(
                F.struct(F.lit(w).alias("week"), F.col(f"week{w}_rainfall_anomaly_mm_day").alias("rainfall_mm_day"), F.col(f"week{w}_tmax_anomaly_degC").alias("tmax_degC"))
                for w in WEEKS
            )
        ).cast(_WEEK_TYPE).alias("weeks"),
    )
    listed = F.filter(F.coalesce("forecast_variants", F.array().cast(VARIANT_TYPE)), told)
    shown = F.when(F.size(listed) > 0, listed).otherwise(F.array(own))
    rows = records.select(*keys, F.explode(shown).alias("v"))
    return rows.select(*keys, "v.label", "v.source", F.inline("v.weeks"))


def category_split(records: DataFrame, keys: list[str]) -> DataFrame:
    """Whole percentages of wetter, near and drier in each week that has odds; missing odds are 0."""
    rows = records.select(*keys, F.explode("weekly_probabilities.weeks").alias("w"))

    def percent(c: str) -> Column:
        return F.bround(F.coalesce(F.col(f"w.{c}"), F.lit(0.0)) * 100).cast("int").alias(c[2:])

    return rows.select(*keys, F.col("w.week").alias("week"), percent("p_wetter"), percent("p_near"), percent("p_drier"))
