"""Anomalies, multi-model means, odds, terciles and skill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfold.functions.signals import pct_of_normal
from skyfold.operators.ordered import exact_quantiles, joint_quantiles

# Thresholds of the weekly odds and of the seasonal context.
WETTER, DRIER, HEAVY, DRY_SPELL, HOT = 1.0, -1.0, 7.0, -3.0, 1.5
SEASONAL_MARGIN = 0.10
CATEGORIES = {"t": ("below", "near", "above"), "p": ("below", "near", "above")}


def weekly_anomaly(forecast: DataFrame, clim: DataFrame, on: list[str], variables: list[str]) -> DataFrame:
    """Forecast minus climatology on shared keys. Broadcast or sort-merge is left to Spark's size check."""
    c = clim.select(*on, *[F.col(v).alias(f"_c_{v}") for v in variables])
    keep = [x for x in forecast.columns if x not in variables]
    return forecast.join(c, on).select(*keep, *[(F.col(v) - F.col(f"_c_{v}")).alias(v) for v in variables])


def anomaly_or_absolute(forecast: DataFrame, clim: DataFrame, on: list[str], variable: str, mode: str, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """One metric for all models of a run.

    ``anomaly`` and ``percent`` need a climatology for every model; if any model
    lacks one, all models fall back to absolute values in display units.
    """
    has = clim.select("model").distinct().withColumn("_has", F.lit(True))
    all_have = forecast.select("model").distinct().join(has, "model", "left").select(
        F.bool_and(F.coalesce("_has", F.lit(False)))
    ).scalar()
    c = clim.select(*on, F.col(variable).alias("_c"))
    v = F.col(variable)
    metric = (v - F.col("_c")) * scale if mode == "anomaly" else pct_of_normal(v, F.col("_c"))
    value = F.when(all_have, metric).otherwise(v * scale + offset)
    keep = [x for x in forecast.columns if x != variable]
    return forecast.join(c, on, "left").select(
        *keep, value.alias("value"), F.when(all_have, mode).otherwise("absolute").alias("metric")
    )


def multi_model_mean(regional: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """Mean over the models with a value; counts models finite in any variable."""
    finite = F.lit(False)
    for v in variables:
        finite = finite | F.col(v).isNotNull()
    return regional.groupBy(*keys).agg(
        *[F.avg(v).alias(v) for v in variables],
        F.count_distinct(F.when(finite, F.col("model"))).alias("n_models"),
    )


def with_multi_model(regional: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """Individual models and their mean, labelled MME, in one table."""
    mean = multi_model_mean(regional, keys, variables).withColumn("model", F.lit("MME"))
    return regional.select(*keys, "model", *variables, F.lit(1).cast("long").alias("n_models")).unionByName(
        mean.select(*keys, "model", *variables, "n_models")
    )


def threshold_odds(members: DataFrame, keys: list[str]) -> DataFrame:
    """Share of pooled members across each threshold. Input is regional member anomalies of all models."""
    p, t = F.col("precip"), F.col("t2m")

    def share(v: Column, hit: Column) -> Column:
        return F.bround(F.avg(F.when(v.isNotNull(), hit.cast("double"))), 3)

    out = members.groupBy(*keys).agg(
        share(p, p >= WETTER).alias("p_wetter"),
        share(p, p <= DRIER).alias("p_drier"),
        share(p, p >= HEAVY).alias("p_heavy"),
        share(p, p <= DRY_SPELL).alias("p_dryspell"),
        share(t, t >= HOT).alias("p_hot"),
        F.count(p).alias("n_members"),
        F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"),
    )
    return out.withColumn("p_near", F.bround(1.0 - F.col("p_wetter") - F.col("p_drier"), 3))


def tercile_limits(pool: DataFrame, keys: list[str], variable: str, bounded: bool = False) -> DataFrame:
    """Lower and upper tercile of the pooled hindcast.

    ``bounded`` pools (members x years of one region or cell) use the exact
    percentile aggregate; others go through the distributed selection.
    """
    if not bounded:
        return exact_quantiles(pool, keys, variable, {"q33": 1 / 3, "q67": 2 / 3})
    q = F.percentile(F.col(variable), F.array(F.lit(1 / 3), F.lit(2 / 3)))
    return pool.groupBy(*keys).agg(q.alias("_q")).select(
        *keys, F.col("_q")[0].alias("q33"), F.col("_q")[1].alias("q67")
    )


def tercile_odds(forecast: DataFrame, limits: DataFrame, keys: list[str], variable: str) -> DataFrame:
    """Share of members strictly below and above the terciles; near is the rest."""
    v = F.col(variable)
    odds = forecast.join(limits, keys).groupBy(*keys).agg(
        F.avg((v < F.col("q33")).cast("double")).alias("p_below"),
        F.avg((v > F.col("q67")).cast("double")).alias("p_above"),
    )
    return odds.withColumn("p_near", 1.0 - F.col("p_below") - F.col("p_above"))


def most_likely(below: Column, near: Column, above: Column) -> Column:
    """Index of the largest category (0 below, 1 near, 2 above); the lowest index wins ties."""
    options = F.array(
        F.struct(below.alias("p"), F.lit(0).alias("k")),
        F.struct(near.alias("p"), F.lit(-1).alias("k")),
        F.struct(above.alias("p"), F.lit(-2).alias("k")),
    )
    return -F.array_max(options)["k"]


def ensemble_anomaly(forecast: DataFrame, pool: DataFrame, keys: list[str], factors: dict[str, float]) -> DataFrame:
    """Ensemble mean minus pooled hindcast mean, scaled per variable."""
    f = forecast.groupBy(*keys).agg(*[F.avg(v).alias(f"_f_{v}") for v in factors])
    c = pool.groupBy(*keys).agg(*[F.avg(v).alias(f"_c_{v}") for v in factors])
    return f.join(c, keys).select(
        *keys, *[((F.col(f"_f_{v}") - F.col(f"_c_{v}")) * s).alias(v) for v, s in factors.items()]
    )


def anomaly_correlation(pairs: DataFrame, keys: list[str], hindcast: str, observed: str) -> DataFrame:
    """Pearson correlation over years of pairwise-valid values; one partial aggregation."""
    h, o = F.col(hindcast), F.col(observed)
    both = h.isNotNull() & o.isNotNull()
    return pairs.where(both).groupBy(*keys).agg(F.corr(h, o).alias("acc"), F.count("*").alias("n_years"))


def combine_on_label(a: DataFrame, b: DataFrame, on: list[str], variables: list[str]) -> DataFrame:
    """Equal-weight mean of two models on common labels; null when either is null."""
    right = b.select(*on, *[F.col(v).alias(f"_b_{v}") for v in variables])
    return a.join(right, on).select(*on, *[((F.col(v) + F.col(f"_b_{v}")) / 2.0).alias(v) for v in variables])


def season_collapse(df: DataFrame, keys: list[str], variables: list[str], n_months: int = 3, skip_init: bool = True) -> DataFrame:
    """Mean over the leads of the upcoming season."""
    first = 1 if skip_init else 0
    return df.where(F.col("lead").between(first, first + n_months - 1)).groupBy(*keys).agg(
        *[F.avg(v).alias(v) for v in variables]
    )


def robust_limits(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Colour limits over a whole map: 98th percentile of the size, 2nd and 98th of the value.

    A map is one group of every cell, so the distributed selection is used, once for all three.
    """
    def same(v: Column) -> Column:
        return v

    return joint_quantiles(df, keys, value, {"symmetric": (F.abs, 0.98), "low": (same, 0.02), "high": (same, 0.98)})


def seasonal_context(terciles: DataFrame, keys: list[str], leads: tuple[int, ...] = (0, 1, 2, 3)) -> DataFrame:
    """Season lean: mean odds above minus mean odds below over the leads and models."""
    picked = terciles.where(F.col("lead").isin(list(leads)) & F.col("p_above").isNotNull() & F.col("p_below").isNotNull())
    out = picked.groupBy(*keys).agg(
        F.round(F.avg("p_above") - F.avg("p_below"), 9).alias("_net"), F.count("*").alias("leads")
    )
    context = (
        F.when(F.col("_net") >= SEASONAL_MARGIN, "above_normal")
        .when(F.col("_net") <= -SEASONAL_MARGIN, "below_normal_risk")
        .otherwise("normal")
    )
    return out.select(*keys, context.alias("context"), F.bround("_net", 3).alias("net"), "leads")


def seasonal_totals(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Total per key; null where no day is valid (SQL sum semantics)."""
    return df.groupBy(*keys).agg(F.sum(value).alias(value))


def dataset_pairs(wide: DataFrame, names: list[str]) -> DataFrame:
    """Agreement of every pair of datasets over the cells valid in all of them.

    Datasets are columns of one row per cell, so all pairs come from a single
    aggregation pass with no self join.
    """
    valid = F.lit(True)
    for n in names:
        valid = valid & F.col(n).isNotNull()
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    aggs = [F.count("*").alias("n_cells")]
    aggs += [F.avg(n).alias(f"_m_{n}") for n in names]
    aggs += [F.corr(a, b).alias(f"_r_{a}_{b}") for a, b in pairs]
    one = wide.where(valid).groupBy().agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("a"),
                F.lit(b).alias("b"),
                F.col(f"_r_{a}_{b}").alias("r"),
                (F.col(f"_m_{a}") - F.col(f"_m_{b}")).alias("bias"),
                (F.try_divide(F.col(f"_m_{a}") - F.col(f"_m_{b}"), F.col(f"_m_{b}")) * 100.0).alias("bias_pct"),
                F.col(f"_m_{a}").alias("mean_a"),
                F.col(f"_m_{b}").alias("mean_b"),
            )
            for a, b in pairs
        ]
    )
    return one.select("n_cells", F.inline(rows))
