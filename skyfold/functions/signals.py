"""Numbers to classes, labels and colours. Every function is a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class limits and their labels.
RAIN_LIMIT = 3.0
TMAX_LIMIT = 1.5
OUTLOOK_LABELS_EN = ("well above normal", "above normal", "well below normal", "below normal", "near normal")
OUTLOOK_LABELS_HI = ("सामान्य से बहुत अधिक", "सामान्य से अधिक", "सामान्य से बहुत कम", "सामान्य से कम", "सामान्य के आसपास")
RAIN_CATEGORIES = (
    (7.0, "Much wetter than normal"),
    (3.0, "Wetter than normal"),
    (1.0, "Slightly wetter"),
)
RAIN_DRY_CATEGORIES = ((-1.0, "Near normal"), (-3.0, "Slightly drier"), (-7.0, "Drier than normal"))
RAIN_LOWEST = "Much drier than normal"
TEMP_CATEGORIES = ((4.0, "Very warm"), (2.0, "Warm"), (1.0, "Slightly warm"))
TEMP_COOL_CATEGORIES = ((-1.0, "Near normal"), (-2.0, "Slightly cool"), (-4.0, "Cool"))
TEMP_LOWEST = "Very cool"
LIKELIHOODS = (
    (10, "Very unlikely"),
    (30, "Unlikely"),
    (50, "Possible"),
    (70, "Likely"),
    (90, "Very likely"),
)
LIKELIHOOD_TOP = "Almost certain"
MISSING = "—"
RAMPS = {
    "rain": {"span": 8.0, "neg": (166, 97, 26), "pos": (33, 102, 172)},
    "temperature": {"span": 5.0, "neg": (33, 102, 172), "pos": (178, 24, 43)},
    "season": {"span": 60.0, "neg": (166, 97, 26), "pos": (33, 102, 172)},
}
NO_VALUE_COLOUR = "#e6e6e6"


def three_way(v: Column, limit: float) -> Column:
    """above / below / near normal at an inclusive limit; null is near normal."""
    return (
        F.when(v >= limit, "above_normal").when(v <= -limit, "below_normal").otherwise("near_normal")
    )


def rain_signal(v: Column) -> Column:
    return three_way(v, RAIN_LIMIT)


def tmax_signal(v: Column) -> Column:
    return three_way(v, TMAX_LIMIT)


def outlook_label(v: Column, labels: tuple[str, ...] = OUTLOOK_LABELS_EN) -> Column:
    """Five classes at 3 and 7."""
    return (
        F.when(v >= 7, labels[0])
        .when(v >= 3, labels[1])
        .when(v <= -7, labels[2])
        .when(v <= -3, labels[3])
        .otherwise(labels[4])
    )


def _graded(v: Column, at_least: tuple, above: tuple, lowest: str) -> Column:
    expr = F.when(v.isNull(), MISSING)
    for limit, label in at_least:
        expr = expr.when(v >= limit, label)
    for limit, label in above:
        expr = expr.when(v > limit, label)
    return expr.otherwise(lowest)


def rain_category(v: Column) -> Column:
    return _graded(v, RAIN_CATEGORIES, RAIN_DRY_CATEGORIES, RAIN_LOWEST)


def temp_category(v: Column) -> Column:
    return _graded(v, TEMP_CATEGORIES, TEMP_COOL_CATEGORIES, TEMP_LOWEST)


def likelihood_word(p: Column) -> Column:
    pct = F.coalesce(p, F.lit(0.0)) * 100
    expr = None
    for limit, word in LIKELIHOODS:
        expr = F.when(pct < limit, word) if expr is None else expr.when(pct < limit, word)
    return expr.otherwise(LIKELIHOOD_TOP)


def round10(p: Column) -> Column:
    """Probability to the nearest ten percent, ties to even."""
    return F.bround(F.coalesce(p, F.lit(0.0)) * 10).cast("int") * 10


def odds_text(p: Column) -> Column:
    return F.when(p.isNull(), MISSING).otherwise(
        F.concat(likelihood_word(p), F.lit(" · "), round10(p).cast("string"), F.lit("%"))
    )


def rain_lean(wetter: Column, near: Column, drier: Column) -> Column:
    """Largest of three odds, earlier one on ties, with its rounded percentage."""
    options = F.array(
        F.struct(wetter.alias("p"), F.lit(3).alias("rank"), F.lit("Wetter than normal").alias("label")),
        F.struct(near.alias("p"), F.lit(2).alias("rank"), F.lit("Near normal").alias("label")),
        F.struct(drier.alias("p"), F.lit(1).alias("rank"), F.lit("Drier than normal").alias("label")),
    )
    best = F.array_max(F.filter(options, lambda o: o["p"].isNotNull()))
    return F.when(best.isNull(), MISSING).otherwise(
        F.concat(best["label"], F.lit(" · "), round10(best["p"]).cast("string"), F.lit("%"))
    )


def onset_status(departure: Column) -> Column:
    """Onset proxy from the season departure; null is normal."""
    return (
        F.when(departure <= -60, "not_started")
        .when(departure <= -25, "delayed")
        .when(departure >= 25, "active")
        .otherwise("normal")
    )


def pct_of_normal(forecast: Column, normal: Column) -> Column:
    """Percent of normal; null where the normal is not positive."""
    return forecast / F.when(normal > 0, normal) * 100.0


def low_skill(acc: Column, threshold: float = 0.3) -> Column:
    """1 where skill is below the threshold or unknown."""
    return F.when(acc >= threshold, 0).otherwise(1)


def _channel(start: float, end: Column | float, t: Column) -> Column:
    return F.bround(F.lit(float(start)) + t * (F.lit(end) - start if not isinstance(end, Column) else end - start)).cast("int")


def red_scale(frac: Column) -> Column:
    """Style text on a white to dark-red scale with readable text colour."""
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), frac))
    r, g = _channel(255, 139.0, f), _channel(255, 0.0, f)
    text = F.when(f >= 0.5, "#ffffff").otherwise("#5a1a1a")
    return F.concat(
        F.lit("background-color:rgb("), r.cast("string"), F.lit(","), g.cast("string"), F.lit(","),
        g.cast("string"), F.lit("); color:"), text, F.lit(";"),
    )


def warm_shade(v: Column) -> Column:
    return F.when(v.isNull() | (v < 1), "").otherwise(red_scale(v / 6.0))


def dry_shade(v: Column) -> Column:
    return F.when(v.isNull() | (v > -1), "").otherwise(red_scale(-v / 10.0))


def rain_cell_class(v: Column) -> Column:
    """Shade class of a rainfall table cell."""
    return (
        F.when(v <= -3, "background-color:#f5b7b1; color:#7b241c;")
        .when(v <= -1, "background-color:#fad7d4;")
        .when(v >= 7, "background-color:#aed6f1; color:#1a5276;")
        .when(v >= 3, "background-color:#d4e6f1;")
        .otherwise("")
    )


def temp_cell_class(v: Column) -> Column:
    """Shade class of a temperature table cell."""
    return (
        F.when(v >= 4, "background-color:#f5b7b1; color:#7b241c;")
        .when(v >= 1.5, "background-color:#fad7d4;")
        .when(v <= -1.5, "background-color:#d4e6f1; color:#1a5276;")
        .otherwise("")
    )


def map_colour(v: Column, ramp: str) -> Column:
    """Diverging hex colour, white at zero and saturated at the ramp's span."""
    cfg = RAMPS[ramp]
    t = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v / cfg["span"]))
    strength = F.abs(t)
    channels = []
    for pos, neg in zip(cfg["pos"], cfg["neg"]):
        end = F.when(t >= 0, F.lit(float(pos))).otherwise(F.lit(float(neg)))
        channels.append(F.bround(255.0 + strength * (end - 255.0)).cast("int"))
    return F.when(v.isNull(), NO_VALUE_COLOUR).otherwise(F.format_string("#%02x%02x%02x", *channels))


def signed(v: Column, decimals: int) -> Column:
    """Number with an explicit sign, ties to even."""
    size = F.abs(F.bround(v, decimals))
    return F.concat(F.when(v < 0, "-").otherwise("+"), F.format_string(f"%.{decimals}f", size))


def unsigned(v: Column, decimals: int) -> Column:
    """Number with a sign only when negative, ties to even."""
    size = F.abs(F.bround(v, decimals))
    return F.concat(F.when(v < 0, "-").otherwise(""), F.format_string(f"%.{decimals}f", size))


def value_label(v: Column, decimals: int, unit: str) -> Column:
    """Map label such as ``+1.5 mm/day``, or ``n/a``."""
    return F.when(v.isNull(), "n/a").otherwise(F.concat(signed(v, decimals), F.lit(f" {unit}")))


# Departure bands of the published maps and their midpoints.
DEPARTURE_BANDS = ((60, "large_excess", 80), (20, "excess", 40), (-19, "normal", 0), (-59, "deficient", -40))
DEPARTURE_LOWEST = ("large_deficient", -80)


def departure_band(pct: Column) -> Column:
    """Band of a percent departure."""
    expr = None
    for limit, name, _ in DEPARTURE_BANDS:
        expr = F.when(pct >= limit, name) if expr is None else expr.when(pct >= limit, name)
    return expr.when(pct.isNotNull(), DEPARTURE_LOWEST[0])


def band_midpoint(band: Column) -> Column:
    """Percent that stands for a band."""
    expr = F.when(band == DEPARTURE_LOWEST[0], DEPARTURE_LOWEST[1])
    for _, name, mid in DEPARTURE_BANDS:
        expr = expr.when(band == name, mid)
    return expr
