"""Nearest and bilinear alignment of grids, and nearest-in-time matching.

An axis of a source grid is one sorted array, bounded by the grid's resolution (tens of
thousands of values at most). Every target row brackets its own coordinate in it by
binary search, a projection; values follow by equi join on the source coordinates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.operators.dedup import let

#: Halvings that an axis of any admitted length needs.
HALVINGS = 20


def axis_of(source: DataFrame, coord: str) -> Column:
    """The distinct coordinates of a grid in order, as one value."""
    return source.agg(F.sort_array(F.collect_set(F.col(coord).cast("double")))).scalar()


def with_axes(df: DataFrame, source: DataFrame, coords: tuple[str, ...] = ("lat", "lon")) -> DataFrame:
    """Rows with the axes of a grid beside them, as ``_axis_`` columns (array functions cannot hold the subquery itself)."""
    return df.withColumns({f"_axis_{c}": axis_of(source, c) for c in coords})


def bracket(axis: Column, c: Column) -> Column:
    """(lo, hi): the neighbours of ``c`` on the axis with ``lo <= c <= hi``; null beyond its ends."""
    def found(a: Column) -> Column:
        def halve(s: Column, _: Column) -> Column:
            middle = F.shiftright(s["low"] + s["high"], 1)
            right = F.struct((middle + 1).alias("low"), s["high"].alias("high"))
            left = F.struct(s["low"].alias("low"), middle.alias("high"))
            return F.when(s["low"] >= s["high"], s).when(F.get(a, middle) <= c, right).otherwise(left)

        start = F.struct(F.lit(0).alias("low"), F.size(a).alias("high"))
        above = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve)["low"]  # how many are not above c

        def pair(n: Column) -> Column:
            lo = F.when(n > 0, F.get(a, n - 1))
            return F.struct(lo.alias("lo"), F.when(lo == c, lo).otherwise(F.get(a, n)).alias("hi"))

        return F.when(c.isNotNull(), let(above, pair))

    return let(axis, found)


def nearest_on(axis: Column, c: Column, tie: str = "high") -> Column:
    """The nearest coordinate of an axis.

    ``tie`` says which neighbour wins at equal distance: ``high`` for grid
    alignment, ``low`` for first-index rules on ascending axes.
    """
    def choose(b: Column) -> Column:
        below, above = c - b["lo"], b["hi"] - c
        low_wins = (below < above) if tie == "high" else (below <= above)
        return F.when(b["lo"].isNull(), b["hi"]).when(b["hi"].isNull() | low_wins, b["lo"]).otherwise(b["hi"])

    return let(bracket(axis, c), choose)


def align_nearest(source: DataFrame, target_grid: DataFrame, values: list[str], extra: list[str] | None = None) -> DataFrame:
    """Source values moved to the nearest target grid points, per axis."""
    extra = extra or []
    points = with_axes(target_grid.select("lat", "lon").distinct(), source)
    mapped = points.select("lat", "lon", *(nearest_on(F.col(f"_axis_{c}"), F.col(c)).alias(f"_s{c}") for c in ("lat", "lon")))
    src = source.select(F.col("lat").alias("_slat"), F.col("lon").alias("_slon"), *extra, *values)
    return mapped.join(src, ["_slat", "_slon"]).drop("_slat", "_slon")


def _parts(axis: Column, c: Column) -> Column:
    """Array of (at, w): the source coordinates that an interpolated one is made of, with their weights; empty outside the axis."""
    def weighed(b: Column) -> Column:
        frac = F.when(b["hi"] == b["lo"], F.lit(0.0)).otherwise((c - b["lo"]) / (b["hi"] - b["lo"]))
        both = F.array(F.struct(b["lo"].alias("at"), (1.0 - frac).alias("w")), F.struct(b["hi"].alias("at"), frac.alias("w")))
        return F.filter(both, lambda p: p["w"] > 0)  # a null weight, beyond an end, is no part

    return let(bracket(axis, c), weighed)


def bilinear(source: DataFrame, target_grid: DataFrame, values: list[str], extra: list[str] | None = None) -> DataFrame:
    """Linear interpolation onto the target grid.

    Points outside the source hull, or with a missing corner of non-zero weight,
    come back without a value (null). Up to four corner rows per point meet the
    source by equi join and fold in a partial aggregation.
    """
    extra = extra or []
    points = with_axes(target_grid.select("lat", "lon").distinct(), source)
    for c in ("lat", "lon"):
        points = points.select("*", F.inline(_parts(F.col(f"_axis_{c}"), F.col(c))).alias(f"_s{c}", f"_w{c}")).drop(f"_axis_{c}")
    src = source.select(F.col("lat").alias("_slat"), F.col("lon").alias("_slon"), *extra, *values)
    w = F.col("_wlat") * F.col("_wlon")
    aggs = []
    for v in values:
        full = F.abs(F.sum(F.when(F.col(v).isNotNull(), w)) - 1.0) < 1e-9
        aggs.append(F.when(full, F.sum(w * F.col(v))).alias(v))
    return points.join(src, ["_slat", "_slon"]).groupBy("lat", "lon", *extra).agg(*aggs)


def asof_nearest_month(wanted: DataFrame, observed: DataFrame, keys: list[str], valid: str, month: str, tolerance_days: int | None) -> DataFrame:
    """Observation month nearest to each valid month, within a tolerance if there is one.

    Both sides are first-of-month dates, and a tolerance under a month can only
    reach the month itself or, around a shifted date, its neighbours: the wanted
    row is offered to the months its window touches and matched by equality. Without
    a tolerance the months of a key, few by their nature, are searched in one array.
    """
    if tolerance_days is None:
        carried = F.struct(F.col(month), *[F.col(c) for c in observed.columns if c not in (*keys, month)])
        months = observed.groupBy(*keys).agg(F.collect_list(carried).alias("_all"))
        near = F.array_min(F.transform("_all", lambda o: F.struct(F.abs(F.datediff(o[month], F.col(valid))).alias("d"), o.alias("o"))))
        return wanted.join(months, keys).withColumn("_o", near["o"]).select(*wanted.columns, "_o.*")
    lo, hi = F.date_sub(F.col(valid), tolerance_days), F.date_add(F.col(valid), tolerance_days)
    months = F.sequence(F.trunc(lo, "MM"), F.trunc(hi, "MM"), F.expr("interval 1 month"))
    offered = wanted.withColumn("_m", F.explode(months))
    obs = observed.withColumn("_m", F.trunc(month, "MM"))
    joined = offered.join(obs, [*keys, "_m"]).where(
        F.abs(F.datediff(F.col(month), F.col(valid))) <= tolerance_days
    )
    distance = F.struct(F.abs(F.datediff(F.col(month), F.col(valid))), F.col(month))
    carried = F.struct(*[F.col(c) for c in observed.columns if c not in keys])
    w_cols = [c for c in wanted.columns]
    best = joined.groupBy(*w_cols).agg(F.min_by(carried, distance).alias("_o"))
    return best.select(*w_cols, "_o.*")
