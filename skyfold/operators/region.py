"""Polygons to sparse cell weights, and weighted regional means."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfold.functions import geo
from skyfold.functions.text import alnum_key
from skyfold.operators.regrid import nearest_on, with_axes
from skyfold.session import stage

REGION = ["state", "district"]


def with_edges(polygons: DataFrame) -> DataFrame:
    """Add the edges of the outline and the holes of every polygon part, all in one array too, and its bounding box.

    ``holes`` is an optional column of rings; a point in a hole crosses two outlines and counts as outside.
    """
    outline = F.array(geo.ring_edges("ring"))
    rings = F.concat(outline, F.coalesce(geo.hole_edges("holes"), F.slice(outline, 1, 0))) if "holes" in polygons.columns else outline
    return (
        polygons.withColumn("rings", rings)
        .withColumn("edges", F.flatten("rings"))
        .withColumn("min_lon", F.expr("array_min(transform(ring, p -> p.lon))"))
        .withColumn("max_lon", F.expr("array_max(transform(ring, p -> p.lon))"))
        .withColumn("min_lat", F.expr("array_min(transform(ring, p -> p.lat))"))
        .withColumn("max_lat", F.expr("array_max(transform(ring, p -> p.lat))"))
    )


def cells_inside(points: DataFrame, polygons: DataFrame, bucket: float = 1.0) -> DataFrame:
    """Grid points inside any part of each region.

    Parts are spread over the degree buckets of their box and meet the points by
    an equi join on the bucket; the ray cast then runs on candidates only. AQE
    splits a bucket that holds many points.
    """
    parts = with_edges(polygons).select(
        *REGION,
        "edges",
        "min_lon",
        "max_lon",
        "min_lat",
        "max_lat",
        F.explode(
            F.sequence(F.floor(F.col("min_lat") / bucket), F.floor(F.col("max_lat") / bucket))
        ).alias("_by"),
    )
    parts = parts.withColumn(
        "_bx",
        F.explode(F.sequence(F.floor(F.col("min_lon") / bucket), F.floor(F.col("max_lon") / bucket))),
    )
    pts = points.select("lat", "lon").withColumn("_by", F.floor(F.col("lat") / bucket)).withColumn(
        "_bx", F.floor(F.col("lon") / bucket)
    )
    box = F.col("lat").between(F.col("min_lat"), F.col("max_lat")) & F.col("lon").between(
        F.col("min_lon"), F.col("max_lon")
    )
    return (
        pts.join(parts, ["_by", "_bx"])
        .where(box & geo.inside("edges", "lon", "lat"))
        .select(*REGION, "lat", "lon")
        .distinct()
    )


def centroids(polygons: DataFrame) -> DataFrame:
    """Area centroid of every region over all its parts; the middle of its box where it has no area."""
    area, mx, my = geo.area_moments("rings")
    box = ("min_lon", "max_lon", "min_lat", "max_lat")
    parts = with_edges(polygons).select(*REGION, *box, area.alias("a"), mx.alias("mx"), my.alias("my"))

    def middle(axis: str) -> Column:
        return (F.min(f"min_{axis}") + F.max(f"max_{axis}")) / 2.0

    return parts.groupBy(*REGION).agg(
        F.coalesce(F.try_divide(F.sum("mx"), 3.0 * F.sum("a")), middle("lon")).alias("lon"),
        F.coalesce(F.try_divide(F.sum("my"), 3.0 * F.sum("a")), middle("lat")).alias("lat"),
    )


def bounds(polygons: DataFrame) -> DataFrame:
    return with_edges(polygons).groupBy(*REGION).agg(
        F.min("min_lon").alias("west"),
        F.max("max_lon").alias("east"),
        F.min("min_lat").alias("south"),
        F.max("max_lat").alias("north"),
    )


def dissolve(polygons: DataFrame) -> DataFrame:
    """All rings of a region as one multipart row. A region's parts are bounded by its outline."""
    return polygons.groupBy(*REGION).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("part", "ring"))), lambda p: p["ring"]).alias("rings"),
        F.count("*").alias("n_parts"),
    )


def nearest_cell(regions: DataFrame, points: DataFrame) -> DataFrame:
    """Nearest latitude and, independently, nearest longitude to a region point."""
    placed = with_axes(regions, points)
    return placed.select(*REGION, *(nearest_on(F.col(f"_axis_{c}"), F.col(c), tie="low").alias(c) for c in ("lat", "lon")))


def region_weights(points: DataFrame, polygons: DataFrame, extra_points: DataFrame | None = None) -> DataFrame:
    """Sparse table of cos-latitude weights with a nearest-cell fallback.

    ``extra_points`` holds regions that have a point but no polygon. Write this
    table once per polygon set and grid and reuse it for every model and variable.
    """
    hit = stage(cells_inside(points, polygons), "cells-inside")
    centres = centroids(polygons).select(*REGION, "lat", "lon")
    if extra_points is not None:
        centres = centres.unionByName(extra_points.select(*REGION, "lat", "lon"))
    empty = centres.join(hit.select(*REGION).distinct(), REGION, "left_anti")
    fallback = nearest_cell(empty, points).withColumn("fallback", F.lit(True))
    return hit.withColumn("fallback", F.lit(False)).unionByName(fallback).withColumn("w", geo.cos_weight(F.col("lat")))


def regional_mean(
    values: DataFrame,
    weights: DataFrame,
    on: list[str],
    keys: list[str],
    variables: list[str],
    region: list[str] | None = None,
    null_policy: str = "skip",
) -> DataFrame:
    """Weighted mean per region.

    ``skip`` renormalises weights over non-null cells; ``propagate`` makes the
    mean null when any cell of the slice is null. Sums combine map-side, so only
    one row per region, key and task is shuffled.
    """
    region = region or REGION
    joined = values.join(weights.select(*region, *on, "w"), on)
    aggs = []
    for v in variables:
        x = F.nanvl(F.col(v).cast("double"), F.lit(None))
        mean = F.sum(F.col("w") * x) / F.sum(F.when(x.isNotNull(), F.col("w")))
        if null_policy == "propagate":
            mean = F.when(~F.bool_or(x.isNull()), mean)
        aggs.append(mean.alias(v))
    return joined.groupBy(*region, *keys).agg(*aggs)


def slice_propagating_mean(values: DataFrame, weights: DataFrame, on: list[str], keys: list[str], variable: str, region: list[str] | None = None) -> DataFrame:
    """Weighted mean that is null for every region when any cell of the grid slice is null."""
    region = region or REGION
    broken = values.groupBy(*keys).agg(F.bool_or(F.col(variable).isNull()).alias("_broken"))
    mean = regional_mean(values, weights, on, keys, [variable], region)
    return mean.join(broken, keys).withColumn(
        variable, F.when(~F.col("_broken"), F.col(variable))
    ).drop("_broken")


def match_polygons(names: DataFrame, polygons: DataFrame) -> DataFrame:
    """Polygon rows for each requested (state, district) name.

    Districts match on the letters-and-digits key; rows of the same state win
    over others when there are any. Names without polygon keep null and can fall
    back to their point.
    """
    p = polygons.select(
        alnum_key(F.col("district")).alias("_dk"),
        alnum_key(F.col("state")).alias("_sk"),
        F.struct(*[F.col(c) for c in polygons.columns]).alias("poly"),
    )
    n = names.withColumn("_dk", alnum_key(F.col("district"))).withColumn("_nk", alnum_key(F.col("state")))
    matched = n.join(p, "_dk", "left").withColumn("_same", F.coalesce(F.col("_sk") == F.col("_nk"), F.lit(False)))
    any_same = matched.groupBy("_dk", "_nk").agg(F.bool_or("_same").alias("_any"))
    return (
        matched.join(any_same, ["_dk", "_nk"])
        .where(F.col("_same") | ~F.col("_any"))
        .drop("_dk", "_sk", "_nk", "_same", "_any")
    )


def resolve_names(requests: DataFrame, roster: DataFrame) -> DataFrame:
    """Status of each requested district: ok, ambiguous (several states) or not_found with hints.

    ``requests`` has ``id``, ``state`` (nullable) and ``district``.
    """
    r = roster.select("state", "district").distinct().select(
        F.col("state").alias("r_state"),
        F.col("district").alias("r_district"),
        alnum_key(F.col("district")).alias("_dk"),
    )
    q = requests.withColumn("_dk", alnum_key(F.col("district")))
    hit = q.join(r, "_dk", "left").withColumn(
        "_ok",
        F.col("r_state").isNotNull()
        & (F.col("state").isNull() | (alnum_key(F.col("r_state")) == alnum_key(F.col("state")))),
    )
    ok_state = F.when(F.col("_ok"), F.col("r_state"))
    agg = hit.groupBy("id", "state", "district").agg(
        F.count_distinct(ok_state).alias("n_states"),
        F.min(ok_state).alias("first_state"),
        F.min(F.when(F.col("_ok"), F.col("r_district"))).alias("first_district"),
    )
    status = F.when(F.col("n_states") == 0, "not_found").when(F.col("n_states") > 1, "ambiguous").otherwise("ok")
    label = F.when(status == "ok", F.concat("first_district", F.lit(" district, "), "first_state"))
    return agg.select("id", "state", "district", "n_states", status.alias("status"), label.alias("label"))


def substring_hints(missing: DataFrame, roster: DataFrame, n: int = 3) -> DataFrame:
    """Roster names that contain a name that was not found, ignoring case.

    Names meet through shared character ``n``-grams, an equi join, instead of a
    pairwise scan; names shorter than ``n`` meet through their own length.
    """
    def grams(c: Column, size: int) -> Column:
        low = F.lower(c)
        return F.array_distinct(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(low) - size + 1)),
                lambda i: F.substring(low, i, F.lit(size)),
            )
        )

    out = None
    names = roster.select(F.col("district").alias("hint")).distinct()
    for size in range(1, n + 1):
        picked = missing.where(
            (F.length("district") == size) if size < n else (F.length("district") >= n)
        ).withColumn("_g", F.substring(F.lower("district"), 1, size))
        part = (
            picked.join(names.withColumn("_g", F.explode(grams(F.col("hint"), size))), "_g")
            .where(F.contains(F.lower("hint"), F.lower("district")))
            .drop("_g")
        )
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def focus_regions(regions: DataFrame, names: list[str], margin: float = 0.6) -> DataFrame:
    """States that equal or contain a wanted name, with the padded box around all of them."""
    wanted = [n.strip().lower() for n in names]
    low = F.lower("state")
    hit = F.lit(False)
    for w in wanted:
        hit = hit | F.contains(low, F.lit(w))
    return regions.where(hit).groupBy().agg(
        F.array_join(F.array_sort(F.collect_set("state")), ",").alias("names"),
        (F.min("west") - margin).alias("west"),
        (F.max("east") + margin).alias("east"),
        (F.min("south") - margin).alias("south"),
        (F.max("north") + margin).alias("north"),
    )


#: Side of the cell that holds every coordinate, in degrees, and how often a cell is quartered at most.
WORLD, DEEPEST = 1024.0, 24
#: A cell with no more places than this is not opened further.
FEW_PLACES = 64


def place_cells(places: DataFrame) -> DataFrame:
    """``level, ix, iy`` of every cell that holds places, with their number and the box they span.

    Levels go on as long as a cell of the one before holds more than a few places, so cells are as
    small as the places are dense.
    """
    def at(level: int) -> list[Column]:
        side = WORLD / (1 << level)
        return [F.floor((F.col(c) + WORLD / 2) / side).cast("long").alias(name) for c, name in (("lon", "ix"), ("lat", "iy"))]

    left, found, level = places.select("lat", "lon"), [], 0
    box = [F.count("*").alias("n"), *(f(c).alias(f"{name}_{c}") for c in ("lat", "lon") for f, name in ((F.min, "min"), (F.max, "max")))]
    while True:
        cells = stage(left.select(*at(level), "lat", "lon").groupBy("ix", "iy").agg(*box).withColumn("level", F.lit(level)), "place-cells")
        found.append(cells)
        dense = cells.where(F.col("n") > FEW_PLACES).select("ix", "iy")
        level += 1
        if level > DEEPEST or dense.isEmpty():
            return reduce(DataFrame.unionAll, found)
        left = stage(left.select(*at(level - 1), "lat", "lon").join(dense, ["ix", "iy"], "left_semi").select("lat", "lon"), "place-left")


def nearest_place(queries: DataFrame, places: DataFrame) -> DataFrame:
    """Nearest (state, district) point to each query point by squared degrees.

    Places stand in a quadtree as deep as they are dense. A point opens cells level by
    level and keeps those whose box is no farther than the farthest corner of its best
    one, so it meets the places of a few small cells wherever it lies. Ties go to the
    smaller name. Points with a null coordinate have no nearest place.
    """
    held = places.where("lat is not null and lon is not null")
    cells = stage(place_cells(held), "place-tree")
    asked = queries.select("lat", "lon").where("lat is not null and lon is not null").distinct()

    def beyond(c: str) -> Column:
        return F.greatest(F.lit(0.0), F.col(f"min_{c}") - F.col(c), F.col(c) - F.col(f"max_{c}"))

    def across(c: str) -> Column:
        return F.greatest(F.abs(F.col(c) - F.col(f"min_{c}")), F.abs(F.col(f"max_{c}") - F.col(c)))

    near = (beyond("lat") * beyond("lat") + beyond("lon") * beyond("lon")).alias("near")
    far = (across("lat") * across("lat") + across("lon") * across("lon")).alias("far")
    open_ = asked.select("lat", "lon", F.lit(0).cast("long").alias("ix"), F.lit(0).cast("long").alias("iy"), F.lit(math.inf).alias("reach"))
    final = []
    for level in range(DEEPEST + 1):
        here = open_.join(cells.where(F.col("level") == level), ["ix", "iy"]).select("lat", "lon", "ix", "iy", "reach", "n", near, far)
        best = F.least("reach", F.min("far").over(Window.partitionBy("lat", "lon")))
        kept = stage(here.withColumn("reach", best).where("near <= reach"), "place-search")
        last = F.col("n") <= FEW_PLACES if level < DEEPEST else F.lit(True)
        final.append(kept.where(last).select("lat", "lon", F.lit(level).alias("level"), "ix", "iy", "near", "reach"))
        deeper = kept.where(~last)
        if deeper.isEmpty():
            break
        quarters = F.array(*(F.struct((F.col("ix") * 2 + dx).alias("ix"), (F.col("iy") * 2 + dy).alias("iy")) for dx in (0, 1) for dy in (0, 1)))
        open_ = deeper.select("lat", "lon", "reach", F.inline(quarters))
    reached = reduce(DataFrame.unionAll, final)
    tightest = F.min("reach").over(Window.partitionBy("lat", "lon"))
    reached = reached.withColumn("reach", tightest).where("near <= reach").select("lat", "lon", "level", "ix", "iy")
    levels = F.transform(F.sequence(F.lit(0), F.lit(len(final) - 1)), lambda k: F.struct(k.alias("level"), F.pow(F.lit(2.0), k).alias("cuts")))
    spread = held.select("state", "district", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), F.inline(levels))

    def cell(c: str) -> Column:
        return F.floor((F.col(c) + WORLD / 2) / (F.lit(WORLD) / F.col("cuts"))).cast("long")

    spread = spread.select("*", cell("p_lon").alias("ix"), cell("p_lat").alias("iy"))
    d_lat, d_lon = F.col("lat") - F.col("p_lat"), F.col("lon") - F.col("p_lon")
    found = reached.join(spread, ["level", "ix", "iy"]).groupBy("lat", "lon").agg(
        F.min(F.struct((d_lat * d_lat + d_lon * d_lon).alias("d2"), "state", "district")).alias("near")
    )
    return queries.join(found, ["lat", "lon"], "left")
