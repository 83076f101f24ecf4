"""Map pixels to values: panel boxes, pixel lookup, colour to anomaly.

Pixels of an image are kept in square tiles, a row each, so that a target meets its
surroundings as a few rows and searches inside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfold.functions import geo
from skyfold.functions.signals import rain_signal, tmax_signal
from skyfold.session import stage

# Colour keys (value, r, g, b), scale sizes, pixel limits, scan margins.
RAIN_KEYS = (
    (-15.0, 215, 14, 0),
    (-10.0, 255, 82, 0),
    (-7.0, 255, 142, 29),
    (-3.0, 255, 202, 89),
    (-1.0, 255, 244, 165),
    (0.0, 255, 255, 255),
    (1.0, 200, 200, 233),
    (3.0, 140, 140, 191),
    (7.0, 100, 100, 163),
    (10.0, 60, 60, 135),
    (15.0, 30, 30, 100),
)
TMAX_KEYS = (
    (-6.0, 16, 16, 58),
    (-5.0, 56, 56, 128),
    (-4.0, 90, 90, 156),
    (-3.0, 130, 130, 184),
    (-2.0, 170, 170, 212),
    (-1.0, 200, 200, 233),
    (0.0, 220, 220, 247),
    (0.5, 255, 250, 205),
    (1.0, 255, 166, 53),
    (2.0, 255, 118, 5),
    (3.0, 255, 94, 0),
    (4.0, 255, 46, 0),
    (5.0, 195, 4, 0),
    (6.0, 115, 0, 0),
)
RAIN_STEPS, TMAX_STEPS = 300, 240
AXIS_BLACK, BORDER_BLACK = 10, 15
SIDE_MARGIN, TOP_MARGIN, MIN_PANEL_WIDTH = 10, 30, 100
WHITE = 255
#: Side of a tile; a ring search must not reach farther than that.
TILE = 16


def is_black(limit: int, r: str = "r", g: str = "g", b: str = "b") -> Column:
    return (F.col(r) < limit) & (F.col(g) < limit) & (F.col(b) < limit)


def scale_colour(step: Column, keys: tuple, steps: int) -> Column:
    """Colour of a step of the dense scale: linear between keys, channels truncated."""
    first, last = keys[0][0], keys[-1][0]
    value = F.lit(first) + (F.lit(last - first) * step) / steps
    expr = None
    for lo, hi in zip(keys, keys[1:]):
        frac = (value - lo[0]) / (hi[0] - lo[0])
        colour = F.struct(
            value.alias("value"),
            *[(F.lit(lo[i]) + frac * (hi[i] - lo[i])).cast("int").alias("rgb"[i - 1]) for i in (1, 2, 3)],
        )
        hit = (value >= lo[0]) & (value <= hi[0])
        expr = F.when(hit, colour) if expr is None else expr.when(hit, colour)
    return expr


def dense_scale(keys: tuple, steps: int) -> Column:
    """Whole scale as one array literal of ``(idx, value, r, g, b)``."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(steps)),
        lambda i: F.struct(i.alias("idx"), scale_colour(i, keys, steps).alias("c")),
    )


def nearest_value(scale: Column, r: Column, g: Column, b: Column) -> Column:
    """Value of the closest colour in the scale; the first one on ties."""
    def sq(x: Column) -> Column:
        return x * x

    best = F.array_min(
        F.transform(
            scale,
            lambda s: F.struct(
                (sq(r - s["c"]["r"]) + sq(g - s["c"]["g"]) + sq(b - s["c"]["b"])).alias("d"),
                s["idx"].alias("idx"),
                s["c"]["value"].alias("value"),
            ),
        )
    )
    return best["value"]


def colours_to_values(df: DataFrame, keys: tuple, steps: int, name: str = "value") -> DataFrame:
    """Add the scale value of each row's colour. Distinct colours are matched once, then joined back."""
    colours = df.select("r", "g", "b").distinct().withColumn("_scale", dense_scale(keys, steps))
    table = colours.select("r", "g", "b", nearest_value(F.col("_scale"), F.col("r"), F.col("g"), F.col("b")).alias(name))
    return df.join(table, ["r", "g", "b"])


def panel_bounds(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Axis box of the four map panels of each image.

    A row or column of a quadrant is an axis line when more than half of its
    pixels are black; the box spans the outermost lines. Too-narrow boxes take
    the width of the panel above them. ``sizes`` has ``image_id, width, height``.
    """
    half_w, half_h = F.floor(F.col("width") / 2), F.floor(F.col("height") / 2)
    p = pixels.join(sizes, "image_id")
    right, low = F.col("x") >= half_w, F.col("y") >= half_h
    inside = (
        (F.col("x") >= SIDE_MARGIN)
        & (F.col("y") >= TOP_MARGIN)
        & (~right | (F.col("x") < F.col("width") - SIDE_MARGIN))
        & (~low | (F.col("y") < F.col("height") - SIDE_MARGIN))
    )
    panel = F.when(~right & ~low, 1).when(right & ~low, 2).when(~right & low, 3).otherwise(4)
    dark = p.where(inside & is_black(AXIS_BLACK)).withColumn("panel", panel)
    span_x = F.when(F.col("panel") % 2 == 1, half_w - SIDE_MARGIN).otherwise(F.col("width") - SIDE_MARGIN - half_w)
    span_y = F.when(F.col("panel") <= 2, half_h - TOP_MARGIN).otherwise(F.col("height") - SIDE_MARGIN - half_h)
    along = F.array(F.struct(F.lit("x").alias("axis"), F.col("x").alias("at"), span_y.alias("span")), F.struct(F.lit("y").alias("axis"), F.col("y").alias("at"), span_x.alias("span")))
    counts = dark.select("image_id", "panel", F.inline(along)).groupBy("image_id", "panel", "axis", "at").agg(F.count("*").alias("n"), F.first("span").alias("span"))
    ends = [f(F.when(F.col("axis") == axis, F.col("at"))).alias(f"{axis}{k}") for axis in "xy" for k, f in ((0, F.min), (1, F.max))]
    box = counts.where("n > span * 0.5").groupBy("image_id", "panel").agg(*ends).where("x0 is not null and y0 is not null")
    width = F.col("x1") - F.col("x0")
    above = Window.partitionBy("image_id", F.col("panel") % 2).orderBy("panel")
    box = box.withColumn("ok", width >= MIN_PANEL_WIDTH).withColumn("_w", F.lag(F.when(F.col("ok"), width)).over(above))
    return box.where(F.col("ok") | F.col("_w").isNotNull()).select(
        "image_id", "panel", "x0", "y0", F.when(F.col("ok"), F.col("x1")).otherwise(F.col("x0") + F.col("_w")).alias("x1"), "y1",
        (~F.col("ok")).alias("repaired"),
    )


def tiles_of(pixels: DataFrame) -> DataFrame:
    """``image_id, tx, ty, pixels``: the pixels of an image in tiles of 16 by 16, an array of (x, y, r, g, b) in each."""
    at = [F.floor(F.col(c) / TILE).cast("int").alias(f"t{c}") for c in "xy"]
    return pixels.select("image_id", *at, F.struct("x", "y", "r", "g", "b").alias("p")).groupBy("image_id", "tx", "ty").agg(F.collect_list("p").alias("pixels"))


def image_sizes(tiles: DataFrame) -> DataFrame:
    """Width and height of the images as far as pixels are known."""
    edge = [F.max(F.array_max(F.transform("pixels", lambda p: p[c]))) + 1 for c in "xy"]
    return tiles.groupBy("image_id").agg(edge[0].alias("width"), edge[1].alias("height"))


def pixels_in(tiles: DataFrame) -> DataFrame:
    """The pixels of tiles, a row each."""
    return tiles.select("image_id", F.inline("pixels"))


def nearest_clear_pixel(targets: DataFrame, tiles: DataFrame, radius: int, black: int = BORDER_BLACK) -> DataFrame:
    """Colour at each target pixel, or of the nearest non-black pixel in growing rings.

    ``targets`` has ``id, image_id, x, y`` inside the image. A target meets its own pixel
    by place. Only a black one meets the tile it lies in, and of the tiles round it those
    that are no farther away than what its own tile has; it takes the best of their best
    pixels. White where no ring has a clear pixel.
    """
    reach = radius + 9
    if reach > TILE:
        raise ValueError(f"a radius of {radius} reaches beyond the tiles beside a pixel's own")
    own = [F.floor(F.col(c) / TILE).cast("int").alias(f"t{c}") for c in "xy"]

    def is_dark(p: Column) -> Column:
        return (p["r"] < black) & (p["g"] < black) & (p["b"] < black)

    def ranked(p: Column) -> Column:
        dx, dy = p["x"] - F.col("x"), p["y"] - F.col("y")
        return F.struct(
            F.greatest(F.abs(dx), F.abs(dy)).alias("ring"), (dx * dx + dy * dy).alias("d2"), dy.alias("dy"), dx.alias("dx"),
            p["r"].alias("r"), p["g"].alias("g"), p["b"].alias("b"),
        )

    def near(p: Column) -> Column:
        return (F.abs(p["x"] - F.col("x")) <= reach) & (F.abs(p["y"] - F.col("y")) <= reach) & ~is_dark(p)

    best = F.array_min(F.transform(F.filter("pixels", near), ranked)).alias("best")
    first = pixels_in(tiles).groupBy("image_id", "x", "y").agg(*(F.first(k).alias(k) for k in "rgb"))
    here = targets.join(first, ["image_id", "x", "y"])
    dark = F.coalesce((F.col("r") < black) & (F.col("g") < black) & (F.col("b") < black), F.lit(True))
    clear = here.where(~dark).select(*targets.columns, *"rgb")
    within = here.where(dark).select(*targets.columns, *own).join(tiles, ["image_id", "tx", "ty"]).select(*targets.columns, "tx", "ty", best)
    within = stage(within, "dark-pixels")

    def gap(c: str, step: int) -> Column:
        """Steps from the pixel to the first one of a tile beside its own."""
        inside = F.col(c) - F.col(f"t{c}") * TILE
        return {-1: inside + 1, 0: F.lit(0), 1: F.lit(TILE) - inside}[step]

    def tile(i: int, j: int) -> Column:
        away = F.greatest(gap("x", i), gap("y", j))
        near_by = (away <= reach) & (F.col("best").isNull() | (away <= F.col("best.ring")))
        return F.when(near_by, F.struct((F.col("tx") + i).alias("tx"), (F.col("ty") + j).alias("ty")))

    beside = F.array_compact(F.array(*(tile(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)))
    round_ = within.select(*targets.columns, F.inline(beside)).join(tiles, ["image_id", "tx", "ty"])
    around = round_.select("id", best).groupBy("id").agg(F.min("best").alias("beside"))
    found = within.join(around, "id", "left").withColumn("best", F.least("best", "beside"))
    return clear.unionByName(found.select(*targets.columns, *(F.coalesce(f"best.{k}", F.lit(WHITE)).alias(k) for k in "rgb")))


def map_spots(places: DataFrame, panels: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pixel of every place in every panel of its image, and whether it lies ``on`` the image."""
    boxes = panels.join(sizes, "image_id").select("image_id", "panel", "x0", "y0", "width", "height")
    px, py = geo.pixel_of(F.col("lat"), F.col("lon"), F.col("x0"), F.col("y0"))
    spots = places.join(boxes, "image_id").withColumn("x", px).withColumn("y", py)
    on = (F.col("x") >= 0) & (F.col("x") < F.col("width")) & (F.col("y") >= 0) & (F.col("y") < F.col("height"))
    return spots.withColumn("on", on)


def read_map(places: DataFrame, tiles: DataFrame, panels: DataFrame, sizes: DataFrame, kind: str = "rain") -> DataFrame:
    """Value and signal of every place in every panel; places off the image are marked."""
    spots = map_spots(places, panels, sizes).withColumn("id", F.struct("state", "district", "image_id", "panel"))
    keys, steps, radius = (RAIN_KEYS, RAIN_STEPS, 3) if kind == "rain" else (TMAX_KEYS, TMAX_STEPS, 2)
    seen = colours_to_values(nearest_clear_pixel(spots.where("on").select("id", "image_id", "x", "y"), tiles, radius), keys, steps)
    signal = rain_signal(F.col("value")) if kind == "rain" else tmax_signal(F.col("value"))
    rgb = F.concat(F.lit("("), F.concat_ws(",", *[F.col(c).cast("string") for c in "rgb"]), F.lit(")"))
    values = seen.select("id", F.round("value", 1).alias("value"), signal.alias("signal"), rgb.alias("rgb"))
    return spots.join(values, "id", "left").select(
        "state", "district", "image_id", "panel", "x", "y", "value",
        F.coalesce("signal", F.lit("UNKNOWN")).alias("signal"),
        F.coalesce("rgb", F.lit("OUT_OF_BOUNDS")).alias("rgb"),
    )


def panels_to_wide(read: DataFrame) -> DataFrame:
    """One row per place with the four weeks side by side."""
    aggs = []
    for w in (1, 2, 3, 4):
        here = F.col("panel") == w
        aggs += [
            F.max(F.when(here, F.col("rgb"))).alias(f"week{w}_rgb"),
            F.max(F.when(here, F.col("value"))).alias(f"week{w}_value"),
            F.max(F.when(here, F.col("signal"))).alias(f"week{w}_signal"),
        ]
    return read.groupBy("state", "district", "image_id").agg(*aggs)
