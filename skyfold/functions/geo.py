"""Planar geometry on ring columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tick calibration of the map panels, in pixels and degrees.
LON_TICKS_PX = (84, 285)
LON_TICKS_DEG = (70.0, 98.0)
LAT_TICKS_PX = (98, 355)
LAT_TICKS_DEG = (35.0, 5.0)
FIRST_PANEL_LEFT = 48
FIRST_PANEL_TOP = 72


def _edges_sql(ring: str) -> str:
    return (
        f"transform({ring}, (p, i) -> named_struct('x1', p.lon, 'y1', p.lat,"
        f" 'x2', {ring}[(i + 1) % size({ring})].lon, 'y2', {ring}[(i + 1) % size({ring})].lat))"
    )


def ring_edges(ring: str) -> Column:
    """Edges of an open ring as an array of ``(x1, y1, x2, y2)``."""
    return F.expr(_edges_sql(ring))


def hole_edges(holes: str) -> Column:
    """Edges of several open rings, an array for each."""
    return F.expr(f"transform({holes}, hole -> {_edges_sql('hole')})")


def inside(edges: str, lon: str, lat: str) -> Column:
    """Even-odd ray cast; points exactly on an edge are half-open."""
    return F.expr(
        f"aggregate({edges}, 0, (n, e) -> n + if((e.y1 > {lat}) != (e.y2 > {lat}) and"
        f" {lon} < (e.x2 - e.x1) * ({lat} - e.y1) / (e.y2 - e.y1) + e.x1, 1, 0)) % 2 = 1"
    )


def area_moments(rings: str) -> tuple[Column, Column, Column]:
    """Double area and the two moment sums of the centroid formula, of an outline less its holes.

    ``rings`` holds the edges of the outline, then those of each hole, whichever way they turn.
    """
    cross = "(e.x1 * e.y2 - e.x2 * e.y1)"

    def total(term: str) -> Column:
        turn = f"signum(aggregate(r, 0D, (s, e) -> s + {cross}))"
        each = f"transform({rings}, (r, i) -> if(i = 0, 1, -1) * {turn} * aggregate(r, 0D, (s, e) -> s + {term}))"
        return F.expr(f"aggregate({each}, 0D, (s, x) -> s + x)")

    return total(cross), total(f"(e.x1 + e.x2) * {cross}"), total(f"(e.y1 + e.y2) * {cross}")


def cos_weight(lat: Column) -> Column:
    return F.cos(F.radians(lat))


def pixel_of(lat: Column, lon: Column, panel_left: Column, panel_top: Column) -> tuple[Column, Column]:
    """Pixel of a point in a map panel, truncated toward zero."""
    per_lon = (LON_TICKS_PX[1] - LON_TICKS_PX[0]) / (LON_TICKS_DEG[1] - LON_TICKS_DEG[0])
    per_lat = (LAT_TICKS_PX[1] - LAT_TICKS_PX[0]) / (LAT_TICKS_DEG[0] - LAT_TICKS_DEG[1])
    x0 = panel_left + (LON_TICKS_PX[0] - FIRST_PANEL_LEFT)
    y0 = panel_top + (LAT_TICKS_PX[0] - FIRST_PANEL_TOP)
    px = (x0 + (lon - LON_TICKS_DEG[0]) * per_lon).cast("int")
    py = (y0 + (F.lit(LAT_TICKS_DEG[0]) - lat) * per_lat).cast("int")
    return px, py
