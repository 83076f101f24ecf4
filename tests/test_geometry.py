"""Polygons with holes and several parts against plain Python."""

from skyfold.operators import region
from skyfold.sources.records import read_polygons

SQUARE = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]
HOLE = [[2, 2], [2, 6], [6, 6], [6, 2], [2, 2]]
SAME_WAY = [[2, 2], [6, 2], [6, 6], [2, 6], [2, 2]]
ISLAND = [[20, 0], [22, 0], [22, 2], [20, 2], [20, 0]]
FLAT = [[30, 1], [32, 1], [34, 1], [30, 1]]


def features(spark, tmp_path, shapes):
    import json

    out = []
    for name, kind, coordinates in shapes:
        out.append({"type": "Feature", "properties": {"NAME_1": "S", "NAME_2": name}, "geometry": {"type": kind, "coordinates": coordinates}})
    text = json.dumps({"type": "FeatureCollection", "features": out})
    path = str(tmp_path / "features.json")
    with open(path, "w") as f:
        f.write(text)
    return read_polygons(spark, path)


def test_holes_and_parts(spark, tmp_path):
    p = features(spark, tmp_path, [("holed", "Polygon", [SQUARE, HOLE]), ("same", "Polygon", [SQUARE, SAME_WAY]), ("two", "MultiPolygon", [[SQUARE, HOLE], [ISLAND]]), ("flat", "Polygon", [FLAT])])
    points = spark.createDataFrame([(y + 0.5, x + 0.5) for x in range(25) for y in range(12)], "lat double, lon double")
    got = {}
    for r in region.cells_inside(points, p).collect():
        got.setdefault(r["district"], set()).add((r["lon"], r["lat"]))
    square = {(x + 0.5, y + 0.5) for x in range(10) for y in range(10) if not (2 <= x < 6 and 2 <= y < 6)}
    assert got["holed"] == got["same"] == square
    assert got["two"] == square | {(x + 0.5, y + 0.5) for x in (20, 21) for y in (0, 1)}
    centre = {r["district"]: (r["lon"], r["lat"]) for r in region.centroids(p).collect()}
    hole = ((100 * 5 - 16 * 4) / 84, (100 * 5 - 16 * 4) / 84)
    for name in ("holed", "same"):
        assert max(abs(a - b) for a, b in zip(centre[name], hole, strict=True)) < 1e-9
    two = ((84 * hole[0] + 4 * 21) / 88, (84 * hole[1] + 4 * 1) / 88)
    assert max(abs(a - b) for a, b in zip(centre["two"], two, strict=True)) < 1e-9
    assert centre["flat"] == (32.0, 1.0)


def test_nearest_place_equals_a_scan(spark):
    import random

    rng = random.Random(2)
    places = [("S", f"d{k}", rng.uniform(-5, 60), rng.uniform(60, 100)) for k in range(40)] + [("S", "far", -80.0, -170.0)]
    queries = [(rng.uniform(-89, 89), rng.uniform(-179, 179)) for _ in range(60)] + [(places[0][2], places[0][3])]
    df = region.nearest_place(
        spark.createDataFrame(queries, "lat double, lon double"), spark.createDataFrame(places, "state string, district string, lat double, lon double")
    )
    got = {(r["lat"], r["lon"]): r["near"]["district"] for r in df.collect()}
    for lat, lon in queries:
        best = min(((lat - p[2]) ** 2 + (lon - p[3]) ** 2, p[0], p[1]) for p in places)
        assert got[lat, lon] == best[2]


def test_nearest_place_far_from_a_dense_degree(spark):
    """All places in one degree, most points far away: a point meets the places of few cells."""
    import random

    rng = random.Random(5)
    places = [("S", f"d{k:04}", 20 + rng.random(), 70 + rng.random()) for k in range(1500)] + [("S", "same1", 20.5, 70.5), ("R", "same2", 20.5, 70.5)]
    queries = [(rng.uniform(-89, 89), rng.uniform(-179, 179)) for _ in range(80)] + [(20 + rng.random(), 70 + rng.random()) for _ in range(80)] + [(20.5, 70.5), (None, 1.0)]
    table = spark.createDataFrame(places, "state string, district string, lat double, lon double")
    got = {(r["lat"], r["lon"]): r["near"] for r in region.nearest_place(spark.createDataFrame(queries, "lat double, lon double"), table).collect()}
    for lat, lon in queries[:-1]:
        best = min(((lat - p[2]) ** 2 + (lon - p[3]) ** 2, p[0], p[1]) for p in places)
        assert (got[lat, lon]["d2"], got[lat, lon]["state"], got[lat, lon]["district"]) == best
    assert got[None, 1.0] is None
    cells = region.place_cells(table)
    assert cells.agg({"level": "max"}).first()[0] >= 12 and cells.where("n > 1500").count() <= 11


def test_brackets_on_an_axis(spark):
    import random

    from pyspark.sql import functions as F

    from skyfold.operators import regrid

    rng = random.Random(6)
    axis = sorted({round(rng.uniform(-50, 50), 1) for _ in range(150)})
    values = [*axis[:20], *(rng.uniform(-60, 60) for _ in range(60)), None]
    grid = spark.createDataFrame([(x,) for x in axis], "c double")
    df = spark.createDataFrame([(x,) for x in values], "c double")
    at = F.col("_axis_c")
    rows = regrid.with_axes(df, grid, ("c",)).select("c", regrid.bracket(at, F.col("c")).alias("b"), *(regrid.nearest_on(at, F.col("c"), t).alias(t) for t in ("low", "high"))).collect()
    for r in rows:
        if r["c"] is None:
            assert r["b"] is None and r["low"] is None
            continue
        lo, hi = max((a for a in axis if a <= r["c"]), default=None), min((a for a in axis if a >= r["c"]), default=None)
        assert tuple(r["b"]) == (lo, hi)
        near = min(abs(a - r["c"]) for a in axis)
        ties = [a for a in axis if abs(a - r["c"]) == near]
        assert (r["low"], r["high"]) == (min(ties), max(ties))
