"""Header patterns, cell predicates, splitting, colours and panels on small hand-made inputs."""

import pytest
from pyspark.sql import functions as F

from skyfold.operators import extract, raster

TABLES = {
    # one header row, then data
    "compact": (
        [
            ["Condition", "Major Farming situation", "Normal Crop / cropping system", "Change in crop / cropping system", "Agronomic measures", "Remarks on Implementation"],
            ["Early season drought (delayed onset)", "Upland", "Rice", "Grow maize in place of rice", "Mulch the rows", ""],
        ],
        ("measures", 1, None, {"condition": 0, "farming": 1, "normal": 2, "change": 3, "agro": 4, "remarks": 5}),
    ),
    # header wrapped over short fragment rows and padded with blank columns
    "wrapped": (
        [
            ["Condition", None, "Normal crop/", None, "Change in", None, "Agronomic"],
            ["", None, "cropping system", None, "crop/cropping", None, "measures"],
            ["", None, "", None, "system", None, ""],
            ["Mid season drought (long dry spell)", None, "Groundnut", None, "Sow short-duration pulses at once", None, "Give one life-saving irrigation"],
        ],
        ("measures", 3, None, {"condition": 0, "normal": 2, "change": 4, "agro": 6}),
    ),
    # condition text and sub-headers share a row, which is header and first data row
    "mixed": (
        [
            ["Mid season drought", "Major farming situation", "Crop management", "Soil nutrient & moisture conservation measures"],
            ["", "Terrace", "Weed the plots by hand", "Lay straw between the rows"],
        ],
        ("measures", 0, "mid_season_break", {"farming": 1, "change": 2, "agro": 3}),
    ),
    # a row with the condition only, then growth stages in columns and crops in rows
    "stages": (
        [
            ["Heavy rainfall with high speed winds", None, None, None],
            ["", "Vegetative stage", "Flowering stage", "Crop maturity stage"],
            ["Rice", "Drain the field and add urea", "Drain the field", "Harvest at once and dry the sheaves"],
        ],
        ("stages", 2, "excess_rainfall_waterlogging", {"stage:vegetative stage": 1, "stage:flowering stage": 2, "stage:crop maturity": 3, "condition": 0}),
    ),
    "not a plan": ([["Name", "Area", "Yield"], ["Rice", "12", "2.1"]], None),
}


def cells(spark, tables, page_of=lambda i: 0):
    rows = [
        (name, page_of(i), 0, r, c, text)
        for i, (name, table) in enumerate(tables)
        for r, line in enumerate(table)
        for c, text in enumerate(line)
    ]
    return spark.createDataFrame(rows, "doc_id string, page int, table int, row int, col int, text string")


def test_header_patterns(spark):
    df = cells(spark, [(n, t) for n, (t, _) in TABLES.items()])
    got = {r["doc_id"]: r for r in extract.analyze_tables(df).collect()}
    for name, (_, want) in TABLES.items():
        if want is None:
            assert name not in got
            continue
        r = got[name]
        assert (r["kind"], r["data_start"], r["table_scenario"]) == want[:3], name
        assert {a["role"]: a["col"] for a in r["anchors"]} == want[3], name


def test_continuation_takes_the_last_header(spark):
    follow = [["Terminal drought", "Upland", "Rice", "-do-", "Give a last irrigation to the crop", ""], ["", "", "", "Sell surplus seed stock", "-do-", ""]]
    unrelated = [["a", "b", "c", "d", "e", "f"], ["1", "2", "3", "4", "5", "6"]]
    first = TABLES["compact"][0]
    rows = [("plan", p, 0, r, c, x) for p, t in enumerate((first, follow, unrelated)) for r, line in enumerate(t) for c, x in enumerate(line)]
    df = spark.createDataFrame(rows, "doc_id string, page int, table int, row int, col int, text string")
    got = {(r["page"], r["row"], r["column"], r["action"], r["scenario"], r["resolved_from_ditto"]) for r in extract.harvest(df).collect()}
    assert got == {
        (0, 1, "change", "Grow maize in place of rice", "early_season_dry_spell", False),
        (0, 1, "agro", "Mulch the rows", "early_season_dry_spell", False),
        (1, 0, "agro", "Give a last irrigation to the crop", "terminal_drought", False),
        (1, 1, "change", "Sell surplus seed stock", "terminal_drought", False),
    }


@pytest.mark.parametrize(
    "text, want",
    [
        ("Terminal  drought", "terminal_drought"), ("Mid-season drought", "mid_season_break"), ("Mid\nseason dry spell", "mid_season_break"),
        ("Continuous high rainfall", "excess_rainfall_waterlogging"), ("Delay by 2 weeks", "delayed_monsoon"), ("Delayed onset by 2 weeks", "delayed_monsoon"),
        ("Delay by 6 weeks", "early_season_dry_spell"), ("Normal onset, then dry spell", "early_season_dry_spell"), ("Rice", None), ("", None),
    ],
)
def test_condition_text(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(extract.condition_scenario(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("• Drain the excess water • Apply urea", ["Drain the excess water", "Apply urea"]),
        ("1. Drain the excess water 2. Apply urea", ["Drain the excess water", "Apply urea"]),
        ("1.Drain the excess water 2.Apply urea", ["Drain the excess water", "Apply urea"]),
        ("i) Sow early ii) Weed twice", ["Sow early", "Weed twice"]),
        ("Spray 19-19-19 at 1.5 kg per ha", ["Spray 19-19-19 at 1.5 kg per ha"]),
        ("Use bins, i.e. sealed ones", ["Use bins, i.e. sealed ones"]),
        ("and the rest", []), ("NA", []), ("Condition", []), ("Agronomic measuresi", []),
    ],
)
def test_splitting(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert [r["action"] for r in extract.explode_actions(df, "t").orderBy("piece").collect()] == want


def test_placeholder_and_ditto(spark):
    df = spark.createDataFrame([("N.A.",), ("No change",), ("-do-",), ("As above",), ("Sow",)], "t string")
    got = [(r[0], r[1]) for r in df.select(extract.is_placeholder(F.col("t")), extract.is_ditto(F.col("t"))).collect()]
    assert got == [(True, False), (True, False), (False, True), (False, True), (False, False)]


def test_colours_of_known_readings(spark):
    df = spark.createDataFrame([(255, 202, 89), (255, 255, 255)], "r int, g int, b int")
    rain = {r["r"] * 1000000 + r["g"] * 1000 + r["b"]: round(r["value"], 1) for r in raster.colours_to_values(df, raster.RAIN_KEYS, raster.RAIN_STEPS).collect()}
    assert rain == {255202089: -3.0, 255255255: 0.0}
    hot = spark.createDataFrame([(115, 0, 0)], "r int, g int, b int")
    assert raster.colours_to_values(hot, raster.TMAX_KEYS, raster.TMAX_STEPS).first()["value"] == 6.0


def test_narrow_panel_takes_width_of_the_one_above(spark):
    w, h = 600, 400
    lines = {(1, 20, 250), (2, 320, 560), (3, 20, 250), (4, 320, 380)}
    dark = set()
    for panel, x0, x1 in lines:
        y0, y1 = (40, 180) if panel <= 2 else (220, 370)
        lo_y, hi_y = (30, 200) if panel <= 2 else (200, 390)
        lo_x, hi_x = (10, 300) if panel % 2 else (300, 590)
        dark |= {(x, y) for x in (x0, x1) for y in range(lo_y, hi_y)} | {(x, y) for y in (y0, y1) for x in range(lo_x, hi_x)}
    px = spark.createDataFrame([("m", x, y, 0, 0, 0) for x, y in dark], "image_id string, x int, y int, r int, g int, b int")
    # full-width lines also fill the gaps, so only column lines bound a panel
    size = spark.createDataFrame([("m", w, h)], "image_id string, width int, height int")
    got = {r["panel"]: (r["x0"], r["x1"], r["repaired"]) for r in raster.panel_bounds(px, size).collect()}
    assert got == {1: (20, 250, False), 2: (320, 560, False), 3: (20, 250, False), 4: (320, 560, True)}
