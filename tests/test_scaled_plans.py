"""Queries whose work must not stay in the task that reads a file or meet long rows again."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from skyfold.functions import text
from skyfold.operators import advisory, extract, raster
from skyfold.plans import extract_queries, record_queries
from skyfold.plans import views as v
from skyfold.plans.catalog import QUERIES


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_records_and_pixels_are_dealt_before_they_grow(spark, sf):
    assert "RepartitionByExpression [c_custkey" in plan(v.records(spark, sf))
    assert "RepartitionByExpression [p_partkey" in plan(v.pixels(spark, sf))


@pytest.mark.parametrize("key", ["ad4_scenario_actions", "ad5_baseline_actions", "jn24_library_join"])
def test_action_rows_meet_no_join(spark, sf, key):
    shown = plan(QUERIES[key](spark, sf))
    assert "Join" not in shown[: shown.index("Generate")]


def test_action_rows_are_dealt_anew_before_they_are_sorted(spark, sf):
    assert "RepartitionByExpression [district" in plan(QUERIES["dd2_concept_dedup"](spark, sf))


def test_records_of_one_name_keep_all_their_numbers(spark, tmp_path):
    spark.createDataFrame([(1, "a", 0, "x"), (2, "a", 0, "x"), (None, "b", 0, "x"), (4, None, 0, "x")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, "N")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    rows = record_queries.by_number(record_queries.named_records(spark, str(tmp_path)))
    assert sorted(str(r["k"]) for r in rows.collect()) == ["1", "1", "2", "2", "None"]


def test_only_dark_targets_meet_tiles(spark, monkeypatch):
    rng = random.Random(5)
    dark = {(x, y): (x // 13 + y // 9) % 2 == 0 or rng.random() < 0.3 for x in range(50) for y in range(40)}
    colour = {p: (0, 0, 0) if d else (200, rng.randint(0, 255), rng.randint(0, 255)) for p, d in dark.items()}
    pixels = spark.createDataFrame([("a", x, y, *c) for (x, y), c in colour.items()], "image_id string, x int, y int, r int, g int, b int")
    seen = []
    monkeypatch.setattr(raster, "stage", lambda df, name: seen.append(df.count()) or df)
    targets = pixels.select(F.struct("x", "y").alias("id"), "image_id", "x", "y")
    got = {(r["x"], r["y"]): (r["r"], r["g"], r["b"]) for r in raster.nearest_clear_pixel(targets, raster.tiles_of(pixels), 2).collect()}
    assert seen == [sum(dark.values())]

    def nearest(x, y):
        near = [(max(abs(a - x), abs(b - y)), (a - x) ** 2 + (b - y) ** 2, b - y, a - x) for a, b in dark if not dark[a, b] and max(abs(a - x), abs(b - y)) <= 11]
        return colour[x + min(near)[3], y + min(near)[2]] if near else (255, 255, 255)

    assert got == {p: nearest(*p) if d else colour[p] for p, d in dark.items()}


def test_folding_to_ascii_needs_no_python_worker(spark):
    points = [p for p in range(0x20, 0x30000) if not 0xD800 <= p < 0xE000]
    texts = ["".join(map(chr, points[i : i + 40])) for i in range(0, len(points), 40)] + ["a\0ﬁb", "", "plain", "Café 日本", "aﬁ"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", text._fold_ascii(F.col("t")).alias("f"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        assert r["f"] == (None if r["t"] is None else unicodedata.normalize("NFKD", r["t"]).encode("ascii", "ignore").decode("ascii"))


def test_table_analysis_is_one_aggregate(spark):
    rng = random.Random(3)
    words = ("Condition", "Major farming situation", "Normal crop / cropping system", "Change in crop / cropping system", "Agronomic measures", "vegetative", "Flowering stage", "Terminal drought", "", None, "Delay by 2 weeks", "variety", "maize " * 30, "• x")
    cells = [(d, 0, t, r, c, rng.choice(words)) for d in range(60) for t in range(2) for r in range(rng.randint(1, 8)) for c in range(rng.randint(1, 6))]
    cells += [(99, 0, 0, None, 1, "x"), (99, 0, 0, 2, None, "Agronomic measures"), (99, 0, 0, 1, 4, "Change in crop"), cells[0], cells[1]]
    df = spark.createDataFrame(cells, "doc_id long, page int, table int, row int, col int, text string")
    whole = extract.analyzed(extract.table_rows(df)).where("analysis is not null").select(*extract.TABLE, "analysis.*")
    found = extract.analyze_tables(df)
    assert plan(found).count("Aggregate") == 1
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect()))
    assert found.count() > 10 and found.dtypes == whole.dtypes


def test_plan_cells_come_from_one_scan(spark, tmp_path):
    spark.createDataFrame([(1, "a\nb"), (2, None), (None, "c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    cells = extract_queries.plan_cells(spark, str(tmp_path))
    assert "Union" not in plan(cells)
    rows = cells.groupBy("doc_id", "page", "row").count().collect()
    assert sorted((str(r["doc_id"]), r["page"], r["row"], r["count"]) for r in rows) == [("1", 0, 0, 6), ("1", 0, 1, 6), ("1", 0, 2, 6), ("2", 0, 0, 6), ("None", 0, 0, 6), ("None", 0, 1, 6)]


@pytest.mark.parametrize("key", ["pf25_guardrail_phrases", "ad7_action_records"])
def test_lists_are_made_once_whatever_is_asked_of_them(spark, sf, key):
    assert plan(QUERIES[key](spark, sf)).count("array_intersect(") == 1


def test_plans_meet_records_before_contexts_multiply_them(spark, sf):
    shown = plan(record_queries.told_rows(spark, sf))
    assert shown.index("Generate inline") < shown.index("Join LeftOuter")
    assert "RepartitionByExpression [state" in plan(advisory.district_plans(record_queries.plan_rows(spark, sf)))


def test_settled_records_are_the_records_of_settled_lists(spark):
    rng = random.Random(7)
    words = ("use", "water", "judiciously", "conserve", "delay", "fertilizer", "short-duration", "crop", "re-sowing", "if", "plant", "stand", "x", "mulch", "drains", "seed")
    lists = [[None if rng.random() < 0.05 else " ".join(rng.choices(words, k=rng.randint(0, 5))) for _ in range(rng.randint(0, 12))] for _ in range(150)]
    df = spark.createDataFrame([(i, k, t) for i, ts in enumerate(lists) for k, t in enumerate(ts)], "i int, k int, text string")
    known = advisory.annotate(df).withColumn("text_hi", F.upper("text"))
    item = F.struct("k", "text", "text_hi", "concept", "bag", "action_id")
    held = known.groupBy("i").agg(F.sort_array(F.collect_list(item)).alias("items"))
    for r in held.select("items", advisory.settled_records(F.col("items")).alias("a"), advisory.action_records(advisory.settled_list(F.col("items"))).alias("b")).collect():
        assert r["a"] == r["b"]
        assert {a["text_en"] for a in r["a"]} <= {x["text"] for x in r["items"] if x["text"] is not None}


def test_texts_of_a_harvest_are_squeezed_once(spark):
    words = ("Condition", "Change in crop / cropping system", "Agronomic measures", "Terminal drought", "• Sow early  1. Mulch ii) Weed", "as above", "NA")
    cells = spark.createDataFrame([(1, 0, 0, r, c, words[(r * 3 + c) % 7 if r else c]) for r in range(6) for c in range(3)], "doc_id long, page int, table int, row int, col int, text string")
    found = extract.harvest(cells)
    assert "regexp_replace" not in plan(found) and found.count() > 2


def test_header_scan_joins_labels_once(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, 0, "x")], "doc_id long, page int, table int, row int, col int, text string")
    assert plan(extract.analyzed(extract.table_rows(cells))).count("array_join(") < 6


def test_squeezing_and_cutting_by_plain_patterns(spark):
    rng = random.Random(11)
    signs = [" ", "  ", "\t", "\n", "\r", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u3000", "\x7f", "a", "Zb", "é", "日", "😀", "•", "·", "⁃", "1.", "ii)", "v. ", "iv.A", "12) b", "."]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    plain = F.trim(F.regexp_replace(F.coalesce("t", F.lit("")), text.WHITESPACE, " "))
    both = df.select("t", text.squeeze(F.col("t")).alias("a"), plain.alias("b")).select("*", extract._pieces(F.col("b")).alias("c"), F.split("b", extract.BREAK).alias("d"))
    for r in both.collect():
        assert r["a"] == r["b"] and r["c"] == r["d"], r
    label = df.select(extract.is_header_label(F.concat(F.lit(" Crop\t management"), "t")).alias("x"), extract.is_label(text.squeeze_lower(F.concat(F.lit(" Crop\t management"), "t"))).alias("y"))
    assert all(r["x"] == r["y"] for r in label.collect())
