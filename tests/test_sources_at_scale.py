"""Large JSON files over many tasks, versions by several writers, refreshed records and image files."""

import json
import random
import struct
import threading
import zlib

import pytest
from pyspark.sql import functions as F

from skyfold import schemas
from skyfold.operators import records
from skyfold.sources import big_json, documents, sinks, versions
from skyfold.sources import records as src
from skyfold.streaming import refresh

HARD = ['a"b', "}{", "[{]}", "\\", '\\"}', "é日😀", "", "\n\t", "x" * 300, '{"a":"}"}', "\\\\", 'end\\']


def nested(rng, depth=0):
    kind = rng.randint(0, 5 if depth < 4 else 2)
    if kind <= 2:
        return rng.choice([*HARD, 1, None, True, 2.5])
    if kind == 3:
        return [nested(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {rng.choice([*HARD, "k"]) + str(i): nested(rng, depth + 1) for i in range(rng.randint(0, 4))}


@pytest.fixture
def tiny_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], "200")
    spark.conf.set(names[1], "0")
    yield
    for n, x in before.items():
        spark.conf.set(n, x) if x is not None else spark.conf.unset(n)


@pytest.mark.parametrize("indent", [None, 1])
def test_array_objects_of_split_files(spark, tmp_path, tiny_splits, indent):
    rng = random.Random(3)
    expected = []
    for name in ("a", "b"):
        items = [nested(rng) if k % 5 == 4 else {"n": k, "v": nested(rng)} for k in range(60)]
        items.append({"n": "long", "v": "} {" * 400})
        expected += [x for x in items if isinstance(x, dict)]
        (tmp_path / f"{name}.json").write_text(json.dumps(items, indent=indent, ensure_ascii=name == "a"))
    for name, text in (("empty", ""), ("none", "[]"), ("object", '{"a": {"b": 1}}')):
        (tmp_path / f"{name}.json").write_text(text)
    got = [json.loads(r["value"]) for r in big_json.array_objects(spark, str(tmp_path)).collect()]
    key = lambda x: json.dumps(x, sort_keys=True)
    assert sorted(map(key, got)) == sorted(map(key, expected))
    assert big_json.array_objects(spark, str(tmp_path)).rdd.getNumPartitions() > 8


def test_features_of_split_files(spark, tmp_path, tiny_splits):
    ring = [[0.5, 1], [2, 1], [2, 3], [0.5, 1]]
    out = [{"type": "Feature", "properties": {"NAME_1": "S", "NAME_2": f"d{k}"}, "geometry": {"type": "Polygon", "coordinates": [ring] * (1 + k % 2)}} for k in range(50)]
    text = json.dumps({"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "a"}}, "bbox": [0, 1, 2, 3], "features": out, "more": [1]})
    (tmp_path / "f.json").write_text(text)
    got = src.read_polygons(spark, str(tmp_path)).collect()
    assert sorted((r["district"], len(r["ring"]), len(r["holes"])) for r in got) == sorted((f"d{k}", 3, k % 2) for k in range(50))


def test_arrays_written_are_read(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{k}", f"d{k}", k) for k in range(20)], "state string, district string, rainfall_since_june_1_pct_departure int").repartition(3)
    sinks.write_array(rows.unionByName(rows.limit(0)), str(tmp_path / "out"))
    got = src.read_records(spark, str(tmp_path / "out"))
    assert sorted((r["state"], r["rainfall_since_june_1_pct_departure"]) for r in got.collect()) == sorted((f"s{k}", k) for k in range(20))
    for path in (tmp_path / "out").glob("part-*"):
        assert isinstance(json.loads(path.read_text()), list)


def test_versions_of_writers_at_once(spark, tmp_path):
    base = str(tmp_path / "table")
    row = spark.createDataFrame([("S", "D", 1)], "state string, district string, n int")
    taken = []

    def write(k):
        taken.append(versions.publish(row.withColumn("n", F.lit(k)), base))

    for _ in range(3):
        writers = [threading.Thread(target=write, args=(k,)) for k in range(4)]
        for w in writers:
            w.start()
        for w in writers:
            w.join()
    assert sorted(taken) == list(range(1, 13)) and versions.latest(spark, base) == 12
    assert versions.read_records(spark, base, 10).count() == 1
    n = versions.publish(row.withColumn("n", F.lit(99)), base, whole=False, tag="t")
    assert n == versions.publish(row, base, tag="t") == 13
    assert [r["n"] for r in versions.read_records(spark, base).collect()] == [99]
    assert versions.latest(spark, str(tmp_path / "none")) is None
    with pytest.raises(FileNotFoundError):
        versions.read_records(spark, str(tmp_path / "none"))


def test_refresh_writes_touched_districts_only(spark, tmp_path):
    base, target = str(tmp_path / "records"), str(tmp_path / "sums")
    cells = spark.createDataFrame([("S", "a", 1.0, 1.0), ("S", "a", 1.0, 2.0), ("S", "b", 5.0, 5.0), ("T", "new", 7.0, 7.0)], "state string, district string, lat double, lon double")
    seeded = spark.createDataFrame([("s", "A"), ("S", "b")], "state string, district string").select("state", "district", *(F.lit(x).alias(k) for k, x in records.DEFAULTS.items()))
    signals = [F.lit(None).cast("double").alias(f"week{w}_{x}") for w in records.WEEKS for x in ("rainfall_anomaly_mm_day", "tmax_anomaly_degC")]
    versions.publish(seeded.select("*", *signals), base)

    def model_rows(sums):
        means = sums.groupBy("model", "lat", "lon", "week").agg((F.sum("precip_sum") / F.sum("precip_n")).alias("precip"), (F.sum("t2m_sum") / F.sum("t2m_n")).alias("t2m"))
        per = means.join(cells, ["lat", "lon"]).groupBy("state", "district", "week").agg(F.avg("precip").alias("precip"), F.avg("t2m").alias("t2m"))
        return per.select("state", "district", "week", F.lit("MME").alias("model"), "precip", "t2m", F.lit("20240101").alias("init_date"))

    def land(rows):
        batch = spark.createDataFrame([("m", "2024-01-01", "members", "1", h, y, x, t, p) for h, y, x, t, p in rows], "model string, init_date string, kind string, member string, lead_hours int, lat double, lon double, t2m double, precip double")
        batch.withColumn("init_date", F.to_date("init_date")).write.mode("append").parquet(str(tmp_path / "landing"))
        refresh.ingest_and_refresh(spark, str(tmp_path / "landing"), schemas.GRID_LEAD, target, str(tmp_path / "marks"), base, cells, model_rows).awaitTermination()

    def rain():
        return {(r["state"].lower(), r["district"].lower()): r["week1_rainfall_anomaly_mm_day"] for r in versions.read_records(spark, base).collect()}

    land([(6, 1.0, 1.0, 0.0, 4.0), (6, 1.0, 2.0, 0.0, 6.0)])
    assert rain() == {("s", "a"): 5.0, ("s", "b"): None}
    land([(12, 1.0, 1.0, 0.0, 8.0), (6, 7.0, 7.0, 0.0, -3.0)])
    assert rain() == {("s", "a"): 6.0, ("s", "b"): None, ("t", "new"): -3.0}
    own = spark.read.parquet(versions.version_path(spark, base, 3))
    assert sorted(r["district"].lower() for r in own.collect()) == ["a", "new"]


def png(rows, channels, filters):
    """A PNG of 8-bit rows; ``filters`` gives each row's filter number (0 to 2)."""
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    above, out = bytes(len(rows[0])), b""
    for number, row in zip(filters, rows, strict=True):
        left = bytes(channels) + row[:-channels]
        out += bytes([number]) + bytes((a - (0, b, c)[number]) % 256 for a, b, c in zip(row, left, above, strict=True))
        above = row
    head = struct.pack(">IIBBBBB", len(rows[0]) // channels, len(rows), 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def test_image_files(spark, tmp_path):
    rng = random.Random(4)
    expected = {}
    for name, width, height, channels in (("a.png", 7, 5, 3), ("b.png", 1, 9, 3), ("c.png", 4, 1, 4)):
        rows = [bytes(rng.randrange(256) for _ in range(width * channels - 1)) + b"\xff" for _ in range(height)]
        (tmp_path / name).write_bytes(png(rows, channels, [rng.randrange(3) for _ in rows]))
        for y, row in enumerate(rows):
            for x in range(width):
                expected[name, x, y] = tuple(row[x * channels : x * channels + 3])
    (tmp_path / "broken.png").write_bytes(b"not an image")
    got = {(r["image_id"].rsplit("/", 1)[1], r["x"], r["y"]): (r["r"], r["g"], r["b"]) for r in documents.pixels_of(documents.read_images(spark, str(tmp_path))).collect()}
    assert got == expected
