"""Archives and shards against plain Python on small tables."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skyfold.llm import sharding, warc
from skyfold.llm.common import table


def brute_warc(rows, min_bytes=0):
    groups = defaultdict(list)
    for page, html in rows:
        groups[(html or "").encode()].append(page)
    out = []
    for page, html in rows:
        data = (html or "").encode()
        ids = [p for p in groups[data] if p is not None]
        first = min(ids, default=None)
        again = len(data) >= min_bytes and page != first
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


PAGES = [
    (5, "<p>a</p>"), (3, "<p>a</p>"), (9, "<p>a</p>"), (1, ""), (2, None), (4, "ends\r\n"), (6, "ends\r\n\r\n"), (7, "\r\n\r\n\r\n"),
    (8, "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"), (10, "é日😀" * 300_000), (11, "x" * 70_000), (12, "\r\r\n\r\r\n\n"),
    (None, "null id"), (None, "<p>a</p>"), (13, "\n"), (14, "y" * warc.CHUNK_BYTES), (15, "z" * warc.SEGMENT_CHARS), (16, "\r"),
]


def pages_of(spark, rows):
    return spark.createDataFrame([(p, f"http://x/{p}\n", h) for p, h in rows], "page_id long, url string, html string").repartition(3)


@pytest.mark.parametrize("min_bytes", [0, 8])
def test_warc_round_trip(spark, min_bytes):
    got = warc.archive_and_read(pages_of(spark, PAGES), min_bytes)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_warc(PAGES, min_bytes)


def test_warc_random_breaks(spark):
    rng = random.Random(1)
    rows = [(k, "".join(rng.choice(["\r", "\n", "\r\n", "\r\n\r\n", "a", "WARC/1.1"]) for _ in range(rng.randint(0, 12)))) for k in range(300)]
    got = warc.archive_and_read(pages_of(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_warc(rows)


def test_warc_chunks_give_the_payloads(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(pages_of(spark, PAGES).withColumn("payload", F.lit(1)).withColumn("record_type", F.lit("own")), path)
    for file in (tmp_path / "w").glob("*.gz"):
        assert gzip.open(file).read(8) in (b"WARC/1.1", b"")
    chunks = defaultdict(list)
    for r in warc.read_chunks(spark, path).collect():
        if r["record_type"] == "response" and r["page_id"] is not None:
            chunks[r["page_id"]].append(r)
    html = dict((p, h) for p, h in PAGES if p is not None)
    for page, rows in chunks.items():
        rows.sort(key=lambda r: r["chunk_no"])
        assert [r["chunk_no"] for r in rows] == list(range(len(rows)))
        assert all(len(r["payload"]) <= warc.CHUNK_BYTES for r in rows)
        so_far = b""
        for r in rows:
            so_far += r["payload"]
            assert r["payload_bytes"] == len(so_far)
            assert r["payload_digest"] == base64.b32encode(hashlib.sha1(so_far).digest()).decode()
        assert so_far == (html[page] or "").encode() and rows[-1]["is_last"] and not any(r["is_last"] for r in rows[:-1])


def test_warc_last_record_of_a_file(spark):
    ends = ["x\r\n", "\r\n", "x\r\n\r\n", "\r\n\r\n", "x\r\n\r\n\r\n", "x\r\n\r", "x\r", "x\n", "x", ""]
    for k, end in enumerate(ends):
        rows = [(k, end)]
        assert [tuple(r) for r in warc.archive_and_read(pages_of(spark, rows).coalesce(1)).collect()] == brute_warc(rows), repr(end)


def test_warc_empty_table(spark):
    assert warc.archive_and_read(pages_of(spark, PAGES).limit(0)).count() == 0


def test_hilbert_index_walks_the_grid(spark):
    bits = 3
    cells = spark.range(512).select(*(F.expr(f"cast((id >> {3 * k}) & 7 as int)").alias(c) for k, c in enumerate("xyz")))
    got = cells.select("x", "y", "z", sharding.hilbert_index([F.col("x"), F.col("y"), F.col("z")], bits).alias("h")).orderBy("h").collect()
    assert [r["h"] for r in got] == list(range(512))
    for a, b in zip(got, got[1:], strict=False):
        assert abs(a["x"] - b["x"]) + abs(a["y"] - b["y"]) + abs(a["z"] - b["z"]) == 1


@pytest.mark.parametrize("rows", [0, 1, 15, 16, 37])
def test_shards_rows_law(docs_of, rows):
    texts = [(k if k % 11 else None, None if k % 7 == 0 else "same" if k % 3 else f"text {k} é") for k in range(rows)]
    check_shards(docs_of(texts) if texts else docs_of(["x"]).limit(0))


def test_shards_of_the_table(spark, sf):
    docs = table(spark, sf, "documents")
    got = check_shards(docs)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    by_text = defaultdict(list)
    start = [0]
    for s in range(16):
        start.append(start[-1] + sum(r["shard"] == s for r in got))
    for r in got:
        by_text[text[r["doc_id"]]].append(start[r["shard"]] + r["slot"])
    assert all(max(x) - min(x) == len(x) - 1 for x in by_text.values())  # equal texts stand together


def test_shards_are_narrow_in_language_and_source(spark):
    rng = random.Random(8)
    langs = ["en"] * 8 + ["es"] * 6 + ["de"] * 4 + ["fr"] * 2
    rows = [(k, "w" * rng.randint(50, 60), rng.choice(langs), f"https://www.src{rng.randint(0, 19)}.org/") for k in range(4_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    # a text of its own for each row
    docs = docs.withColumn("text", F.concat("text", F.lpad(F.col("doc_id").cast("string"), 6, "0")))
    held = defaultdict(lambda: (set(), set()))
    for r in sharding.assign(docs).collect():
        _, _, lang, source = rows[r["doc_id"]]
        held[r["shard"]][0].add(lang)
        held[r["shard"]][1].add(source)
    assert sum(len(x) for x, _ in held.values()) <= 16 * 2
    assert sum(len(x) for _, x in held.values()) <= 16 * 10


def test_placement_equals_a_plain_version(spark):
    """Shard and slot of every row, from ranks, size steps and a sort in plain Python."""
    import math

    import xxhash

    rng = random.Random(9)
    texts = ["", None, "é" * 40, *("w" * rng.choice([1, 9, 70, 4000]) + str(rng.randint(0, 80)) for _ in range(200))]
    rows = [(k, rng.choice(texts), rng.choice(["en", "de", None, ""]), rng.choice([f"s{n}" for n in range(9)])) for k in range(500)]
    first, own_hash = {}, {}
    for k, t, lang, source in rows:
        key = t or ""
        first[key] = min(first.get(key, (k, lang or "", source)), (k, lang or "", source))
        h = xxhash.xxh64_intdigest(key.encode(), 42)
        own_hash[key] = h - (1 << 64) if h >> 63 else h
    placed = [(k, t or "", first[t or ""][1], first[t or ""][2]) for k, t, _, _ in rows]
    cells = []
    for at in (2, 3):
        held, before, cell = defaultdict(int), 0, {}
        for r in placed:
            held[r[at]] += 1
        for value in sorted(held):
            cell[value] = ((2 * before + held[value]) << sharding.BITS) // (2 * len(rows))
            before += held[value]
        cells.append(cell)
    points = []
    for k, t, lang, source in placed:
        step = max(0, min((1 << sharding.BITS) - 1, math.floor(4 * math.log2(len(t.encode()) + 1)) - 8))
        points.append((k, own_hash[t], cells[0][lang], cells[1][source], step))
    table_ = spark.createDataFrame(points, "doc_id long, h long, x int, y int, z int")
    curve = {r["doc_id"]: r["c"] for r in table_.select("doc_id", sharding.hilbert_index([F.col("x"), F.col("y"), F.col("z")]).alias("c")).collect()}
    order = sorted((curve[k], h, k) for k, h, *_ in points)
    small, extra = divmod(len(rows), 16)
    expected = {}
    for rank, (_, _, k) in enumerate(order):
        shard = rank // (small + 1) if rank < extra * (small + 1) else extra + (rank - extra * (small + 1)) // small
        expected[k] = (shard, rank - (shard * small + min(shard, extra)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.assign(docs).collect()} == expected


@pytest.mark.parametrize("columns", [("lang",), ("source",), ("lang", "source")])
def test_shards_without_metadata(docs_of, columns):
    docs = docs_of([f"text {k}" for k in range(40)])
    assert len(check_shards(docs.drop(*columns))) == 40
    for c in columns:
        docs = docs.withColumn(c, F.lit(None).cast("string"))
    assert len(check_shards(docs)) == 40


def check_shards(docs):
    got = sharding.assign(docs.withColumn("curve", F.lit("own")).withColumn("size", F.lit(0))).collect()
    source = docs.collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["doc_id"] is not None) == sorted(
        (r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in source if r["doc_id"] is not None
    )
    assert len(got) == len(source)
    slots = defaultdict(list)
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[s]) for s in range(16)]
    assert max(counts) - min(counts) <= 1 and set(slots) <= set(range(16))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return got
