"""Scan, sink, discovery and label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyfold import schemas
from skyfold.functions import dates, geo, labels, signals, text
from skyfold.operators import grid, matching, ordered, providers, quality, records
from skyfold.plans import views as v
from skyfold.plans.grid_queries import r
from skyfold.plans.record_queries import odds_rows, s2s, s2s_of, s2s_places, signed_sql, sql_text
from skyfold.plans.registry import VIEW_SQL, query
from skyfold.plans.scratch import scratch
from skyfold.sources import documents, grids, sinks, versions
from skyfold.sources import records as src
from skyfold.streaming import ingest, refresh


def s(c):
    return F.col(c).cast("string")


# --- scans -----------------------------------------------------------------

@query("sc1_district_points", """SELECT cell, CASE WHEN cell % 7 = 0 THEN NULL ELSE lat END AS lat, lon FROM v_cells""")
def sc1(spark, sf):
    raw = v.cells(spark, sf).select(
        "cell", "state", "district", F.when(F.col("cell") % 7 == 0, "n/a").otherwise(s("lat")).alias("latitude"), s("lon").alias("longitude"),
        s("cell").alias("region"),
    )
    return src.typed_points(raw).select(F.col("region").cast("long").alias("cell"), "lat", "lon")


@query("sc2_roster", "SELECT DISTINCT r_name AS state, n_name AS district FROM nation JOIN region ON n_regionkey = r_regionkey")
def sc2(spark, sf):
    path = scratch(spark, "roster")
    v.polygons(spark, sf).select("state", "district").write.option("header", True).csv(path)
    return src.read_roster(spark, path).distinct()


@query("sc3_record_json", "SELECT state, district, since_jun1 AS since_june, heat_wave, wk1, t1 FROM v_record")
def sc3(spark, sf):
    path = scratch(spark, "records")
    sinks.write_array(v.records(spark, sf), path)
    return src.read_records(spark, path).select(
        "state", "district", F.col("rainfall_since_june_1_pct_departure").alias("since_june"), F.col("heat_wave_warning").alias("heat_wave"),
        F.col("week1_rainfall_anomaly_mm_day").alias("wk1"), F.col("week1_tmax_anomaly_degC").alias("t1"),
    )


def contingency_text(spark, sf):
    """One JSON text per district; items alternate between plain text and objects."""
    o = v.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    item = F.when(k % 2 == 0, F.to_json(F.struct(F.concat(F.lit("act "), s("o_orderkey")).alias("action"), F.lit("Rice - early").alias("crop"))))
    item = item.otherwise(F.concat(F.lit('"act '), s("o_orderkey"), F.lit('"')))
    per = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", item.alias("i")))), lambda x: x["i"]), ",").alias("items"))
    body = F.concat(
        F.lit('{"state":"S","district":"'), s("o_custkey"), F.lit('","scenarios":{"delayed_monsoon":{"crop_actions":['), F.col("items"),
        F.lit('],"livestock_actions":[]}}}'),
    )
    return per.select(body.alias("value"))


@query("sc4_contingency_json", """SELECT CAST(o_custkey AS VARCHAR) AS district, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos,
   'act ' || o_orderkey AS action, CASE WHEN o_orderkey % 2 = 0 THEN 'Rice - early' ELSE '' END AS crop FROM orders""")
def sc4(spark, sf):
    path = scratch(spark, "plans")
    sinks.framed(contingency_text(spark, sf), path, "[", "]")
    return src.plan_actions(src.read_contingency(spark, path)).select("district", "pos", "action", "crop")


@query("jn25_flat_plans", """SELECT CAST(o_custkey AS VARCHAR) AS district, CASE WHEN o_custkey % 2 = 0 THEN 'flat' ELSE 'livestock' END AS kind,
   row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, 'act ' || o_orderkey AS action FROM orders""")
def jn25_flat(spark, sf):
    path = scratch(spark, "flat-plans")
    o = v.table(spark, sf, "orders")
    items = F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda k: F.concat(F.lit("act "), k.cast("string")))
    lists = o.groupBy("o_custkey").agg(items.alias("items"))
    name = F.when(F.col("o_custkey") % 2 == 0, schemas.FLAT_PLAN).otherwise("livestock_actions")
    body = F.create_map(F.lit("heat_stress"), F.create_map(name, F.col("items")))
    plans = lists.select(F.to_json(F.struct(F.lit("S").alias("state"), s("o_custkey").alias("district"), body.alias("scenarios"))).alias("value"))
    sinks.framed(plans, path, "[", "]")
    return src.plan_actions(src.read_contingency(spark, path)).select("district", "kind", "pos", "action")


def admin_text(spark, sf):
    """Hand-kept form of the records: all text, some cells not numbers."""
    rec = v.records(spark, sf)
    bad = F.col("k") % 10 == 3
    cols = [c.split(" ")[0] for c in schemas.ADMIN_CSV.split(", ")]
    out = rec.select("k", *[s(c.strip()).alias(c.strip()) for c in cols])
    return out.withColumn("rainfall_last_14_days_pct_departure", F.when(bad, "NEEDS_VERIFICATION").otherwise(F.col("rainfall_last_14_days_pct_departure"))).withColumn(
        "heat_wave_warning", F.when(F.col("k") % 2 == 0, F.upper("heat_wave_warning")).otherwise(F.col("heat_wave_warning"))
    )


@query("sc5_admin_csv", "SELECT state, district, since_jun1 AS since_june, CASE WHEN k % 10 = 3 THEN 0 ELSE r14 END AS r14, heat_wave, heavy_rain FROM v_record")
def sc5(spark, sf):
    path = scratch(spark, "admin")
    admin_text(spark, sf).drop("k").write.option("header", True).csv(path)
    return src.read_admin(spark, path).select(
        "state", "district", F.col("rainfall_since_june_1_pct_departure").alias("since_june"), F.col("rainfall_last_14_days_pct_departure").alias("r14"),
        F.col("heat_wave_warning").alias("heat_wave"), F.col("heavy_rain_warning").alias("heavy_rain"),
    )


@query("sc6_weekly_csv", "SELECT state, district, week, model, precip, t2m FROM v_s2s")
def sc6(spark, sf):
    raw = s2s(spark, sf).select(
        "state", "district", s("week").alias("week"), F.when(F.col("model") == "MME", "").otherwise(F.col("model")).alias("model"),
        s("precip").alias("precip_anom_mm_day"), s("t2m").alias("t2m_anom_degC"), "init_date",
    )
    return src.typed_weekly(raw).select("state", "district", "week", "model", "precip", "t2m")


VIEW_SQL["v_acct"] = "SELECT c_custkey AS k, c_name AS district, c_acctbal / 20.0::DOUBLE AS x FROM customer"


@query("sc8_observed_csv", """SELECT district, CAST(greatest(-100, least(300, round_even(coalesce(CASE WHEN k % 13 <> 0 THEN x END, 0), 0))) AS BIGINT) AS dep,
   CASE WHEN k % 2 = 0 THEN 'active' ELSE 'normal' END AS onset FROM v_acct""")
def sc8(spark, sf):
    c = v.table(spark, sf, "customer")
    k = F.col("c_custkey")
    dep = F.when(k % 13 != 0, (F.col("c_acctbal") / 20.0).cast("string")).otherwise("")
    raw = c.select(
        F.lit("S").alias("state"), F.col("c_name").alias("district"), *[dep.alias(x) for x in records.OBSERVED_FIELDS[:3]],
        F.when(k % 2 == 0, "active").otherwise("").alias("monsoon_onset_status"), F.lit("2024-07-01").alias("obs_asof"),
    )
    return src.typed_observed(raw).select("district", F.col("rainfall_since_june_1_pct_departure").alias("dep"), F.col("monsoon_onset_status").alias("onset"))


@query("sc9_seasonal_csv", """SELECT l_orderkey AS k, l_linenumber AS lead, l_tax AS p_above, l_discount AS p_below FROM lineitem
   WHERE l_returnflag <> 'R' AND l_linenumber <> 4""")
def sc9(spark, sf):
    li = v.table(spark, sf, "lineitem")
    raw = li.select(
        s("l_orderkey").alias("state"), F.lit("d").alias("district"), F.when(F.col("l_returnflag") != "R", "p").otherwise("t").alias("variable"),
        F.lit("m").alias("model"), F.when(F.col("l_linenumber") != 4, s("l_linenumber")).otherwise("x").alias("lead"),
        s("l_tax").alias("p_above"), s("l_discount").alias("p_below"),
    )
    path = scratch(spark, "seasonal")
    names = [c.strip().split(" ")[0] for c in schemas.SEASONAL_CSV.split(",")]
    raw.select(*(F.col(c) if c in raw.columns else F.lit("").alias(c) for c in names)).write.option("header", True).csv(path)
    return src.read_seasonal(spark, path).select(F.col("state").cast("long").alias("k"), "lead", "p_above", "p_below")


VIEW_SQL["v_files"] = """SELECT DISTINCT event_type AS model, lower(event_type) || '_' || strftime(ts, '%Y%m%d') || '_india_weekly.nc' AS name, strftime(ts, '%Y%m%d') AS init
  FROM events WHERE NOT (event_type = 'click' AND ts >= TIMESTAMP '2024-01-20')"""


def listing(spark, sf):
    e = v.table(spark, sf, "events").where(~((F.col("event_type") == "click") & (F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz"))))
    stem = F.concat(F.lower("event_type"), F.lit("_"), F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd"), F.lit("_india_weekly"))
    return e.select(F.col("event_type").alias("model"), stem.alias("stem")).distinct().select("model", F.concat("stem", F.lit(".nc")).alias("name"), "stem")


@query("sc11_discover_models", """SELECT model, max(name) FILTER (init = (SELECT max(init) FROM v_files)) AS file, max(init) AS newest,
   CASE WHEN max(init) = (SELECT max(init) FROM v_files) THEN 'ok' ELSE 'missing' END AS status FROM v_files GROUP BY model""")
def sc11(spark, sf):
    return grids.discover_models(listing(spark, sf))


@query("sc11_explicit_files", """SELECT model, name AS file, init, (SELECT count(DISTINCT init) > 1 FROM (SELECT min(init) AS init FROM v_files WHERE model IN ('view', 'purchase') GROUP BY model
     UNION ALL SELECT max(init) FROM v_files WHERE model = 'purchase')) AS mixed FROM v_files f
   WHERE (model = 'view' AND init = (SELECT min(init) FROM v_files WHERE model = 'view')) OR (model = 'purchase' AND init = (SELECT max(init) FROM v_files WHERE model = 'purchase'))""")
def sc11_explicit(spark, sf):
    files = listing(spark, sf)
    ends = {r["model"]: r for r in files.groupBy("model").agg(F.min("name").alias("first"), F.max("name").alias("last")).where("model in ('view', 'purchase')").collect()}
    chosen, mixed = grids.explicit_models({"view": ends["view"]["first"], "purchase": ends["purchase"]["last"]}, files)
    inits = chosen.agg(mixed.alias("mixed"))
    return chosen.select("model", F.col("name").alias("file"), "init").withColumn("mixed", inits.scalar())


@query("sc12_member_files", "SELECT model, replace(name, '.nc', '_members.nc') AS name FROM v_files WHERE init = '20240115'")
def sc12(spark, sf):
    files = listing(spark, sf).select("model", F.concat("stem", F.lit("_members.nc")).alias("name"))
    return grids.member_files(files, "20240115").select("model", "name")


@query("sc13_latest_cycle", """SELECT max(strftime(o_orderdate, '%Y%m')) AS cycle, (SELECT max(n) FROM (SELECT 'clim_init' || strftime(o_orderdate, '%m') || '_' || strftime(o_orderdate, '%Y') AS n FROM orders)
   WHERE contains(n, 'init06')) AS clim FROM orders""")
def sc13(spark, sf):
    o = v.table(spark, sf, "orders")
    d = F.col("o_orderdate").cast("timestamp")
    names = o.select(F.when(F.col("o_orderkey") % 2 == 0, F.date_format(d, "yyyyMM")).otherwise(F.concat(F.date_format(d, "yyyyMM"), F.lit("x"))).alias("name"))
    both = names.unionByName(o.select(F.date_format(d, "yyyyMM").alias("name")))
    clim = o.select(F.concat(F.lit("clim_init"), F.date_format(d, "MM"), F.lit("_"), F.date_format(d, "yyyy")).alias("name"))
    cycle = grids.latest_cycle(both)
    return cycle.withColumn("clim", grids.pick_climatology(clim, "06").scalar())


@query("sc14_polygon_features", """SELECT r_name AS state, n_name AS district, 1 + (n_nationkey % 3 = 0)::INT AS n_features, 5 + 3 * (n_nationkey % 3 = 0)::INT AS n_points,
   4 * (n_nationkey % 2 = 0)::INT AS hole_points, round(66.013::DOUBLE + (n_nationkey % 5) * 6.4::DOUBLE, 6) AS west FROM nation JOIN region ON n_regionkey = r_regionkey""")
def sc14(spark, sf):
    path = scratch(spark, "features")
    sinks.write_collection(v.parted_polygons(spark, sf), path, {"NAME_1": "state", "NAME_2": "district"})
    p = src.read_polygons(spark, path).select(
        "state", "district", F.size("ring").alias("n"), F.aggregate("holes", F.lit(0), lambda a, x: a + F.size(x)).alias("h"), F.array_min(F.transform("ring", lambda x: x["lon"])).alias("w")
    )
    return p.groupBy("state", "district").agg(
        F.count("*").alias("n_features"), F.sum("n").alias("n_points"), F.sum("h").alias("hole_points"), F.round(F.min("w"), 6).alias("west")
    )


@query("sc15_image_pixels", """SELECT doc_id, count(*) AS n, sum(('0x' || h[i * 6 + 5:i * 6 + 6])::INT)::BIGINT AS r, sum(('0x' || h[i * 6 + 1:i * 6 + 2])::INT)::BIGINT AS b
   FROM (SELECT doc_id, h, unnest(range(len(h) // 6)) AS i FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents)) GROUP BY doc_id""")
def sc15(spark, sf):
    images = v.table(spark, sf, "documents").select(
        F.col("doc_id").alias("image_id"), F.floor(F.octet_length("text") / 3).cast("int").alias("width"), F.lit(1).alias("height"),
        F.lit(3).alias("channels"), F.encode("text", "UTF-8").alias("data"),
    )
    px = documents.pixels_of(images.where("width > 0"))
    return px.groupBy(F.col("image_id").alias("doc_id")).agg(F.count("*").alias("n"), F.sum("r").alias("r"), F.sum("b").alias("b"))


@query("sc16_table_cells", """SELECT doc_id, count(*) AS n_cells, max(c) AS last_col, sum(length(t))::BIGINT AS chars FROM
   (SELECT doc_id, unnest(range(len(w))) AS c, unnest(w) AS t FROM (SELECT doc_id, string_split(line, ' ') AS w FROM v_lines)) GROUP BY doc_id""")
def sc16(spark, sf):
    t = v.table(spark, sf, "documents").select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.split(x, " ")).alias("rows"))
    return documents.cells_of(t, ["doc_id"], "rows").groupBy("doc_id").agg(
        F.count("*").alias("n_cells"), F.max("col").alias("last_col"), F.sum(F.length("text")).alias("chars")
    )


@query("sc17_page_links", "SELECT page_id, pos, href, text FROM v_links WHERE text <> ''")
def sc17(spark, sf):
    return documents.page_links(v.table(spark, sf, "pages"), ["page_id"], "html", suffix=None)


@query("sc18_bulletin_lines", "SELECT doc_id, count(*) AS n, sum(length(line))::BIGINT AS chars FROM v_lines GROUP BY doc_id")
def sc18(spark, sf):
    return documents.lines_of(v.table(spark, sf, "documents"), ["doc_id"], "text").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum(F.length("line")).alias("chars")
    )


# --- sinks -------------------------------------------------------------------

@query("sk1_csv_sink", "SELECT 'S' AS state, district, week, w AS p_wetter, n AS n_members FROM (SELECT kd AS district, week, w, n FROM v_odds_rows)")
def sk1(spark, sf):
    path = scratch(spark, "odds-csv")
    odds = odds_rows(spark, sf).withColumn("region", F.lit(None).cast("string")).withColumn("state", F.lit("S")).withColumn("district", text.merge_key(F.col("district")))
    sinks.write_csv(odds, path, sinks.ODDS_COLUMNS)
    return src.read_odds(spark, path).select("state", "district", "week", "p_wetter", "n_members")


@query("sk2_versioned_json", "SELECT k, onset, 2 AS version FROM v_record")
def sk2(spark, sf):
    base = scratch(spark, "versions")
    recs = v.records(spark, sf)
    versions.publish(recs.where("k % 2 = 0"), base, form="json")
    last = versions.publish(recs, base, form="json")
    path = versions.version_path(spark, base, versions.latest(spark, base))
    return spark.read.json(path).select("k", F.col("monsoon_onset_status").alias("onset"), F.lit(last).alias("version"))


@query("sk2_changed_rows", """SELECT state, district, CASE WHEN k % 3 = 0 THEN 12 WHEN k % 2 = 0 THEN 11 ELSE r14 END AS r14 FROM v_record
   UNION ALL SELECT 'New', 'District', 12""")
def sk2_changed(spark, sf):
    base = scratch(spark, "changes")
    recs = v.records(spark, sf)
    names = ["k", "state", "district", "rainfall_last_14_days_pct_departure"]
    for n in range(9):
        versions.publish(recs.where(F.col("k") % 9 >= n).select(*names), base)
    versions.publish(recs.select(*names), base)
    versions.publish(recs.where("k % 2 = 0").select(*names[:3], F.lit(11).alias(names[3])), base, whole=False)
    newest = recs.where("k % 3 = 0").select(F.upper("state").alias("state"), "district", F.lit(12).alias(names[3]))
    new = recs.limit(1).select(F.lit("New").alias("state"), F.lit("District").alias("district"), F.lit(12).alias(names[3]))
    versions.publish(newest.unionByName(new), base, whole=False)
    merged = versions.read_records(spark, base)
    state = recs.select(F.upper("state").alias("u"), F.col("state").alias("known")).distinct()
    named = merged.join(state, F.col("u") == F.upper("state"), "left")
    return named.select(F.coalesce("known", "state").alias("state"), "district", F.col(names[3]).alias("r14"))


def grid_table(spark, sf):
    cells = v.cells(spark, sf).select("cell", "lat", "lon")
    return v.lead(spark, sf).join(cells, "cell").select(
        "model", "init_date", F.lit("members").alias("kind"), s("member").alias("member"), F.col("lead_hours").cast("int").alias("lead_hours"), "lat", "lon", "t2m", "precip"
    )


@query("sk3_grid_sink", "SELECT model, count(*) AS n, round(sum(precip), 4) AS precip FROM v_lead JOIN v_cells USING (cell) WHERE model IN ('click', 'view') GROUP BY model")
def sk3(spark, sf):
    path = scratch(spark, "grid")
    grids.write_grid(grid_table(spark, sf), path)
    got = grids.read_grid(spark, path, ["click", "view"], v.INIT, "members")
    return got.groupBy("model").agg(F.count("*").alias("n"), F.round(F.sum("precip"), 4).alias("precip"))


@query("sk4_master_list", """SELECT c.state, c.district, round(lat, 4) AS lat, round(lon, 4) AS lon, 'r' AS region, 1 AS listed, 5 AS n_points FROM v_centroid c""")
def sk4(spark, sf):
    from skyfold.operators import region

    base = scratch(spark, "master")
    shapes = v.polygons(spark, sf)
    points = region.centroids(shapes).select("state", "district", F.round("lat", 4).alias("latitude"), F.round("lon", 4).alias("longitude"), F.lit("r").alias("region"))
    sinks.write_master_list(points, shapes, base)
    listed = src.read_roster(spark, f"{base}/district_metadata").groupBy("state", "district").agg(F.count("*").alias("listed"))
    outlines = src.read_polygons(spark, f"{base}/districts_geojson", "state", "district").select("state", "district", F.size("ring").alias("n_points"))
    return src.read_district_points(spark, f"{base}/district_coordinates").join(listed, ["state", "district"]).join(outlines, ["state", "district"])


@query("sk5_missing_stages", """SELECT model, init_date FROM (SELECT DISTINCT event_type AS model, CAST(ts AS DATE) AS init_date FROM events)
   EXCEPT SELECT event_type, CAST(ts AS DATE) FROM events WHERE value > 200""")
def sk5(spark, sf):
    e = v.table(spark, sf, "events").select(F.col("event_type").alias("model"), F.col("ts").cast("date").alias("init_date"), F.lit("weekly").alias("kind"), "value")
    return grids.missing_partitions(e, e.where("value > 200")).select("model", "init_date")


@query("sk6_checksum_audit", """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'MISSING' WHEN doc_id % 5 = 1 THEN 'NO_CHECKSUM' WHEN doc_id % 5 = 2 THEN 'MISMATCH' ELSE 'OK' END AS status,
   sha256(text) AS digest FROM documents""")
def sk6(spark, sf):
    d = v.table(spark, sf, "documents")
    k = F.col("doc_id") % 5
    digest = F.sha2("text", 256)
    manifest = d.select("doc_id", s("doc_id").alias("filename"), F.when(k == 1, "").when(k == 2, "0").otherwise(F.upper(digest)).alias("sha256"), digest.alias("true_digest"))
    files = d.select(s("doc_id").alias("filename"), F.when(k != 0, digest).alias("digest")).where("digest is not null")
    documents.require_columns(manifest, ["filename", "sha256"])
    return documents.audit_checksums(manifest, files).select("doc_id", "status", F.col("true_digest").alias("digest"))


@query("sk6_file_digests", """SELECT bucket AS filename, CASE bucket % 3 WHEN 0 THEN 'OK' WHEN 1 THEN 'MISMATCH' ELSE 'NO_CHECKSUM' END AS status, digest FROM (
   SELECT doc_id % 20 AS bucket, sha256(string_agg(text || chr(10), '' ORDER BY doc_id)) AS digest FROM documents GROUP BY 1) UNION ALL SELECT -1, 'MISSING', NULL""")
def sk6_files(spark, sf):
    path = scratch(spark, "files")
    d = v.table(spark, sf, "documents").withColumn("bucket", F.col("doc_id") % 20)
    d.repartition(20, "bucket").sortWithinPartitions("bucket", "doc_id").select("bucket", "text").write.partitionBy("bucket").text(path)
    bucket = F.regexp_extract("path", r"bucket=(\d+)", 1)
    digests = documents.file_digests(spark, path, bucket)
    listed = digests.select("filename", F.when(F.col("filename") % 3 == 0, F.upper("digest")).when(F.col("filename") % 3 == 1, "0").otherwise("").alias("sha256"))
    manifest = listed.unionByName(d.agg(F.lit("-1").alias("filename"), F.lit("x").alias("sha256")))
    return documents.audit_checksums(manifest, digests).select(F.col("filename").cast("long").alias("filename"), "status", "digest")


@query("sm1_incremental_ingest", """SELECT model, CAST(member AS VARCHAR) AS member, lat, lon, week, round(avg(t2m) + 1e-9, 5) AS t2m, round(avg(precip) + 1e-9, 5) AS precip FROM
   (SELECT l.*, c.lat, c.lon, CAST(ceil(lead_hours / 168.0) AS BIGINT) AS week FROM v_lead l JOIN v_cells c USING (cell) WHERE lead_hours > 0 AND lead_hours <= 840) GROUP BY ALL""")
def sm1(spark, sf):
    landing, target, marks = (scratch(spark, n) for n in ("landing", "weekly", "marks"))
    rows = grid_table(spark, sf)
    rows.where("model in ('click', 'view')").write.parquet(landing)
    ingest.ingest(spark, landing, schemas.GRID_LEAD, target, marks).awaitTermination()
    rows.where("model not in ('click', 'view')").write.mode("append").parquet(landing)
    ingest.ingest(spark, landing, schemas.GRID_LEAD, target, marks).awaitTermination()
    return ingest.weekly_table(spark, target).select(
        "model", "member", "lat", "lon", "week", F.round(F.col("t2m") + 1e-9, 5).alias("t2m"), F.round(F.col("precip") + 1e-9, 5).alias("precip")
    )


@query("sm1_refreshed_records", f"""SELECT lower(trim(coalesce(r.state, s.state))) AS ks, lower(trim(coalesce(r.district, s.district))) AS kd, CASE WHEN s.ks IS NOT NULL THEN s.p1 ELSE r.wk1 END AS wk1,
   CASE WHEN s.ks IS NOT NULL THEN s.p4 ELSE r.wk4 END AS wk4, CASE WHEN s.ks IS NOT NULL THEN 'S2S multi-model mean (' || models || ') init 2024-01-01' END AS forecast_source, coalesce(r.onset, 'normal') AS onset
   FROM v_record r FULL JOIN v_s2s_wide s ON s.ks = lower(trim(r.state)) AND s.kd = lower(trim(r.district))""")
def sm1_refreshed(spark, sf):
    landing, target, marks, base = (scratch(spark, n) for n in ("landing", "weekly", "marks", "records"))
    rows = grid_table(spark, sf)
    cells = v.cells(spark, sf).select("cell", "lat", "lon")
    places = s2s_places(spark, sf)
    versions.publish(v.records(spark, sf), base)

    def model_rows(sums):
        means = sums.groupBy("model", "lat", "lon", "week").agg(*((F.sum(f"{x}_sum") / F.sum(f"{x}_n")).alias(x) for x in ("t2m", "precip")))
        return s2s_of(spark, sf, means.join(cells, ["lat", "lon"]).drop("lat", "lon"))

    def run():
        return refresh.ingest_and_refresh(spark, landing, schemas.GRID_LEAD, target, marks, base, places, model_rows).awaitTermination()

    rows.where("model in ('click', 'view')").write.parquet(landing)
    run()
    rows.where("model not in ('click', 'view')").write.mode("append").parquet(landing)
    run()
    run()  # nothing new: no batch
    # a batch that runs again after a loss finds its version and publishes none
    before, tags = versions.latest(spark, base), [versions.Log(spark, base).entry(n)["tag"] for n in versions.Log(spark, base).numbers()]
    again = refresh.refresh_districts(spark, rows.where("model not in ('click', 'view')"), target, base, places, model_rows, tags[-1])
    if not again == before == versions.latest(spark, base):
        raise AssertionError("a replayed batch published a version")
    out = records.with_keys(versions.read_records(spark, base))
    return out.select(
        F.col("_ks").alias("ks"), F.col("_kd").alias("kd"), F.col("week1_rainfall_anomaly_mm_day").alias("wk1"), F.col("week4_rainfall_anomaly_mm_day").alias("wk4"),
        "forecast_source", F.col("monsoon_onset_status").alias("onset"),
    )


# --- classes, labels, colours ----------------------------------------------------

def rec_query(key, sql, *cols):
    """Register a projection over the records."""
    query(key, sql)(lambda spark, sf: v.records(spark, sf).select("k", *[c() for c in cols]))


W1, W4 = "week1_rainfall_anomaly_mm_day", "week4_rainfall_anomaly_mm_day"
T1 = "week1_tmax_anomaly_degC"


def case(col, steps, tail, op):
    return "CASE WHEN {0} IS NULL THEN '—' ".format(col) + " ".join(f"WHEN {col} {o} {x} THEN '{lab}'" for o, x, lab in steps) + f" ELSE '{tail}' END"


rec_query("pf8_rain_signal", "SELECT k, s1 AS signal FROM v_record", lambda: signals.rain_signal(F.col(W1)).alias("signal"))
rec_query("pf9_tmax_signal", "SELECT k, CASE WHEN t1 >= 1.5 THEN 'above_normal' WHEN t1 <= -1.5 THEN 'below_normal' ELSE 'near_normal' END AS signal FROM v_record",
          lambda: signals.tmax_signal(F.col(T1)).alias("signal"))
_5 = "CASE WHEN wk1 >= 7 THEN '{0}' WHEN wk1 >= 3 THEN '{1}' WHEN wk1 <= -7 THEN '{2}' WHEN wk1 <= -3 THEN '{3}' ELSE '{4}' END"
rec_query("pf10_outlook_label", f"SELECT k, {_5.format(*signals.OUTLOOK_LABELS_EN)} AS en, {_5.format(*signals.OUTLOOK_LABELS_HI)} AS hi FROM v_record",
          lambda: signals.outlook_label(F.col(W1)).alias("en"), lambda: signals.outlook_label(F.col(W1), signals.OUTLOOK_LABELS_HI).alias("hi"))
RAIN_CASE = case("{c}", [(">=", 7, "Much wetter than normal"), (">=", 3, "Wetter than normal"), (">=", 1, "Slightly wetter"), (">", -1, "Near normal"), (">", -3, "Slightly drier"), (">", -7, "Drier than normal")], "Much drier than normal", "")
TEMP_CASE = case("{c}", [(">=", 4, "Very warm"), (">=", 2, "Warm"), (">=", 1, "Slightly warm"), (">", -1, "Near normal"), (">", -2, "Slightly cool"), (">", -4, "Cool")], "Very cool", "")
rec_query("pf11_rain_category", f"SELECT k, {RAIN_CASE.format(c='wk1')} AS category FROM v_record", lambda: signals.rain_category(F.col(W1)).alias("category"))
rec_query("pf12_temp_category", f"SELECT k, {TEMP_CASE.format(c='t1')} AS category FROM v_record", lambda: signals.temp_category(F.col(T1)).alias("category"))
rec_query("pf14_onset_proxy", "SELECT k, CASE WHEN r14 <= -60 THEN 'not_started' WHEN r14 <= -25 THEN 'delayed' WHEN r14 >= 25 THEN 'active' ELSE 'normal' END AS onset FROM v_record",
          lambda: signals.onset_status(F.col("rainfall_last_14_days_pct_departure")).alias("onset"))
_WORD = "CASE WHEN {0} * 100 < 10 THEN 'Very unlikely' WHEN {0} * 100 < 30 THEN 'Unlikely' WHEN {0} * 100 < 50 THEN 'Possible' WHEN {0} * 100 < 70 THEN 'Likely' WHEN {0} * 100 < 90 THEN 'Very likely' ELSE 'Almost certain' END"


@query("pf13_likelihood_words", f"""SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_linenumber = 7 THEN '—' ELSE {_WORD.format('p')} || ' · ' || CAST(round_even(p * 10, 0) AS BIGINT) * 10 || '%' END AS odds
   FROM (SELECT l_orderkey, l_linenumber, l_quantity / 51.0::DOUBLE AS p FROM lineitem)""")
def pf13(spark, sf):
    p = F.when(F.col("l_linenumber") != 7, F.col("l_quantity") / 51.0)
    return v.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), signals.odds_text(p).alias("odds"))


@query("wn14_rain_lean", """SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN w >= coalesce(m, -1) AND w >= d THEN 'Wetter than normal · ' || CAST(round_even(w * 10, 0) AS BIGINT) * 10 || '%'
   WHEN m IS NOT NULL AND m >= d THEN 'Near normal · ' || CAST(round_even(m * 10, 0) AS BIGINT) * 10 || '%' ELSE 'Drier than normal · ' || CAST(round_even(d * 10, 0) AS BIGINT) * 10 || '%' END AS lean
   FROM (SELECT l_orderkey, l_linenumber, l_discount * 10 AS w, CASE WHEN l_linenumber <> 5 THEN l_tax * 10 END AS m, l_quantity / 51.0::DOUBLE AS d FROM lineitem)""")
def wn14(spark, sf):
    w, d = F.col("l_discount") * 10, F.col("l_quantity") / 51.0
    m = F.when(F.col("l_linenumber") != 5, F.col("l_tax") * 10)
    return v.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), signals.rain_lean(w, m, d).alias("lean"))


def _hex(c, span, pos, neg):
    parts = []
    for a, b in zip(pos, neg):
        e = f"(CASE WHEN t >= 0 THEN {a}.0 ELSE {b}.0 END)"
        parts.append(f"CAST(round_even(255 + abs(t) * ({e} - 255), 0) AS INT)")
    return f"(SELECT '#' || " + " || ".join(f"format('{{:02x}}', {p})" for p in parts) + f" FROM (SELECT CAST(greatest(-1, least(1, {c} / {span})) AS DOUBLE) AS t))"


def _red(frac):
    f = f"CAST(greatest(0, least(1, {frac})) AS DOUBLE)"
    return (
        f"'background-color:rgb(' || CAST(round_even(255 + {f} * (139 - 255), 0) AS INT) || ',' || CAST(round_even(255 + {f} * (-255), 0) AS INT) || ',' || CAST(round_even(255 + {f} * (-255), 0) AS INT) "
        f"|| '); color:' || CASE WHEN {f} >= 0.5 THEN '#ffffff' ELSE '#5a1a1a' END || ';'"
    )


rec_query(
    "pf26_colour_maps",
    f"""SELECT k, {_hex('wk1', 8.0, (33, 102, 172), (166, 97, 26))} AS rain_hex, CASE WHEN t1 IS NULL THEN '#e6e6e6' ELSE {_hex('t1', 5.0, (178, 24, 43), (33, 102, 172))} END AS temp_hex,
    CASE WHEN t1 IS NULL OR t1 < 1 THEN '' ELSE {_red('t1 / 6.0')} END AS warm, CASE WHEN wk1 > -1 THEN '' ELSE {_red('-wk1 / 10.0')} END AS dry,
    CASE WHEN wk1 <= -3 THEN 'background-color:#f5b7b1; color:#7b241c;' WHEN wk1 <= -1 THEN 'background-color:#fad7d4;' WHEN wk1 >= 7 THEN 'background-color:#aed6f1; color:#1a5276;' WHEN wk1 >= 3 THEN 'background-color:#d4e6f1;' ELSE '' END AS rain_cell,
    CASE WHEN t1 >= 4 THEN 'background-color:#f5b7b1; color:#7b241c;' WHEN t1 >= 1.5 THEN 'background-color:#fad7d4;' WHEN t1 <= -1.5 THEN 'background-color:#d4e6f1; color:#1a5276;' ELSE '' END AS temp_cell FROM v_record""",
    lambda: signals.map_colour(F.col(W1), "rain").alias("rain_hex"), lambda: signals.map_colour(F.col(T1), "temperature").alias("temp_hex"),
    lambda: signals.warm_shade(F.col(T1)).alias("warm"), lambda: signals.dry_shade(F.col(W1)).alias("dry"),
    lambda: signals.rain_cell_class(F.col(W1)).alias("rain_cell"), lambda: signals.temp_cell_class(F.col(T1)).alias("temp_cell"),
)
rec_query("fn9_signed_numbers", f"SELECT k, {signed_sql('wk1', 0)} AS whole, {signed_sql('wk1', 1)} AS tenth FROM v_record",
          lambda: signals.signed(F.col(W1), 0).alias("whole"), lambda: signals.signed(F.col(W1), 1).alias("tenth"))
rec_query("fn10_valid_week_label", "SELECT k, strftime(d + 8, '%b %d') || ' - ' || strftime(d + 14, '%b %d') AS label FROM (SELECT k, CAST(forecast_date AS DATE) AS d FROM v_record)",
          lambda: dates.valid_week_label(F.col("forecast_date").cast("date"), F.lit(2)).alias("label"))
_WEEKLBL = """'Week ' || {w} || ' · ' || strftime(s, '%b %-d') || CASE WHEN month(s) = month(s + 6) THEN '–' || day(s + 6) ELSE ' – ' || strftime(s + 6, '%b %-d') END"""
rec_query("fn11_week_label", f"""SELECT k, CASE WHEN k % 9 = 4 THEN 'Week 3' ELSE {_WEEKLBL.format(w=3)} END AS label FROM (SELECT k, CAST(forecast_date AS DATE) + 15 AS s FROM v_record)""",
          lambda: dates.week_label(F.when(F.col("k") % 9 == 4, "soon").when(F.col("k") % 2 == 0, F.replace("forecast_date", F.lit("-"), F.lit(""))).otherwise(F.col("forecast_date")), F.lit(3)).alias("label"))


@query("fn12_valid_month_label", "SELECT DISTINCT o_custkey AS k, strftime(date_trunc('month', o_orderdate) + INTERVAL 3 MONTH, '%b %Y') AS label FROM orders")
def fn12(spark, sf):
    return v.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("k"), dates.valid_month_label(dates.month_start(F.col("o_orderdate")), F.lit(3)).alias("label")
    ).distinct()


@query("fn13_date_forms", """SELECT k, CAST(date_trunc('month', CAST(forecast_date AS DATE)) AS DATE) AS month, CASE WHEN k % 4 <> 1 THEN forecast_date END AS iso,
   CASE WHEN k % 3 <> 0 THEN 'Jun 1 – ' || strftime(CAST(forecast_date AS DATE), '%b %-d, %Y') END AS season FROM v_record""")
def fn13(spark, sf):
    d = F.col("forecast_date")
    compact = F.when(F.col("k") % 4 != 1, F.replace(d, F.lit("-"), F.lit(""))).otherwise("2024-13")
    source = F.when(F.col("k") % 3 != 0, F.concat(F.lit("gridded rain, asof "), d)).otherwise("gridded rain")
    return v.records(spark, sf).select(
        "k", dates.month_start(d.cast("date")).alias("month"), dates.compact_to_iso(compact).alias("iso"), dates.season_range(source).alias("season")
    )


@query("fn1_alnum_key", "SELECT p_partkey AS k, lower(replace(p_name || p_brand, ' ', '')) AS key FROM (SELECT p_partkey, p_name, replace(p_brand, '#', '') AS p_brand FROM part)")
def fn1(spark, sf):
    return v.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), text.alnum_key(F.concat("p_name", F.lit(" - "), "p_brand")).alias("key"))


@query("fn2_slugs", """SELECT doc_id, pos, trim(regexp_replace(lower(regexp_replace(strip_accents(line), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', '_', 'g'), '_') AS ascii FROM v_lines""")
def fn2(spark, sf):
    return v.lines(spark, sf).select("doc_id", "pos", text.ascii_slug(F.col("line")).alias("ascii"))


@query("fn2_word_slug", "SELECT p_partkey AS k, lower(replace(p_name, ' ', '_') || '_' || replace(p_brand, '#', '')) AS slug, '_' || lower(replace(p_name, ' ', '_')) || '-' || lower(p_type) AS focus FROM part")
def fn2_words(spark, sf):
    p = v.table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("k"), text.word_slug(F.concat("p_name", F.lit(",  "), "p_brand")).alias("slug"),
        text.focus_slug(F.array("p_name", "p_type")).alias("focus"),
    )


@query("fn3_action_id", "SELECT doc_id, pos, left(trim(regexp_replace(lower(line), '[^a-z0-9]+', '_', 'g'), '_'), 120) AS id FROM v_lines")
def fn3(spark, sf):
    return v.lines(spark, sf).select("doc_id", "pos", text.action_id(F.col("line")).alias("id"))


_CKEY = "lower(trim(trim(regexp_replace(replace({0}, '’', ''''), '\\s+', ' ', 'g')), ' .,;:'))"


@query("fn4_normalise", f"SELECT doc_id, pos, {_CKEY.format('line')} AS key, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS squeezed FROM v_lines")
def fn4(spark, sf):
    return v.lines(spark, sf).select("doc_id", "pos", text.catalog_key(F.col("line")).alias("key"), text.squeeze(F.col("line")).alias("squeezed"))


@query("fn5_roster_names", """SELECT p_partkey AS k, upper(a[1]) || a[2:] || ' ' || upper(b[1]) || b[2:] || ' and Co' AS camel, upper(a[1]) || a[2:] || ' and ' || upper(b[1]) || b[2:] AS roster
   FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)""")
def fn5(spark, sf):
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    return v.table(spark, sf, "part").select(
        F.col("p_partkey").alias("k"), text.split_camel(F.concat(F.initcap(a), F.initcap(b), F.lit("&Co"))).alias("camel"),
        text.clean_roster_name(F.concat(F.upper(a), F.lit(" & "), F.upper(b))).alias("roster"),
    )


@query("fn6_anchor_state", """SELECT page_id, regexp_extract(url, 'example\\.com/([^/]+)/', 1) AS segment, host || ' & more' AS district FROM (SELECT page_id, url, regexp_extract(url, '//([^.]+)\\.', 1) AS host FROM pages)""")
def fn6(spark, sf):
    host = F.regexp_extract("url", r"//([^.]+)\.", 1)
    return v.table(spark, sf, "pages").select(
        "page_id", text.path_segment(F.replace("url", F.lit("/fr/"), F.lit("/%66r%28Pdf%29/")), r"example\.com/([^/]+)/").alias("segment"),
        text.anchor_text(F.concat(F.lit("  "), host, F.lit(" &amp;  more | – "))).alias("district"),
    )


@query("fn20_expand_members", "SELECT member, count(*) AS n FROM (SELECT CASE WHEN event_id % 31 = 0 THEN 'c00' ELSE 'p' || lpad(CAST(event_id % 31 AS VARCHAR), 2, '0') END AS member FROM events) GROUP BY member")
def fn20(spark, sf):
    names = F.array(*[F.lit(m) for m in grid.expand_members("all")])
    return v.lead(spark, sf).groupBy(F.get(names, F.col("member").cast("int")).alias("member")).agg(F.count("*").alias("n"))


@query("fn21_catalog_id", f"SELECT doc_id, pos, 'icar_' || left(sha1({_CKEY.format('line')}), 16) AS id FROM v_lines")
def fn21(spark, sf):
    return v.lines(spark, sf).select("doc_id", "pos", text.catalog_id(F.col("line")).alias("id"))


rec_query("fn24_set_note", "SELECT k, note || ' [forecast fields: model import]: new' AS note FROM v_record",
          lambda: text.set_note(F.when(F.col("k") % 2 == 0, F.concat("imd_source_notes", F.lit("  " + text.NOTE_MARKER + ": old"))).otherwise(F.col("imd_source_notes")), F.lit("new")).alias("note"))
def case_sql(value, mapping, default=None):
    """A lookup as a CASE expression."""
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{n}'" for k, n in mapping.items()) + f" ELSE {default or value} END"


_RISK = "(['Severe', 'Alert', 'Watch', 'Low', 'Other'])[CAST(k % 5 AS INT) + 1]"
_OPTION = "([" + ", ".join(f"'{o}'" for o in labels.OPTIONS_HI["crop_stage"]) + "])[CAST(k % 6 AS INT) + 1]"
_CATEGORY = "([" + ", ".join(f"'{c}'" for c in labels.CATEGORIES_HI) + "])[CAST(k % 13 AS INT) + 1]"
_SCENARIO = "([" + ", ".join(f"'{c}'" for c in labels.SCENARIOS_HI) + "])[CAST(k % 6 AS INT) + 1]"


@query("fn25_labels", f"""SELECT k, CASE onset WHEN 'active' THEN 'सक्रिय' ELSE onset END AS onset_hi, '1 जून से वर्षा ' || abs(since_jun1) || '% ' || CASE WHEN since_jun1 < 0 THEN 'सामान्य से कम' ELSE 'सामान्य से अधिक' END AS reason_hi,
   'अतिरिक्त आकस्मिक उपाय (' || abs(since_jun1) || ' वस्तुएँ) उपलब्ध हैं — अपने स्थानीय KVK विस्तार अधिकारी से सलाह लें।' AS note_hi,
   {case_sql(_RISK, labels.RISKS_HI)} AS risk_hi, {case_sql(_CATEGORY, labels.CATEGORIES_HI)} AS category_hi, {case_sql(_SCENARIO, labels.SCENARIOS_HI)} AS scenario_hi,
   {case_sql(_OPTION, labels.OPTIONS_HI['crop_stage'])} AS option_hi, {_OPTION} AS option_back FROM v_record""")
def fn25(spark, sf):
    def pick(names):
        return F.get(F.array(*(F.lit(n) for n in names)), (F.col("k") % len(names)).cast("int"))

    risk, category, scenario = pick((*labels.RISKS_HI, "Other")), pick(labels.CATEGORIES_HI), pick(labels.SCENARIOS_HI)
    option = labels.option_label("crop_stage", pick(labels.OPTIONS_HI["crop_stage"]), "hi")
    dep = F.col("rainfall_since_june_1_pct_departure")
    reason = F.concat(F.lit("Rainfall since June 1 is "), F.abs(dep).cast("string"), F.lit("% "), F.when(dep < 0, "below").otherwise("above"), F.lit(" normal"))
    return v.records(spark, sf).select(
        "k", text.translate_label(F.col("monsoon_onset_status"), {"active": "सक्रिय"}).alias("onset_hi"), labels.reason_text(reason, "hi").alias("reason_hi"),
        F.format_string(text.ACTION_TEMPLATES_HI["additional_contingency"], F.abs(dep)).alias("note_hi"),
        labels.risk_name(risk, "hi").alias("risk_hi"), labels.category_name(category, "hi").alias("category_hi"),
        labels.scenario_name(scenario, F.lit("none"), "hi").alias("scenario_hi"), option.alias("option_hi"),
        labels.option_value("crop_stage", option, "hi").alias("option_back"),
    )


# --- catalog, lists, checks ---------------------------------------------------------

VIEW_SQL["v_catalog"] = f"SELECT {_CKEY.format('text')} AS key, 'T' || min(item_id) AS translated FROM benchmark GROUP BY 1"


def catalog(spark, sf):
    b = v.table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("pos"), F.concat(F.lit(" "), "text", F.lit(" ;")).alias("source_text"), F.lit("hi").alias("lang"), F.concat(F.lit("T"), s("item_id")).alias("text"))


VIEW_SQL["v_texts"] = "SELECT DISTINCT text FROM (SELECT text FROM benchmark UNION ALL SELECT line FROM v_lines UNION ALL SELECT text || '.' FROM benchmark)"


def texts(spark, sf):
    b = v.table(spark, sf, "benchmark")
    return b.select("text").unionByName(v.lines(spark, sf).select(F.col("line").alias("text"))).unionByName(b.select(F.concat("text", F.lit(".")).alias("text"))).distinct()


@query("jn28_catalog_lookup", f"SELECT t.text, coalesce(c.translated, t.text) AS translated FROM v_texts t LEFT JOIN v_catalog c ON c.key = {_CKEY.format('t.text')}")
def jn28(spark, sf):
    return matching.catalog_lookup(texts(spark, sf), catalog(spark, sf), "hi").select("text", "translated")


@query("ud2_translator_fallback", f"SELECT t.text, coalesce(c.translated, CASE WHEN length(t.text) < 40 THEN '~' || t.text END, t.text) AS translated FROM v_texts t LEFT JOIN v_catalog c ON c.key = {_CKEY.format('t.text')}")
def ud2(spark, sf):
    provider = F.when(F.length("text") < 40, F.concat(F.lit("~"), "text"))
    return matching.catalog_lookup(texts(spark, sf), catalog(spark, sf), "hi", provider).select("text", "translated")


@query("jn29_untranslated", f"SELECT t.text FROM v_texts t WHERE NOT EXISTS (SELECT 1 FROM v_catalog c WHERE c.key = {_CKEY.format('t.text')})")
def jn29(spark, sf):
    return matching.untranslated(texts(spark, sf), catalog(spark, sf))


@query("sl6_limit_after_order", f"SELECT text FROM (SELECT t.text FROM v_texts t WHERE NOT EXISTS (SELECT 1 FROM v_catalog c WHERE c.key = {_CKEY.format('t.text')})) ORDER BY encode(lower(text)), encode(text) LIMIT 25")
def sl6(spark, sf):
    return matching.untranslated(texts(spark, sf), catalog(spark, sf), 25)


@query("st6_action_texts", "SELECT DISTINCT text FROM (SELECT trim(line) AS text FROM v_lines UNION ALL SELECT trim(text) FROM benchmark) WHERE length(text) > 2")
def st6(spark, sf):
    lines = v.lines(spark, sf).select(F.trim("line").alias("text"))
    return lines.unionByName(v.table(spark, sf, "benchmark").select(F.trim("text").alias("text"))).where(F.length("text") > 2).distinct()


@query("fn23_harvest_actions", "SELECT 'act ' || o_orderkey AS action FROM orders")
def fn23(spark, sf):
    raw = contingency_text(spark, sf).select(F.from_json("value", schemas.CONTINGENCY).alias("c")).select("c.*")
    return src.plan_actions(raw).select("action")


@query("pf30_option_lists", "SELECT DISTINCT state, district FROM v_record WHERE state = 'NATION_3'")
def pf30(spark, sf):
    return v.records(spark, sf).where("state = 'NATION_3'").select("state", "district").distinct().orderBy("district")


@query("sl5_sorted_rows", "SELECT state, district, row_number() OVER (ORDER BY lower(state), lower(district)) AS place FROM v_record")
def sl5(spark, sf):
    recs = v.records(spark, sf).select("state", "district", F.lower("state").alias("_s"), F.lower("district").alias("_d"))
    return ordered.numbered(recs, ["_s", "_d"], "place").select("state", "district", "place")


_ERR = """SELECT k, 'rainfall_last_14_days_pct_departure' AS field, 'missing' AS error FROM v_record WHERE k % 10 = 3
  UNION ALL SELECT k, 'monsoon_onset_status', 'invalid value' FROM v_record WHERE k % 8 = 1 UNION ALL SELECT k, 'forecast_date', 'invalid date' FROM v_record WHERE k % 12 = 5
  UNION ALL SELECT k, 'heavy_rain_warning', 'not boolean' FROM v_record WHERE k % 15 = 7"""


def flawed(spark, sf):
    rec = v.records(spark, sf)
    k = F.col("k")
    return (
        rec.withColumn("rainfall_last_14_days_pct_departure", F.when(k % 10 != 3, F.col("rainfall_last_14_days_pct_departure")))
        .withColumn("monsoon_onset_status", F.when(k % 8 == 1, "late").otherwise(F.col("monsoon_onset_status")))
        .withColumn("forecast_date", F.when(k % 12 == 5, "2024-02-31").otherwise(F.col("forecast_date")))
        .withColumn("heavy_rain_warning", F.when(k % 15 == 7, "yes").otherwise(s("heavy_rain_warning")))
    )


@query("pf15_validation_errors", _ERR)
def pf15(spark, sf):
    return quality.validation_errors(flawed(spark, sf), ["k"])


@query("sl4_first_errors", f"SELECT k, field, error, (SELECT count(*) - 10 FROM ({_ERR})) AS more FROM ({_ERR}) ORDER BY k, field LIMIT 10")
def sl4(spark, sf):
    return quality.top_errors(pf15(spark, sf), ["k", "field"], 10)


@query("pf16_range_violations", """SELECT k, 'week1_rainfall_anomaly_mm_day' AS field, wk1 * 7 AS value FROM v_record WHERE abs(wk1 * 7) > 60
   UNION ALL SELECT k, 'rainfall_last_7_days_pct_departure', r7 - 20 FROM v_record WHERE r7 - 20 < -100""")
def pf16(spark, sf):
    rec = v.records(spark, sf).withColumn(W1, F.col(W1) * 7).withColumn("rainfall_last_7_days_pct_departure", F.col("rainfall_last_7_days_pct_departure") - 20)
    return quality.range_violations(rec, ["k"], quality.record_limits())


@query("pf16_odds_and_variants", """SELECT r.k, 'IMD,MME' AS missing FROM v_record r WHERE NOT EXISTS (SELECT 1 FROM v_s2s s WHERE s.ks = lower(r.state) AND s.kd = lower(r.district))""")
def pf16_variants(spark, sf):
    merged = records.merge_weekly(v.records(spark, sf), s2s(spark, sf))
    return quality.missing_variants(merged, ["k"])


@query("ag27_summary_counts", """SELECT state, count(*) AS n_districts, count_if(heat_wave)::BIGINT AS n_heat, count_if(heavy_rain)::BIGINT AS n_rain, count(DISTINCT onset) AS n_onsets FROM v_record GROUP BY state""")
def ag27(spark, sf):
    return v.records(spark, sf).groupBy("state").agg(
        F.count("*").alias("n_districts"), F.count_if("heat_wave_warning").alias("n_heat"), F.count_if("heavy_rain_warning").alias("n_rain"),
        F.count_distinct("monsoon_onset_status").alias("n_onsets"),
    )


_BAND = "CASE WHEN x >= 60 THEN 80 WHEN x >= 20 THEN 40 WHEN x >= -19 THEN 0 WHEN x >= -59 THEN -40 ELSE -80 END"


@query("jn26_subdivision_bands", f"SELECT k, {_BAND} AS midpoint FROM (SELECT r.k, CAST(round_even(avg(r.since_jun1) OVER (PARTITION BY r.state), 0) AS BIGINT) AS x FROM v_record r)")
def jn26(spark, sf):
    recs = v.records(spark, sf).select("k", F.col("state").alias("subdivision"), F.col("rainfall_since_june_1_pct_departure").alias("d"))
    bands = recs.groupBy("subdivision").agg(signals.departure_band(F.bround(F.avg("d"))).alias("band"))
    return recs.join(bands, "subdivision").select("k", signals.band_midpoint(F.col("band")).alias("midpoint"))


VIEW_SQL["v_links"] = "SELECT page_id AS pos, regexp_extract(url, 'example\\.com/([^/]+)/', 1) AS state, regexp_extract(url, '//([^.]+)\\.', 1) AS district, url AS href FROM pages"


@query("jn27_manifest_upsert", """WITH l AS (SELECT lower(state) AS s, lower(district) AS d, arg_min(state, pos) AS state, arg_min(district, pos) AS district, arg_min(href, pos) AS href FROM v_links WHERE length(district) >= 2 GROUP BY ALL),
   e AS (SELECT lower(state) AS s, lower(district) AS d, arg_min(state, pos) AS state, arg_min(district, pos) AS district, 'old_' || min(pos) || '.pdf' AS filename, 'x' AS source_url, 'sha' AS sha256 FROM
     (SELECT pos, state, CASE WHEN pos % 3 = 0 THEN district || ' old' ELSE district END AS district FROM v_links) GROUP BY 1, 2)
   SELECT coalesce(l.state, e.state) AS state, coalesce(l.district, e.district) AS district, coalesce(e.filename, trim(lower(l.state || '_' || l.district), '_') || '.pdf') AS filename, coalesce(l.href, e.source_url) AS source_url,
     coalesce(e.sha256, '') AS sha256, CASE WHEN l.s IS NULL THEN 'kept' WHEN e.s IS NULL THEN 'new' ELSE 'preserved' END AS origin FROM l FULL JOIN e ON l.s = e.s AND l.d = e.d""")
def jn27(spark, sf):
    pages = v.table(spark, sf, "pages")
    base = pages.select(
        F.col("page_id").alias("pos"), F.regexp_extract("url", r"example\.com/([^/]+)/", 1).alias("state"), F.regexp_extract("url", r"//([^.]+)\.", 1).alias("district"), F.col("url").alias("href")
    )
    links = base.withColumn("filename", F.concat(text.ascii_slug(F.concat_ws("_", "state", "district")), F.lit(".pdf")))
    old = base.withColumn("district", F.when(F.col("pos") % 3 == 0, F.concat("district", F.lit(" old"))).otherwise(F.col("district")))
    existing = old.groupBy(F.lower("state").alias("s"), F.lower("district").alias("d")).agg(
        F.min_by("state", "pos").alias("state"), F.min_by("district", "pos").alias("district"),
        F.concat(F.lit("old_"), F.min("pos").cast("string"), F.lit(".pdf")).alias("filename"), F.lit("x").alias("source_url"), F.lit("sha").alias("sha256"),
    ).drop("s", "d")
    return documents.build_manifest(links, existing)


@query("fn17_pixel_of_point", """SELECT cell, CAST(trunc(48 + 36 + (lon - 70.0) * (201 / 28.0::DOUBLE)) AS BIGINT) AS px, CAST(trunc(72 + 26 + (35.0 - lat) * (257 / 30.0::DOUBLE)) AS BIGINT) AS py FROM v_cells""")
def fn17(spark, sf):
    px, py = geo.pixel_of(F.col("lat"), F.col("lon"), F.lit(48), F.lit(72))
    return v.cells(spark, sf).select("cell", px.alias("px"), py.alias("py"))


@query("ad9_category_table", f"SELECT k, 'Week 1 · ' || CASE WHEN month(s) = month(s + 6) THEN strftime(s, '%b %-d') || '–' || day(s + 6) ELSE strftime(s, '%b %-d') || ' – ' || strftime(s + 6, '%b %-d') END AS week, {RAIN_CASE.format(c='wk1')} AS rainfall, {TEMP_CASE.format(c='t1')} AS temperature FROM (SELECT *, CAST(forecast_date AS DATE) + 1 AS s FROM v_record)")
def ad9_categories(spark, sf):
    return v.records(spark, sf).select(
        "k", dates.week_label(F.col("forecast_date"), F.lit(1)).alias("week"), signals.rain_category(F.col(W1)).alias("rainfall"), signals.temp_category(F.col(T1)).alias("temperature")
    )


def week_sql(n):
    s, e = f"(f + {7 * n - 6})", f"(f + {7 * n})"
    label = f"CASE WHEN month({s}) = month({e}) THEN strftime({s}, '%b %-d') || '–' || day({e}) ELSE strftime({s}, '%b %-d') || ' – ' || strftime({e}, '%b %-d') END"
    return f"SELECT k, {n} AS week, 'Week {n} · ' || {label} AS label, {RAIN_CASE.format(c=f'wk{n}')} AS rainfall, {TEMP_CASE.format(c=f't{n}')} AS temperature FROM r"


@query("ad9_category_weeks", "WITH r AS (SELECT *, CAST(forecast_date AS DATE) AS f FROM v_record) " + " UNION ALL ".join(week_sql(n) for n in (1, 2, 3, 4)))
def ad9_weeks(spark, sf):
    week = F.explode(F.array(*(
        F.struct(F.lit(n).alias("week"), F.col(f"week{n}_rainfall_anomaly_mm_day").alias("rain"), F.col(f"week{n}_tmax_anomaly_degC").alias("tmax")) for n in (1, 2, 3, 4)
    )))
    rows = v.records(spark, sf).select("k", "forecast_date", week.alias("w")).select("k", "forecast_date", "w.*")
    return rows.select(
        "k", "week", dates.week_label(F.col("forecast_date"), F.col("week")).alias("label"), signals.rain_category(F.col("rain")).alias("rainfall"), signals.temp_category(F.col("tmax")).alias("temperature")
    )


@query("ad9_odds_table", f"SELECT kd, week, {_WORD.format('w')} || ' · ' || CAST(round_even(w * 10, 0) AS BIGINT) * 10 || '%' AS odds, CAST(round_even(w * 100, 0) AS BIGINT) AS pct FROM v_odds_rows")
def ad9_odds(spark, sf):
    return odds_rows(spark, sf).select(
        text.merge_key(F.col("district")).alias("kd"), "week", signals.odds_text(F.col("p_wetter")).alias("odds"), F.bround(F.col("p_wetter") * 100).cast("int").alias("pct")
    )


@query("ad9_national_map", f"SELECT k, since_jun1 AS value, {signed_sql('since_jun1', 0)} || ' %' AS label, {_hex('since_jun1', 60.0, (33, 102, 172), (166, 97, 26))} AS colour FROM (SELECT k, CAST(since_jun1 AS DOUBLE) AS since_jun1 FROM v_record)")
def ad9_map(spark, sf):
    d = F.col("rainfall_since_june_1_pct_departure").cast("double")
    return v.records(spark, sf).select("k", d.alias("value"), signals.value_label(d, 0, "%").alias("label"), signals.map_colour(d, "season").alias("colour"))


VIEW_SQL["v_region_weights"] = """SELECT state, district, lat, lon, cos(radians(lat)) AS w FROM (SELECT state, district, lat, lon FROM v_inside UNION ALL
   SELECT c.state, c.district, (SELECT arg_min(p.lat, abs(p.lat - c.lat)) FROM v_points p), (SELECT arg_min(p.lon, abs(p.lon - c.lon)) FROM v_points p)
   FROM v_centroid c WHERE NOT EXISTS (SELECT 1 FROM v_inside i WHERE i.district = c.district))"""
VIEW_SQL["v_holed"] = "SELECT lat, lon, CASE WHEN floor(lat * 2)::INT % 9 <> 0 THEN lat + lon END AS x FROM v_points"


@query("ud3_resolver_choice", """SELECT state, district, round(sum(w * x) / sum(CASE WHEN x IS NOT NULL THEN w END), 6) AS skipped,
   CASE WHEN count(x) = count(*) THEN round(sum(w * x) / sum(w), 6) END AS propagated FROM v_region_weights JOIN v_holed USING (lat, lon) GROUP BY state, district""")
def ud3(spark, sf):
    shapes = v.polygons(spark, sf)
    resolvers = {"gadm": providers.Resolver(shapes), "lgd": providers.Resolver(shapes, "propagate")}
    values = v.grid_points(spark, sf).withColumn("x", F.when(F.floor(F.col("lat") * 2).cast("int") % 9 != 0, F.col("lat") + F.col("lon")))
    one, other = (providers.district_means(resolvers, name, values, [], ["x"]) for name in ("gadm", "lgd"))
    both = one.withColumnRenamed("x", "skipped").join(other.withColumnRenamed("x", "propagated"), ["state", "district"])
    return both.select("state", "district", r("skipped", 6), r("propagated", 6))


def mark_if_short():
    """A translator that marks short texts and does not know others."""
    return lambda texts: ["~" + t if len(t) < 40 else None for t in texts]


@query("ud2_translator_batches", f"""SELECT t.text, coalesce(c.translated, CASE WHEN length(t.text) < 40 THEN '~' || t.text END, t.text) AS translated FROM v_texts t
   LEFT JOIN v_catalog c ON c.key = {_CKEY.format('t.text')}""")
def ud2_batches(spark, sf):
    return providers.translate(texts(spark, sf), catalog(spark, sf), "hi", mark_if_short).select("text", "translated")


VIEW_SQL["v_states"] = "SELECT segment, upper(segment) AS state FROM (SELECT DISTINCT state AS segment FROM v_links) WHERE segment <> (SELECT min(state) FROM v_links)"
VIEW_SQL["v_known_plans"] = """SELECT upper(state) AS state, CASE WHEN pos % 3 = 0 THEN district || ' old' ELSE district END AS district, 'old_' || min(pos) || '.pdf' AS filename FROM v_links
   WHERE pos % 2 = 0 AND state <> (SELECT min(state) FROM v_links) GROUP BY 1, 2"""


def plan_links(spark, sf):
    """Page addresses as links of an index, with a map that lacks one segment."""
    pages = v.table(spark, sf, "pages")
    links = pages.select(
        text.path_segment(F.col("url"), r"example\.com/([^/]+)/").alias("segment"), F.regexp_extract("url", r"//([^.]+)\.", 1).alias("district"),
        F.col("url").alias("href"), F.col("page_id").alias("pos"),
    )
    first = links.agg(F.min("segment")).scalar()
    states = links.select("segment").distinct().where(F.col("segment") != first).select("segment", F.upper("segment").alias("state"))
    mapped, unmapped = documents.mapped_links(links, states)
    name = F.concat(text.ascii_slug(F.concat_ws("_", "state", "district")), F.lit(".pdf"))
    known = mapped.where("pos % 2 = 0").select("state", F.when(F.col("pos") % 3 == 0, F.concat("district", F.lit(" old"))).otherwise(F.col("district")).alias("district"), "pos")
    known = known.groupBy("state", "district").agg(F.concat(F.lit("old_"), F.min("pos").cast("string"), F.lit(".pdf")).alias("filename"))
    existing = known.select("state", "district", "filename", F.lit("u").alias("source_url"), F.lit("sum").alias("sha256"))
    return documents.build_manifest(mapped.withColumn("filename", name), existing), unmapped


VIEW_SQL["v_plan_manifest"] = """SELECT coalesce(l.state, e.state) AS state, coalesce(l.district, e.district) AS district, coalesce(l.href, 'u') AS source_url, coalesce(e.filename, lower(l.state || '_' || l.district) || '.pdf') AS filename,
   CASE WHEN e.state IS NULL THEN '' ELSE 'sum' END AS sha256, CASE WHEN l.state IS NULL THEN 'kept' WHEN e.state IS NULL THEN 'new' ELSE 'preserved' END AS origin
   FROM (SELECT s.state, v_links.district, arg_min(href, pos) AS href FROM v_links JOIN v_states s ON s.segment = v_links.state WHERE length(district) >= 2 GROUP BY ALL) l
   FULL JOIN v_known_plans e ON e.state = l.state AND lower(e.district) = lower(l.district)"""


@query("ex7_mapped_index", "SELECT * FROM v_plan_manifest")
def ex7_mapped(spark, sf):
    return plan_links(spark, sf)[0]


@query("fn6_unmapped_segments", "SELECT state AS segment, count(*) AS n FROM v_links WHERE state = (SELECT min(state) FROM v_links) GROUP BY state")
def fn6_unmapped(spark, sf):
    return plan_links(spark, sf)[1]


@query("ag27_run_totals", """SELECT origin AS kind, state AS place, count(*) AS n FROM v_plan_manifest GROUP BY ALL UNION ALL SELECT origin, NULL, count(*) FROM v_plan_manifest GROUP BY ALL""")
def ag27_totals(spark, sf):
    return quality.run_totals(plan_links(spark, sf)[0], "origin", "state")


@query("ad9_source_table", """SELECT r.k, CASE WHEN s.model = 'MME' THEN 'MME' ELSE s.model END AS key, s.week, s.precip AS rain, s.t2m AS tmax FROM v_record r JOIN v_s2s s ON s.ks = lower(r.state) AND s.kd = lower(r.district)
   UNION ALL SELECT k, CASE WHEN EXISTS (SELECT 1 FROM v_s2s s WHERE s.ks = lower(r.state) AND s.kd = lower(r.district)) THEN 'IMD' ELSE '' END, w,
     CASE w WHEN 1 THEN wk1 WHEN 2 THEN wk2 WHEN 3 THEN wk3 ELSE wk4 END, CASE w WHEN 1 THEN t1 WHEN 2 THEN t2 WHEN 3 THEN t3 ELSE t4 END FROM v_record r, range(1, 5) t(w)""")
def ad9_sources(spark, sf):
    merged = records.merge_weekly(v.records(spark, sf), s2s(spark, sf))
    key = F.when(F.col("label") == "", "").when(F.col("label") == records.BASELINE_LABEL, "IMD").when(F.startswith("label", F.lit("Multi-model mean")), "MME").otherwise(F.col("label"))
    return records.source_table(merged, ["k"]).select("k", key.alias("key"), "week", F.col("rainfall_mm_day").alias("rain"), F.col("tmax_degC").alias("tmax"))


@query("ad9_category_split", "SELECT r.k, o.week, CAST(round_even(o.w * 100, 0) AS INT) AS wetter FROM v_record r JOIN v_odds_rows o ON o.ks = lower(r.state) AND o.kd = lower(r.district)")
def ad9_split(spark, sf):
    odds = records.attach_odds(v.records(spark, sf), odds_rows(spark, sf))
    return records.category_split(odds, ["k"]).select("k", "week", "wetter")


@query("pf16_odds_range", """SELECT ks, kd, week, 'p_wetter' AS field, round(w * 1.2 - 0.1, 6) AS value FROM v_odds_rows WHERE round(w * 1.2 - 0.1, 6) < 0 OR round(w * 1.2 - 0.1, 6) > 1.001""")
def pf16_odds(spark, sf):
    odds = records.with_keys(odds_rows(spark, sf)).withColumn("p_wetter", F.round(F.col("p_wetter") * 1.2 - 0.1, 6))
    return quality.odds_range_violations(odds.select(F.col("_ks").alias("ks"), F.col("_kd").alias("kd"), "week", "p_wetter", "p_heavy"), ["ks", "kd", "week"], ["p_wetter", "p_heavy"])
