"""Document-table, bulletin and map-pixel queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyfold.functions import text
from skyfold.operators import extract, quality, raster
from skyfold.plans import views as v
from skyfold.plans.record_queries import sql_text
from skyfold.plans.registry import VIEW_SQL, query
from skyfold.plans.scratch import scratch
from skyfold.session import stage
from skyfold.sources import documents, sinks
from skyfold.sources.big_json import read_array

PHRASES = (
    "Terminal drought ", "Mid-season drought ", "mid season break ", "Floods in field ", "Water logging ", "Delay by 2 weeks ",
    "Delayed onset by 2 weeks ", "Delay by 6 weeks ", "Early season ", "Normal onset ", "", "Delayed onset ",
)
MARKS = ("NA", "-do-", "Condition", "Crop managementa", "As above. ", "Nil *", "ok", "No change")


def _pick(index, values):
    return F.get(F.array(*[F.lit(x) for x in values]), index.cast("int"))


def _sql_pick(index, values):
    return "([" + ", ".join(sql_text(x) for x in values) + f"])[CAST({index} AS INT) + 1]"


def condition_sql(c):
    t = f"lower({c})"

    def any_of(words):
        return "(" + " OR ".join(f"contains({t}, '{w}')" for w in words) + ")"

    return (
        f"CASE WHEN contains({t}, 'terminal') THEN 'terminal_drought' WHEN contains({t}, 'mid season') OR contains({t}, 'mid-season') THEN 'mid_season_break' "
        f"WHEN {any_of(extract.SCENARIO_PHRASES['excess_rainfall_waterlogging'])} THEN 'excess_rainfall_waterlogging' "
        f"WHEN contains({t}, 'delay by 2') OR (contains({t}, 'delayed onset') AND contains({t}, '2 week')) THEN 'delayed_monsoon' "
        f"WHEN {any_of(extract.SCENARIO_PHRASES['early_season_dry_spell'])} THEN 'early_season_dry_spell' END"
    )


VIEW_SQL["v_cond_lines"] = f"SELECT doc_id, pos, {_sql_pick('(doc_id * 5 + pos) % 12', PHRASES)} || line AS text, line FROM v_lines"


def cond_lines(spark, sf):
    return v.lines(spark, sf).withColumn("text", F.concat(_pick((F.col("doc_id") * 5 + F.col("pos")) % 12, PHRASES), "line"))


@query("pf19_condition_scenario", f"SELECT doc_id, pos, {condition_sql('text')} AS scenario FROM v_cond_lines")
def pf19(spark, sf):
    return cond_lines(spark, sf).select("doc_id", "pos", extract.condition_scenario(F.col("text")).alias("scenario"))


def _in(values):
    return "(" + ", ".join(sql_text(x) for x in values) + ")"


_N = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"
VIEW_SQL["v_mark_lines"] = f"SELECT doc_id, pos, CASE WHEN (doc_id + pos) % 2 = 0 THEN {_sql_pick('(doc_id * 3 + pos) % 8', MARKS)} ELSE line END AS text FROM v_lines"


def mark_lines(spark, sf):
    mark = _pick((F.col("doc_id") * 3 + F.col("pos")) % 8, MARKS)
    return v.lines(spark, sf).select("doc_id", "pos", F.when((F.col("doc_id") + F.col("pos")) % 2 == 0, mark).otherwise(F.col("line")).alias("text"))


@query("pf20_cell_predicates", f"""SELECT doc_id, pos, n IN {_in(extract.HEADER_LABELS)} OR left(n, greatest(length(n) - 1, 0)) IN {_in(extract.HEADER_LABELS)} AS header,
   trim(n, ' .*') IN {_in(extract.PLACEHOLDERS)} AS placeholder, trim(n, ' .*') IN {_in(extract.DITTOS)} AS ditto FROM (SELECT *, {_N} AS n FROM v_mark_lines)""")
def pf20(spark, sf):
    t = F.col("text")
    return mark_lines(spark, sf).select(
        "doc_id", "pos", extract.is_header_label(t).alias("header"), extract.is_placeholder(t).alias("placeholder"), extract.is_ditto(t).alias("ditto")
    )


def valid_sql(p):
    n = f"lower(trim(regexp_replace({p}, '\\s+', ' ', 'g')))"
    return (
        f"(NOT ({n} IN {_in(extract.HEADER_LABELS)} OR left({n}, greatest(length({n}) - 1, 0)) IN {_in(extract.HEADER_LABELS)}) "
        f"AND NOT (regexp_extract({p}, '[A-Za-z]') <> '' AND regexp_matches(regexp_extract({p}, '[A-Za-z]'), '[a-z]') AND len(string_split_regex(trim({p}), '\\s+')) < 9) "
        f"AND regexp_matches({p}, '[A-Za-z]{{3,}}') AND length({p}) >= 4)"
    )


@query("pf21_valid_action", f"SELECT doc_id, pos, {valid_sql('text')} AS ok FROM v_mark_lines")
def pf21(spark, sf):
    return mark_lines(spark, sf).select("doc_id", "pos", extract.is_valid_action(F.col("text")).alias("ok"))


@query("fn7_split_actions", f"""SELECT doc_id, pos, count(*) AS n, sum(length(p))::BIGINT AS chars FROM (SELECT doc_id, pos, trim(regexp_replace(unnest(string_split(replace(line, '. ', ' • '), '•')), '\\s+', ' ', 'g')) AS p FROM v_lines)
   WHERE {valid_sql('p')} GROUP BY doc_id, pos""")
def fn7(spark, sf):
    # dealt by document first: the split runs in all tasks whatever the files are, and its sums need no further shuffle
    cells = v.lines(spark, sf).repartition("doc_id").select("doc_id", "pos", F.replace("line", F.lit(". "), F.lit(" • ")).alias("cell"))
    return extract.explode_actions(cells, "cell").groupBy("doc_id", "pos").agg(F.count("*").alias("n"), F.sum(F.length("action")).alias("chars"))


STOCK = ("Feed the cattle ", "Sow maize ", "Vaccinated birds ", "Deworm ", "shed ", "Kids play ")
VIEW_SQL["v_stock_lines"] = f"SELECT doc_id, pos, {_sql_pick('(doc_id + pos * 5) % 6', STOCK)} || line AS text FROM v_lines"
_STOCK_RE = extract.LIVESTOCK


@query("pf18_livestock", f"SELECT regexp_matches(text, '{_STOCK_RE}') AS livestock, count(*) AS n, sum(length(text))::BIGINT AS chars FROM v_stock_lines GROUP BY 1")
def pf18(spark, sf):
    lines = v.lines(spark, sf).select(F.concat(_pick((F.col("doc_id") + F.col("pos") * 5) % 6, STOCK), "line").alias("text"))
    return lines.groupBy(extract.is_livestock(F.col("text")).alias("livestock")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


# --- carry-forward over table rows -------------------------------------------------

@query("wn7_dittos", """SELECT doc, "row", col, d AS resolved_from_ditto, CASE WHEN d THEN above ELSE t END AS resolved FROM (
   SELECT *, last_value(CASE WHEN NOT d THEN t END IGNORE NULLS) OVER (PARTITION BY doc, col ORDER BY "row" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM
   (SELECT doc, "row", col, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, text = '-do-' AS d FROM v_cells_tbl) WHERE t <> '') WHERE NOT d OR above IS NOT NULL""")
def wn7(spark, sf):
    return extract.resolve_dittos(v.table_cells(spark, sf), ["doc", "col"], "text").select("doc", "row", "col", "resolved_from_ditto", "resolved")


@query("wn6_context_fill", f"""SELECT doc, "row", last_value(CASE WHEN t <> '' THEN t END IGNORE NULLS) OVER w AS farming_situation,
   last_value(CASE WHEN c <> '' AND ({condition_sql('c')}) IS NULL THEN c END IGNORE NULLS) OVER w AS crop FROM (
   SELECT doc, "row", trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, trim(CASE WHEN "row" % 3 = 1 THEN 'Flood' ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END) AS c FROM v_cells_tbl)
   WINDOW w AS (PARTITION BY doc ORDER BY "row" ROWS UNBOUNDED PRECEDING)""")
def wn6(spark, sf):
    cells = v.table_cells(spark, sf).select(
        "doc", "row", F.col("text").alias("farm"), F.when(F.col("row") % 3 == 1, "Flood").otherwise(text.squeeze(F.col("text"))).alias("crop_text")
    )
    return extract.fill_context(cells, ["doc"], "farm", "crop_text").select("doc", "row", "farming_situation", "crop")


@query("wn8_scenario_carry", f"""SELECT doc_id, pos, coalesce(s, CASE WHEN doc_id % 3 = 0 THEN 'terminal_drought' END) AS scenario FROM (
   SELECT doc_id, pos, last_value(CASE WHEN pos % 4 = 2 THEN {condition_sql('text')} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS s FROM v_cond_lines)
   WHERE s IS NOT NULL OR doc_id % 3 = 0""")
def wn8(spark, sf):
    rows = cond_lines(spark, sf).withColumn("row", F.col("pos")).withColumn(
        "named", F.when(F.col("pos") % 4 == 2, extract.condition_scenario(F.col("text")))
    )
    out = extract.fill_scenarios(rows, ["doc_id"], "named", F.when(F.col("doc_id") % 3 == 0, "terminal_drought"))
    return out.select("doc_id", "pos", "scenario")


@query("jn30_nearest_anchor", """SELECT doc, "row", c, role FROM (SELECT doc, "row", c, a.role, row_number() OVER (PARTITION BY doc, "row" ORDER BY abs(a.p - c), a.p) AS rn FROM
   (SELECT doc, "row", length(text) % 12 AS c FROM v_cells_tbl), (VALUES (0, 'condition'), (3, 'change'), (5, 'agro'), (9, 'remarks')) a(p, role)) WHERE rn = 1""")
def jn30(spark, sf):
    anchors = F.array(*[F.struct(F.lit(p).alias("col"), F.lit(r).alias("role")) for p, r in ((0, "condition"), (3, "change"), (5, "agro"), (9, "remarks"))])
    c = F.length("text") % 12
    return v.table_cells(spark, sf).select("doc", "row", c.alias("c"), extract.nearest_role(anchors, c)["role"].alias("role"))


# --- plan tables ----------------------------------------------------------------------

HEADER = ("Condition", "Major farming situation", "Normal crop / cropping system", "Change in crop / cropping system", "Agronomic measures", "Remarks on implementation")
CONDITIONS = ("Mid season drought", "", "", "Terminal drought", "")


def plan_cells(spark, sf):
    """Every document as a plan of two pages: a header table, then a continuation without header.

    Documents are dealt before cells are made of them, whatever the files are; a header's
    cells come from the same row as the first line's, so tables meet without another shuffle.
    """
    pos, line = F.col("pos"), F.col("line")
    docs = v.table(spark, sf, "documents").select("doc_id", "text").repartition("doc_id")
    lines = docs.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))
    step = F.replace(line, F.lit(". "), F.lit(" • "))
    cols = F.array(
        _pick(pos % 5, CONDITIONS),
        F.when(pos % 3 == 0, F.concat(F.lit("Situation "), (pos % 4).cast("string"))).otherwise(""),
        F.when(pos % 4 == 1, F.concat(F.lit("Rice - "), (pos % 7).cast("string"))),
        F.when(pos % 7 == 3, "-do-").otherwise(step),
        F.when(pos % 5 == 2, "NA").when(pos % 5 == 4, "").otherwise(F.concat(F.lit("Mulch then "), line)),
        F.lit(""),
    )
    page = F.floor(pos / 6).cast("int")
    # the first page starts with a header row, so its body is one row lower
    row = F.when(page == 0, pos % 6 + 1).otherwise(pos % 6).cast("int")

    def table_row(page, row, texts):
        return F.struct(page.alias("page"), row.alias("row"), texts.alias("cells"))

    head, body = table_row(F.lit(0), F.lit(0), F.array(*[F.lit(h) for h in HEADER])), table_row(page, row, cols)
    rows = F.when(pos.isNull(), F.array(head)).when(pos == 0, F.array(head, body)).otherwise(F.array(body))
    return lines.select("doc_id", F.inline(rows)).select("doc_id", "page", F.lit(0).alias("table"), "row", F.posexplode("cells").alias("col", "text"))


VIEW_SQL["v_plan_rows"] = f"""SELECT doc_id, pos, CAST(floor(pos / 6.0) AS BIGINT) AS page, {_sql_pick('pos % 5', CONDITIONS)} AS cond, CASE WHEN pos % 3 = 0 THEN 'Situation ' || pos % 4 END AS farm,
  CASE WHEN pos % 4 = 1 THEN 'Rice - ' || pos % 7 END AS crop, CASE WHEN pos % 7 = 3 THEN '-do-' ELSE replace(line, '. ', ' • ') END AS chg,
  CASE WHEN pos % 5 = 2 THEN 'NA' WHEN pos % 5 = 4 THEN '' ELSE 'Mulch then ' || line END AS agro, line FROM v_lines"""


@query("ex1_table_analysis", """SELECT doc_id, 0 AS page, 'measures' AS kind, 1 AS data_start, '0:condition,1:farming,2:normal,3:change,4:agro,5:remarks' AS anchors FROM documents""")
def ex1(spark, sf):
    a = extract.analyze_tables(plan_cells(spark, sf))
    anchors = F.array_join(F.transform("anchors", lambda x: F.concat(x["col"].cast("string"), F.lit(":"), x["role"])), ",")
    return a.select("doc_id", "page", "kind", "data_start", anchors.alias("anchors"))


@query("ex2_column_roles", "SELECT doc_id, col, role FROM documents, (VALUES (0, 'condition'), (1, 'farming'), (2, 'normal'), (3, 'change'), (4, 'agro'), (5, 'remarks')) t(col, role)")
def ex2(spark, sf):
    a = extract.analyze_tables(plan_cells(spark, sf))
    cols = a.select("doc_id", "anchors", F.explode(F.sequence(F.lit(0), F.col("ncols") - 1)).alias("col"))
    return cols.select("doc_id", "col", extract.nearest_role(F.col("anchors"), F.col("col"))["role"].alias("role"))


@query("wn9_continuation_tables", f"""SELECT doc_id, page, count(*) AS n_tables FROM (
   SELECT DISTINCT doc_id, page FROM v_plan_rows WHERE page = 0
   UNION SELECT DISTINCT doc_id, page FROM v_plan_rows WHERE page > 0 GROUP BY doc_id, page HAVING count(*) >= 2 AND
     bool_or(cond <> '' OR ({condition_sql("chg")}) IS NOT NULL OR ({condition_sql("agro")}) IS NOT NULL)) GROUP BY ALL""")
def wn9(spark, sf):
    t = extract.usable_tables(stage(extract.table_rows(plan_cells(spark, sf)), "plan-rows"))
    return t.groupBy("doc_id", "page").agg(F.count("*").alias("n_tables"))


def harvested(spark, sf):
    return extract.harvest(plan_cells(spark, sf))


def _sq(c):
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


_USABLE = f"""SELECT DISTINCT doc_id, page FROM v_plan_rows WHERE page = 0 UNION SELECT doc_id, page FROM v_plan_rows WHERE page > 0 GROUP BY doc_id, page HAVING count(*) >= 2 AND
     bool_or(cond <> '' OR ({condition_sql("chg")}) IS NOT NULL OR ({condition_sql("agro")}) IS NOT NULL)"""
# enumerators before a word count as bullets
_BULLETED = "regexp_replace(r, '(^|[\\s•])(\\d{1,2}|i{1,3}|iv|vi{0,3}|v)[.)](\\s+([A-Za-z])|([A-Z]))', '\\1•\\4\\5', 'g')"
_MARKED = "trim(lower({0}), '" + text.CELL_TRIM + "')"


@query("ex3_harvest", f"""WITH named AS (SELECT b.*, pos % 6 + (page = 0)::INT AS "row", last_value({condition_sql('cond')} IGNORE NULLS) OVER
    (PARTITION BY doc_id, page ORDER BY pos ROWS UNBOUNDED PRECEDING) AS scenario FROM v_plan_rows b JOIN ({_USABLE}) USING (doc_id, page)),
  carried AS (SELECT *, last_value(CASE WHEN farm <> '' THEN {_sq('farm')} END IGNORE NULLS) OVER w AS fs, last_value(CASE WHEN crop <> '' THEN {_sq('crop')} END IGNORE NULLS) OVER w AS cr
    FROM named WHERE scenario IS NOT NULL WINDOW w AS (PARTITION BY doc_id, page ORDER BY pos ROWS UNBOUNDED PRECEDING)),
  cells AS (SELECT doc_id, page, "row", 3 AS col, 'change' AS "column", scenario, fs, cr, {_sq('chg')} AS t FROM carried
    UNION ALL SELECT doc_id, page, "row", 4, 'agro', scenario, fs, cr, {_sq('agro')} FROM carried),
  marked AS (SELECT *, last_value(CASE WHEN NOT d THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id, page, col ORDER BY "row" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above
    FROM (SELECT *, {_MARKED.format('t')} IN {_in(extract.DITTOS)} AS d FROM cells WHERE t <> '')),
  resolved AS (SELECT *, CASE WHEN d THEN above ELSE t END AS r FROM marked WHERE NOT d OR above IS NOT NULL),
  pieces AS (SELECT * EXCLUDE (parts), trim(unnest(parts)) AS p, unnest(range(len(parts))) AS piece FROM (SELECT *, string_split({_BULLETED}, '•') AS parts FROM resolved))
  SELECT doc_id, scenario, page, "row", "column", p AS action, cr AS crop, fs AS farming_situation, d AS resolved_from_ditto, {_MARKED.format('r')} IN {_in(extract.PLACEHOLDERS)} AS placeholder FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, scenario, lower(p), lower(coalesce(cr, '')), lower(coalesce(fs, '')), "column" ORDER BY page, "row", col, piece) AS n FROM pieces WHERE {valid_sql('p')}) WHERE n = 1""")
def ex3(spark, sf):
    h = harvested(spark, sf)
    return h.select("doc_id", "scenario", "page", "row", "column", "action", "crop", "farming_situation", "resolved_from_ditto", "placeholder")


SHAPES = (
    (
        ("Condition", "", "Suggested Contingency measures", "", ""),
        ("Early season drought (delayed onset)", "Major Farming situation", "Normal Crop / cropping system", "Change in crop / cropping system", "Agronomic measures"),
        ("Delay by 2 weeks", "Red soils", "Maize", "", ""),
    ),
    (
        ("Condition", "Suggested contingency measure", "", "", ""),
        ("", "Vegetative stage", "Flowering stage", "Crop maturity stage", "Post harvest"),
        ("Continuous high rainfall in a short span leading to water logging", "", "", "", ""),
    ),
    (
        ("Condition", "Major farming situation", "Normal crop / cropping system", "Change in crop / cropping system including", "Remarks"),
        ("", "", "", "variety", ""),
        ("Terminal drought", "", "", "", ""),
    ),
)
SHAPE_SQL = (
    "WHEN 0 THEN ['measures', '1', '0:condition,1:farming,2:normal,3:change,4:agro', 'early_season_dry_spell'] "
    "WHEN 1 THEN ['stages', '2', '0:condition,1:stage:vegetative stage,2:stage:flowering stage,3:stage:crop maturity,4:stage:post harvest', ''] "
    "ELSE ['measures', '2', '0:condition,1:farming,2:normal,3:change,4:remarks', ''] END"
)


def shaped_cells(spark, sf):
    """Every document's lines below one of three header shapes; every fourth header holds a bullet."""
    def heads(shape):
        return F.array(*(F.array(*(F.lit(c) for c in row)) for row in shape))

    doc = F.col("doc_id")
    head = F.when(doc % 3 == 0, heads(SHAPES[0])).when(doc % 3 == 1, heads(SHAPES[1])).otherwise(heads(SHAPES[2]))
    body = F.transform(F.split("text", "\n"), lambda t: F.array(F.lit(""), F.lit(""), F.lit(""), t, F.lit("")))
    docs = v.table(spark, sf, "documents").select("doc_id", "text").repartition("doc_id")
    rows = docs.select("doc_id", F.posexplode(F.concat(head, body)).alias("row", "cells"))
    cells = rows.select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("table"), "row", F.posexplode("cells").alias("col", "text"))
    marked = (doc % 4 == 0) & (F.col("row") == 0) & (F.col("col") == 2)
    return cells.withColumn("text", F.when(marked, F.concat("text", F.lit(" •"))).otherwise(F.col("text")))


@query("ex1_header_shapes", f"SELECT doc_id, s[1] AS kind, s[2]::INT AS data_start, s[3] AS anchors, s[4] AS table_scenario FROM (SELECT doc_id, CASE doc_id % 3 {SHAPE_SQL} AS s FROM documents)")
def ex1_shapes(spark, sf):
    a = extract.analyze_tables(shaped_cells(spark, sf))
    anchors = F.array_join(F.transform("anchors", lambda x: F.concat(x["col"].cast("string"), F.lit(":"), x["role"])), ",")
    return a.select("doc_id", "kind", "data_start", anchors.alias("anchors"), F.coalesce("table_scenario", F.lit("")).alias("table_scenario"))


@query("pf34_bullets_in_headers", "SELECT doc_id FROM documents WHERE doc_id % 4 = 0")
def pf34_headers(spark, sf):
    return quality.bullets_in_headers(extract.analyze_tables(shaped_cells(spark, sf))).select("doc_id")


VIEW_SQL["v_verbatim"] = """SELECT doc_id, pos % 6 + (page = 0)::INT AS "row", page, line FROM (SELECT doc_id, pos, line, CAST(floor(pos / 6.0) AS BIGINT) AS page FROM v_lines)"""


@query("pf34_planted_actions", """SELECT doc_id, page, "row" FROM v_verbatim WHERE "row" % 3 = 1""")
def pf34_planted(spark, sf):
    """The line of each advice cell as an action; every third one is not what the cell says."""
    page = F.floor(F.col("pos") / 6)
    at = v.lines(spark, sf).select("doc_id", page.alias("page"), F.lit(0).alias("table"), (F.col("pos") % 6 + (page == 0).cast("int")).alias("row"), F.lit(4).alias("col"), "line")
    cells = at.withColumn("text", F.concat(F.lit("Mulch then "), "line"))
    actions = at.withColumn("action", F.when(F.col("row") % 3 == 1, F.concat(F.lit("*"), "line", F.lit("*"))).otherwise(text.squeeze(F.col("line")))).drop("line")
    return quality.not_verbatim(actions, cells).select("doc_id", "page", "row")


@query("pf34_verbatim_actions", "SELECT doc_id FROM documents WHERE false")
def pf34(spark, sf):
    cells = plan_cells(spark, sf)
    plain = stage(extract.harvest(cells).where(~F.col("resolved_from_ditto")), "harvest")
    bad = quality.not_verbatim(plain, cells).select("doc_id")
    headers = plain.where(extract.is_header_label(F.col("action"))).select("doc_id")
    return bad.unionByName(headers)


VIEW_SQL["v_extracted"] = f"""SELECT doc_id, pos, {_sql_pick('doc_id % 5', extract.PLAN_SCENARIOS)} AS scenario, {_sql_pick('(doc_id + pos * 5) % 6', STOCK)} || line AS action,
  CASE WHEN pos % 2 = 0 THEN 'Crop ' || CAST(pos % 13 AS VARCHAR) || ' - x' END AS crop, CAST(NULL AS VARCHAR) AS farm, pos % 11 = 0 AS placeholder FROM v_lines"""


def extracted(spark, sf):
    pos = F.col("pos")
    return v.lines(spark, sf).select(
        "doc_id", "pos", _pick(F.col("doc_id") % 5, extract.PLAN_SCENARIOS).alias("scenario"),
        F.concat(_pick((F.col("doc_id") + pos * 5) % 6, STOCK), "line").alias("action"),
        F.when(pos % 2 == 0, F.concat(F.lit("Crop "), (pos % 13).cast("string"), F.lit(" - x"))).alias("crop"),
        F.lit(None).cast("string").alias("farming_situation"), (pos % 11 == 0).alias("placeholder"),
        F.lit(0).alias("page"), F.lit(0).alias("table"), pos.alias("row"), F.lit(0).alias("col"), F.lit(0).alias("piece"),
    )


@query("ex4_convert", f"""SELECT doc_id, scenario, action, crop, pos, CASE WHEN regexp_matches(action, '{_STOCK_RE}') THEN 'livestock' ELSE 'crop' END AS kind FROM (
   SELECT *, row_number() OVER (PARTITION BY doc_id, scenario, lower(action), lower(coalesce(crop, '')) ORDER BY pos) AS rn FROM v_extracted WHERE NOT placeholder) WHERE rn = 1""")
def ex4(spark, sf):
    return extract.contingency_rows(extracted(spark, sf)).select("doc_id", "scenario", "action", "crop", "pos", "kind")


@query("ex4_nested_plans", f"""SELECT doc_id, scenario, count_if(NOT l)::BIGINT AS n_crop, count_if(l)::BIGINT AS n_livestock, coalesce(first(action ORDER BY pos) FILTER (NOT l), '') AS first_crop FROM (
   SELECT *, regexp_matches(action, '{_STOCK_RE}') AS l, row_number() OVER (PARTITION BY doc_id, scenario, lower(action), lower(coalesce(crop, '')) ORDER BY pos) AS rn FROM v_extracted WHERE NOT placeholder) WHERE rn = 1 GROUP BY doc_id, scenario""")
def ex4_nested(spark, sf):
    path = scratch(spark, "plans")
    sinks.write_array(extract.nest_contingency(extract.contingency_rows(extracted(spark, sf))), path)
    item = "array<struct<action:string,crop:string,farming_situation:string>>"
    back = read_array(spark, path, f"doc_id long, scenarios map<string,struct<crop_actions:{item},livestock_actions:{item}>>")
    plans = back.select("doc_id", F.explode("scenarios").alias("scenario", "p"))
    return plans.select(
        "doc_id", "scenario", F.size("p.crop_actions").alias("n_crop"), F.size("p.livestock_actions").alias("n_livestock"),
        F.coalesce(F.get("p.crop_actions", F.lit(0))["action"], F.lit("")).alias("first_crop"),
    )


@query("ag28_coverage", f"""SELECT doc_id, count(*) AS total_actions, count_if(scenario = 'mid_season_break')::BIGINT AS mid_season_break, min(scenario) AS found, 5 - count(DISTINCT scenario) AS n_missing FROM v_extracted GROUP BY doc_id""")
def ag28(spark, sf):
    c = quality.coverage(extracted(spark, sf), ["doc_id"], extract.PLAN_SCENARIOS)
    return c.select("doc_id", "total_actions", "mid_season_break", "found", F.size(F.split("missing", ",")).alias("n_missing"))


@query("ag29_major_crops", """SELECT doc_id, array_to_string((list_sort(list(DISTINCT trim(split_part(crop, '-', 1)))))[1:10], ',') AS crops FROM v_extracted WHERE crop IS NOT NULL GROUP BY doc_id""")
def ag29(spark, sf):
    return extract.major_crops(extracted(spark, sf), ["doc_id"], "crop").select("doc_id", F.array_join("major_crops", ",").alias("crops"))


# --- bulletins ----------------------------------------------------------------------------

VIEW_SQL["v_bulletin"] = """SELECT doc_id, pos, CASE WHEN pos = 0 THEN 'Agromet Advisory for ' || upper(source) || ' District of state' WHEN pos % 9 = 4 THEN 'CROP ' || CAST(pos % 2 AS VARCHAR) || ' (' || source || ')' WHEN pos % 9 = 1 THEN 'Date : ' || CAST(pos AS VARCHAR)
  WHEN pos % 9 = 2 THEN 'Rainfall(mm) max' WHEN pos % 9 = 3 THEN CAST(pos AS VARCHAR) || ' 31.5 22 a b c' WHEN pos % 9 = 7 THEN 'Thunderstorm and lightening ' || line WHEN pos % 9 = 8 THEN 'strong surface winds ' || line
  ELSE ' • ' || line END AS line FROM v_lines"""


def bulletin(spark, sf):
    pos = F.col("pos")
    line = (
        F.when(pos == 0, F.concat(F.lit("Agromet Advisory for "), F.upper("source"), F.lit(" District of state")))
        .when(pos % 9 == 4, F.concat(F.lit("CROP "), (pos % 2).cast("string"), F.lit(" ("), "source", F.lit(")")))
        .when(pos % 9 == 1, F.concat(F.lit("Date : "), pos.cast("string")))
        .when(pos % 9 == 2, "Rainfall(mm) max")
        .when(pos % 9 == 3, F.concat(pos.cast("string"), F.lit(" 31.5 22 a b c")))
        .when(pos % 9 == 7, F.concat(F.lit("Thunderstorm and lightening "), "line"))
        .when(pos % 9 == 8, F.concat(F.lit("strong surface winds "), "line"))
        .otherwise(F.concat(F.lit(" • "), "line"))
    )
    return v.lines(spark, sf).select("doc_id", "pos", line.alias("line"))


@query("pf29_warning_tags", """SELECT doc_id, tag, count(*) AS n FROM (SELECT doc_id, CASE WHEN contains(line, 'Thunderstorm') THEN 'thunderstorm' WHEN contains(line, 'lightening') THEN 'lightning'
   WHEN contains(line, 'strong surface winds') THEN 'strong_surface_winds' END AS tag FROM v_bulletin) WHERE tag IS NOT NULL GROUP BY ALL""")
def pf29(spark, sf):
    return bulletin(spark, sf).select("doc_id", extract.warning_tag(F.col("line")).alias("tag")).where("tag is not null").groupBy("doc_id", "tag").agg(F.count("*").alias("n"))


@query("wn10_section_lines", """WITH m AS (SELECT *, last_value(CASE WHEN contains(line, 'CROP') AND contains(line, '(') AND contains(line, ')') THEN trim(line) END IGNORE NULLS) OVER w AS section,
     last_value(CASE WHEN contains(line, 'CROP') AND contains(line, '(') AND contains(line, ')') THEN pos END IGNORE NULLS) OVER w AS sp FROM v_bulletin WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
   i AS (SELECT * FROM m WHERE starts_with(trim(line), '•') AND section IS NOT NULL)
   SELECT i.doc_id, i.section, i.pos, trim(i.line) AS item FROM i JOIN (SELECT doc_id, section, max(sp) AS sp FROM i GROUP BY ALL) l ON l.doc_id = i.doc_id AND l.section = i.section AND l.sp = i.sp""")
def wn10(spark, sf):
    line = F.col("line")
    return extract.section_lines(bulletin(spark, sf), "doc_id", "pos", "line", extract.is_crop_header(line), extract.is_bullet_line(line))


@query("wn11_lines_after_header", """SELECT h.doc_id, h.pos AS header_pos, b.pos, TRY_CAST(split_part(b.line, ' ', 1) AS DOUBLE) AS rainfall, 31.5 AS max_temp, 22 AS min_temp FROM v_bulletin h JOIN v_bulletin b ON b.doc_id = h.doc_id
   AND b.pos BETWEEN h.pos + 1 AND h.pos + 5 WHERE contains(h.line, 'Rainfall(mm)') AND b.pos % 9 = 3""")
def wn11(spark, sf):
    return extract.lines_after(bulletin(spark, sf), "doc_id", "pos", "line", F.contains("line", F.lit("Rainfall(mm)")))


@query("ex6_bulletin_heads", """SELECT doc_id, max(CASE WHEN pos = 0 THEN upper(source) END) AS district, CAST(max(CASE WHEN pos % 9 = 1 THEN pos END) AS VARCHAR) AS date FROM v_lines GROUP BY doc_id""")
def ex6(spark, sf):
    return extract.bulletin_heads(bulletin(spark, sf), "doc_id", "pos", "line")


_INDEX_SLUG = "trim(regexp_replace(lower(regexp_replace(strip_accents(state || '_' || district), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', '_', 'g'), '_')"


@query("ex7_manifest_from_index", f"""WITH l AS (SELECT page_id, pos, regexp_extract(url, 'example\\.com/([^/]+)/', 1) AS state,
    trim(trim(regexp_replace(replace(text, '|', ' '), '\\s+', ' ', 'g')), ' -–') AS district, regexp_extract(url, '^[a-z]+://[^/?#]*') || href AS href FROM v_links WHERE text <> '')
  SELECT state, district, {_INDEX_SLUG} || '.pdf' AS filename, href AS source_url, '' AS sha256, 'new' AS origin FROM (
    SELECT *, row_number() OVER (PARTITION BY lower(state), lower(district) ORDER BY page_id, pos) AS n FROM l WHERE length(district) >= 2) WHERE n = 1""")
def ex7(spark, sf):
    pages = v.table(spark, sf, "pages")
    links = documents.page_links(pages, ["page_id", "url"], "html", suffix=None)
    rows = links.select(
        F.regexp_extract("url", r"example\.com/([^/]+)/", 1).alias("state"), text.anchor_text(F.col("text")).alias("district"),
        text.absolute_url(F.col("url"), F.col("href")).alias("href"), F.struct("page_id", "pos").alias("pos"),
    )
    rows = rows.withColumn("filename", F.concat(text.ascii_slug(F.concat_ws("_", "state", "district")), F.lit(".pdf")))
    empty = rows.where("false").select("state", "district", "filename", F.lit("").alias("source_url"), F.lit("").alias("sha256"))
    return documents.build_manifest(rows, empty)


# --- pixels ---------------------------------------------------------------------------------

def scale_sql(keys, steps, i):
    first, last = keys[0][0], keys[-1][0]
    val = f"({first}::DOUBLE + ({last - first}::DOUBLE * {i}) / {steps})"
    out = []
    for ch in (1, 2, 3):
        whens = []
        for lo, hi in zip(keys, keys[1:]):
            frac = f"(({val} - {lo[0]}::DOUBLE) / {hi[0] - lo[0]}::DOUBLE)"
            whens.append(f"WHEN {val} >= {lo[0]} AND {val} <= {hi[0]} THEN CAST(trunc({lo[ch]} + {frac} * {hi[ch] - lo[ch]}) AS INT)")
        out.append("CASE " + " ".join(whens) + " END")
    return val, out


_RV, _RC = scale_sql(raster.RAIN_KEYS, raster.RAIN_STEPS, "i")
_TV, _TC = scale_sql(raster.TMAX_KEYS, raster.TMAX_STEPS, "i")
VIEW_SQL["v_rain_scale"] = f"SELECT i, {_RV} AS val, {_RC[0]} AS r, {_RC[1]} AS g, {_RC[2]} AS b FROM range(0, {raster.RAIN_STEPS + 1}) t(i)"


@query("fn18_dense_scale", f"""SELECT p_partkey AS k, round({_RV}, 4) AS rain, {_RC[0]} AS rain_r, {_RC[1]} AS rain_g, {_RC[2]} AS rain_b, round({_TV}, 4) AS tmax, {_TC[0]} AS tmax_r, {_TC[1]} AS tmax_g, {_TC[2]} AS tmax_b
   FROM (SELECT p_partkey, p_partkey % 241 AS i FROM part)""")
def fn18(spark, sf):
    i = F.col("p_partkey") % 241
    rain, tmax = raster.scale_colour(i, raster.RAIN_KEYS, raster.RAIN_STEPS), raster.scale_colour(i, raster.TMAX_KEYS, raster.TMAX_STEPS)
    out = v.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), rain.alias("a"), tmax.alias("b"))
    cols = [F.round("a.value", 4).alias("rain"), F.round("b.value", 4).alias("tmax")]
    cols += [F.col(f"{s}.{c}").alias(f"{n}_{c}") for s, n in (("a", "rain"), ("b", "tmax")) for c in "rgb"]
    return out.select("k", *cols)


@query("jn14_nearest_colour", """SELECT x, y, round(val, 1) AS value FROM (SELECT p.x, p.y, s.val, row_number() OVER (PARTITION BY p.x, p.y ORDER BY (p.r - s.r) * (p.r - s.r) + (p.g - s.g) * (p.g - s.g) + (p.b - s.b) * (p.b - s.b), s.i) AS rn
   FROM v_pixels p, v_rain_scale s) WHERE rn = 1""")
def jn14(spark, sf):
    return raster.colours_to_values(v.pixels(spark, sf), raster.RAIN_KEYS, raster.RAIN_STEPS).select("x", "y", F.round("value", 1).alias("value"))


@query("pf27_black_pixels", "SELECT y, count_if(r < 100 AND g < 100 AND b < 100)::BIGINT AS n_black FROM v_pixels GROUP BY y")
def pf27(spark, sf):
    return v.pixels(spark, sf).groupBy("y").agg(F.count_if(raster.is_black(100)).alias("n_black"))


@query("wn16_nearest_clear_pixel", """WITH t AS (SELECT x, y, r, g, b, r < 120 AND g < 120 AND b < 120 AS dark FROM v_pixels),
   n AS (SELECT a.x, a.y, c.r, c.g, c.b, row_number() OVER (PARTITION BY a.x, a.y ORDER BY greatest(abs(c.x - a.x), abs(c.y - a.y)), (c.x - a.x) * (c.x - a.x) + (c.y - a.y) * (c.y - a.y), c.y - a.y, c.x - a.x) AS rn
     FROM t a JOIN t c ON NOT c.dark AND abs(c.x - a.x) <= 11 AND abs(c.y - a.y) <= 11 WHERE a.dark)
   SELECT x, y, r, g, b FROM t WHERE NOT dark UNION ALL SELECT x, y, r, g, b FROM n WHERE rn = 1
   UNION ALL SELECT x, y, 255, 255, 255 FROM t WHERE dark AND NOT EXISTS (SELECT 1 FROM n WHERE n.x = t.x AND n.y = t.y)""")
def wn16(spark, sf):
    px = v.pixels(spark, sf).withColumn("image_id", F.lit("a"))
    targets = px.select(F.struct("x", "y").alias("id"), "image_id", "x", "y")
    return raster.nearest_clear_pixel(targets, stage(raster.tiles_of(px), "tiles"), 2, black=120).select("x", "y", "r", "g", "b")


VIEW_SQL["v_map"] = """SELECT img, (idx % 250)::INT AS x, y::INT AS y, CASE WHEN ink THEN 0 ELSE (idx * 37) % 256 END AS r, CASE WHEN ink THEN 0 ELSE (idx * 59) % 256 END AS g, CASE WHEN ink THEN 0 ELSE 90 + (idx * 83) % 160 END AS b
  FROM (SELECT idx, 'map' || ((idx // 250) % 4) AS img, idx // 1000 AS y, (idx % 250) IN (12, 115, 130, 235) OR (idx // 1000) % 60 IN (32, 55) AS ink FROM (SELECT (l_orderkey * 7 + l_linenumber - 1) // 2 AS idx FROM lineitem GROUP BY 1))"""


def map_pixels(spark, sf):
    """Pixels of four images of 250 columns; scan lines go to them in turn."""
    idx = v.table(spark, sf, "lineitem").select(F.floor((F.col("l_orderkey") * 7 + F.col("l_linenumber") - 1) / 2).alias("idx")).distinct()
    line = F.floor(F.col("idx") / 250)
    x, y = F.col("idx") % 250, F.floor(F.col("idx") / 1000)
    ink = x.isin(12, 115, 130, 235) | (y % 60).isin(32, 55)
    return idx.select(
        F.concat(F.lit("map"), (line % 4).cast("string")).alias("image_id"), x.cast("int").alias("x"), y.cast("int").alias("y"),
        F.when(ink, 0).otherwise((F.col("idx") * 37) % 256).cast("int").alias("r"), F.when(ink, 0).otherwise((F.col("idx") * 59) % 256).cast("int").alias("g"),
        F.when(ink, 0).otherwise(90 + (F.col("idx") * 83) % 160).cast("int").alias("b"),
    )


def map_store(spark, sf):
    """The images as stored tiles, their sizes, and the panels found in them."""
    tiles = stage(raster.tiles_of(map_pixels(spark, sf)), "map-tiles")
    sizes = stage(raster.image_sizes(tiles), "map-sizes")
    return tiles, sizes, stage(raster.panel_bounds(raster.pixels_in(tiles), sizes), "map-panels")


def map_places(spark, sf):
    """Every cell is read in one of the images."""
    image = F.concat(F.lit("map"), (F.col("cell") % 4).cast("string"))
    return v.cells(spark, sf).select(F.col("state"), F.col("cell").cast("string").alias("district"), "lat", "lon", image.alias("image_id"))


VIEW_SQL["v_map_height"] = "SELECT img, max(y) + 1 AS h FROM v_map GROUP BY img"
VIEW_SQL["v_panel_px"] = """SELECT *, CASE WHEN NOT rgt AND NOT low THEN 1 WHEN rgt AND NOT low THEN 2 WHEN low AND NOT rgt THEN 3 ELSE 4 END AS panel FROM (
  SELECT m.*, x >= 125 AS rgt, y >= h // 2 AS low, h FROM v_map m JOIN v_map_height USING (img)) WHERE x >= 10 AND y >= 30 AND (NOT rgt OR x < 240) AND (NOT low OR y < h - 10)"""
VIEW_SQL["v_panel_box"] = """WITH a AS (SELECT img, panel, min(x) AS x0, max(x) AS x1 FROM (SELECT img, panel, x, count_if(r < 10 AND g < 10 AND b < 10) AS n, any_value(CASE WHEN panel <= 2 THEN h // 2 - 30 ELSE h - 10 - h // 2 END) AS s FROM v_panel_px GROUP BY ALL) WHERE n > s * 0.5 GROUP BY img, panel),
  b AS (SELECT img, panel, min(y) AS y0, max(y) AS y1 FROM (SELECT img, panel, y, count_if(r < 10 AND g < 10 AND b < 10) AS n, 115 AS s FROM v_panel_px GROUP BY ALL) WHERE n > s * 0.5 GROUP BY img, panel)
  SELECT a.*, b.y0, b.y1 FROM a JOIN b USING (img, panel)"""
VIEW_SQL["v_panels"] = """SELECT p.img, p.panel, p.x0, p.y0, CASE WHEN p.x1 - p.x0 >= 100 THEN p.x1 ELSE p.x0 + s.x1 - s.x0 END AS x1, p.y1, p.x1 - p.x0 < 100 AS repaired FROM v_panel_box p
   LEFT JOIN v_panel_box s ON s.img = p.img AND s.panel = p.panel - 2 AND s.x1 - s.x0 >= 100 WHERE p.x1 - p.x0 >= 100 OR s.panel IS NOT NULL"""


@query("ag30_panel_bounds", "SELECT img AS image_id, panel, x0, y0, x1, y1, repaired FROM v_panels")
def ag30(spark, sf):
    return map_store(spark, sf)[2]


def map_read(spark, sf):
    tiles, sizes, panels = map_store(spark, sf)
    return raster.read_map(map_places(spark, sf), tiles, panels, sizes)


_DARK = " AND ".join(f"{c} < {raster.BORDER_BLACK}" for c in "rgb")
_D = {axis: f"(c.{axis} - a.{axis})" for axis in "xy"}
VIEW_SQL["v_spots"] = """SELECT state, CAST(cell AS VARCHAR) AS district, img, panel, CAST(trunc(x0 + 36 + (lon - 70.0) * (201 / 28.0::DOUBLE)) AS INT) AS x,
    CAST(trunc(y0 + 26 + (35.0 - lat) * (257 / 30.0::DOUBLE)) AS INT) AS y FROM v_cells JOIN v_panels ON img = 'map' || (cell % 4)"""
VIEW_SQL["v_map_read"] = f"""WITH px AS (SELECT *, {_DARK} AS dark FROM v_map),
  targets AS (SELECT DISTINCT p.img, p.x, p.y, p.r, p.g, p.b, dark FROM v_spots s JOIN px p ON p.img = s.img AND p.x = s.x AND p.y = s.y),
  near AS (SELECT a.img, a.x, a.y, c.r, c.g, c.b, row_number() OVER (PARTITION BY a.img, a.x, a.y ORDER BY greatest(abs{_D['x']}, abs{_D['y']}), {_D['x']} * {_D['x']} + {_D['y']} * {_D['y']}, {_D['y']}, {_D['x']}) AS n
    FROM targets a JOIN px c ON c.img = a.img AND abs{_D['x']} <= 12 AND abs{_D['y']} <= 12 WHERE a.dark AND NOT c.dark),
  seen AS (SELECT t.img, t.x, t.y, CASE WHEN dark THEN coalesce(near.r, 255) ELSE t.r END AS r, CASE WHEN dark THEN coalesce(near.g, 255) ELSE t.g END AS g, CASE WHEN dark THEN coalesce(near.b, 255) ELSE t.b END AS b
    FROM targets t LEFT JOIN near ON near.img = t.img AND near.x = t.x AND near.y = t.y AND n = 1),
  scaled AS (SELECT r, g, b, first(val ORDER BY (p.r - s.sr) * (p.r - s.sr) + (p.g - s.sg) * (p.g - s.sg) + (p.b - s.sb) * (p.b - s.sb), i) AS val
    FROM (SELECT DISTINCT r, g, b FROM seen) p, (SELECT i, val, r AS sr, g AS sg, b AS sb FROM v_rain_scale) s GROUP BY r, g, b)
  SELECT state, district, s.img AS image_id, panel, s.x, s.y, round(val, 1) AS value,
    CASE WHEN val IS NULL THEN 'UNKNOWN' WHEN val >= 3 THEN 'above_normal' WHEN val <= -3 THEN 'below_normal' ELSE 'near_normal' END AS signal,
    coalesce('(' || r || ',' || g || ',' || b || ')', 'OUT_OF_BOUNDS') AS rgb
  FROM v_spots s LEFT JOIN (SELECT * FROM seen JOIN scaled USING (r, g, b)) k ON k.img = s.img AND k.x = s.x AND k.y = s.y"""


@query("ex5_map_reading", "SELECT * FROM v_map_read")
def ex5(spark, sf):
    return map_read(spark, sf)


@query("pf28_out_of_bounds", """SELECT district, panel, x < 0 OR x >= w OR y < 0 OR y >= h AS out_of_bounds FROM v_spots JOIN (SELECT img, max(x) + 1 AS w, max(y) + 1 AS h FROM v_map GROUP BY img) USING (img)""")
def pf28(spark, sf):
    _, sizes, panels = map_store(spark, sf)
    return raster.map_spots(map_places(spark, sf), panels, sizes).select("district", "panel", (~F.col("on")).alias("out_of_bounds"))


@query("rs5_panels_to_wide", "SELECT state, district, image_id, " + ", ".join(
    f"max(CASE WHEN panel = {w} THEN {c} END) AS week{w}_{c}" for w in (1, 2, 3, 4) for c in ("rgb", "value", "signal")) + " FROM v_map_read GROUP BY ALL")
def rs5(spark, sf):
    return raster.panels_to_wide(map_read(spark, sf))
