"""Contingency tables and bulletins to action rows.

Input is a cell table ``doc_id, page, table, row, col, text`` (text nullable) or a
line table. Cells are gathered once to table rows that hold them as an array, with
what the predicates say of each; a table's analysis is an expression over its first
rows, and everything that depends on row order goes through block-wise carry-forward,
so a very long table is never gathered into one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.functions.text import BULLETS, CELL_TRIM, squeeze, squeeze_lower
from skyfold.operators.dedup import let
from skyfold.operators.ordered import BLOCK, carry_forward, keep_first
from skyfold.session import stage as staged

# Phrases, labels and patterns of the plan tables.
SCENARIO_PHRASES = {
    "excess_rainfall_waterlogging": (
        "flood", "water logging", "waterlogging", "high rainfall", "heavy rain", "excess rain",
    ),
    "early_season_dry_spell": (
        "delay by 4", "delay by 6", "delay by 8", "early season", "delayed onset", "dry spell", "normal onset",
    ),
}
PLAN_SCENARIOS = (
    "delayed_monsoon", "early_season_dry_spell", "mid_season_break", "terminal_drought", "excess_rainfall_waterlogging",
)
HEADER_LABELS = (
    "condition", "suggested contingency measures", "major farming situation",
    "normal crop / cropping system", "normal crop/cropping system",
    "normal crop / cropping systems", "change in crop / cropping system",
    "change in crop/cropping system", "change in crop / cropping system including variety",
    "change in crop/cropping system including variety", "crop management",
    "agronomic measures", "soil nutrient & moisture conservation measures",
    "soil nutrient & moisture conservation measues", "remarks on implementation",
    "remarks on implementati on", "crop maturity stage", "post harvest",
    "reproductive stage", "at harvest", "vegetative stage",
    "grand growth stage", "formative phase", "formative stage",
    "maturity stage", "nursery stage", "flowering stage",
    "seedling stage",
)
PLACEHOLDERS = (
    "na", "n.a", "n.a.", "nil", "none", "not applicable", "notapplicable",
    "no change", "nochange", "no change in cropping system", "not required",
    "no need of contingency", "not applicable-", "-", "--",
)
DITTOS = ("do", "-do-", "do-", "-do", "as above", "same as above", "ditto", "as above-", "same as previous")
HEADER_HINTS = (
    "condition", "contingency measures", "contingency measure", "farming situation", "change in",
    "crop management", "agronomic", "soil management", "soil nutrient", "moisture conservation", "remarks on",
)
STAGE_KEYS = (
    "seedling", "nursery stage", "vegetative stage", "flowering stage", "crop maturity", "maturity stage",
    "post harvest", "reproductive stage", "at harvest",
)
AGRO_HINTS = ("agronomic", "soil nutrient", "soil management", "moisture conservation")
HEADER_DEPTH, HEADER_CELL_MAX, FRAGMENT_MAX = 5, 60, 25
ENUMERATOR = r"(?:\d{1,2}|i{1,3}|iv|vi{0,3}|v)[.)](?:\s+(?=[A-Za-z])|(?=[A-Z]))"
# a bullet anywhere, or an enumerator at the start of a piece or after a space
BREAK = rf"[{BULLETS}]|(?=[\div])(?:(?<=^)|(?<=[\s{BULLETS}])){ENUMERATOR}"
# what every enumerator has: few texts do, and the others need no search for one
_MAY_ENUMERATE = r"[.)](?<=[\div][.)])[\sA-Z]"
LIVESTOCK = (
    r"(?i)\b(cattle|cow|buffalo|poultry|goat|sheep|livestock|fodder|feed ingredient|birds|fish|pig|camel|donkey|animal|"
    r"grazing|breed|vaccin|deworm|shed|piggery|fishery|duck|hen|chick|hatch|milch|calving|lamb|kid\b|ewe)\b"
)
WARNINGS = (("Thunderstorm", "thunderstorm"), ("lightening", "lightning"), ("strong surface winds", "strong_surface_winds"))
TABLE = ["doc_id", "page", "table"]
# a table's header has one of these words or it is neither of measures nor of stages
HEADER_WORDS = ("change", "management", "agronomic", "soil", "moisture", "seedling", "nursery", "vegetative", "flowering", "maturity", "harvest", "reproductive")
_HEADER_WORD = "(?i)" + "|".join(HEADER_WORDS)


def _has(c: Column, phrases: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for p in phrases:
        hit = hit | F.contains(c, F.lit(p))
    return hit


# --- cell predicates --------------------------------------------------------

def scenario_of(low: Column) -> Column:
    """Scenario named by a squeezed lower-case text; first matching rule, else null."""
    return (
        F.when(F.contains(low, F.lit("terminal")), "terminal_drought")
        .when(_has(low, ("mid season", "mid-season")), "mid_season_break")
        .when(_has(low, SCENARIO_PHRASES["excess_rainfall_waterlogging"]), "excess_rainfall_waterlogging")
        .when(_has(low, ("delay by 2",)) | (_has(low, ("delayed onset",)) & _has(low, ("2 week",))), "delayed_monsoon")
        .when(_has(low, SCENARIO_PHRASES["early_season_dry_spell"]), "early_season_dry_spell")
    )


def condition_scenario(text: Column) -> Column:
    """Scenario named by a condition text; first matching rule, else null."""
    return scenario_of(squeeze_lower(text))


def is_label(low: Column) -> Column:
    """Known header, also with a stray footnote letter at the end. Expects squeezed lower-case text."""
    return low.isin(*HEADER_LABELS) | F.substring(low, F.lit(1), F.length(low) - 1).isin(*HEADER_LABELS)


def is_header_label(text: Column) -> Column:
    return let(squeeze_lower(text), is_label)


def is_placeholder(text: Column) -> Column:
    return F.trim(squeeze_lower(text), F.lit(CELL_TRIM)).isin(*PLACEHOLDERS)


def is_ditto(text: Column) -> Column:
    return F.trim(squeeze_lower(text), F.lit(CELL_TRIM)).isin(*DITTOS)


def is_valid_action(piece: Column) -> Column:
    """Not a header, not a short lower-case tail of another cell, and carries a word. Expects squeezed text."""
    short = F.length(piece) - F.length(F.replace(piece, F.lit(" "))) < 8  # fewer than nine words
    tail = short & piece.rlike("^[^A-Za-z]*[a-z]")
    return (F.length(piece) >= 4) & piece.rlike("[A-Za-z]{3}") & ~tail & ~is_label(F.lower(piece))


def is_livestock(action: Column) -> Column:
    return action.rlike(LIVESTOCK)


def _pieces(text: Column) -> Column:
    """A text cut at its bullets and enumerators."""
    even = reduce(lambda c, b: F.replace(c, F.lit(b), F.lit(BULLETS[0])), BULLETS[1:], text)
    return F.when(text.rlike(_MAY_ENUMERATE), F.split(text, BREAK)).when(_has(text, tuple(BULLETS)), F.split(even, BULLETS[0])).otherwise(F.array(text))


def explode_actions(df: DataFrame, cell: str, header: str | None = None, squeezed: bool = False) -> DataFrame:
    """Candidate actions of a cell: split on bullets and enumerators, one row each.

    Invalid pieces and short ones that only repeat the column's own header drop
    out. Pieces become rows before they are tested, so the tests stay in
    generated code. ``squeezed`` says that the cells are squeezed already.
    """
    plain = df.withColumn("_cell", F.col(cell) if squeezed else squeeze(F.col(cell)))
    cut = _pieces(F.col("_cell"))
    pieces = plain.select("*", F.posexplode(cut).alias("piece", "_raw")).withColumn("action", F.trim("_raw")).drop("_raw", "_cell")
    pieces = pieces.where(is_valid_action(F.col("action")))
    if header is None:
        return pieces
    low = F.lower("action")
    own = (F.length(low) < HEADER_CELL_MAX) & (F.col(header) != "") & F.contains(F.col(header), low)
    return pieces.where(~own)


# --- table rows and their analysis --------------------------------------------

def table_rows(cells: DataFrame) -> DataFrame:
    """One row for each table row, its cells an array of (col, text, scenario) in order: text squeezed, the scenario it names.

    ``may`` tells whether one of a table's first rows holds a header word.
    """
    plain = cells.select(*TABLE, "row", F.col("col").cast("int").alias("col"), squeeze(F.col("text")).alias("_t"))
    known = plain.select(*TABLE, "row", "col", "_t", F.lower("_t").alias("_low"))
    cell = F.struct("col", F.col("_t").alias("text"), F.when(F.col("_t") != "", scenario_of(F.col("_low"))).alias("scenario"))
    may = (F.col("row") < HEADER_DEPTH) & _has(F.col("_low"), HEADER_WORDS)
    return known.groupBy(*TABLE, "row").agg(F.sort_array(F.collect_list(cell)).alias("cells"), F.bool_or(may).alias("may"))


def cell_at(cells: Column, col: Column) -> Column:
    """The cell of a column, null where the row has none."""
    return F.get(F.filter(cells, lambda c: c["col"] == col), F.lit(0))


def _row_features(head: Column) -> Column:
    """What the header scan needs of one of a table's first rows."""
    cells = head["cells"]
    label = F.filter(cells, lambda c: (c["text"] != "") & (F.length(c["text"]) < HEADER_CELL_MAX) & ~_has(c["text"], tuple(BULLETS)))
    labels = F.lower(F.array_join(F.transform(label, lambda c: c["text"]), " "))

    def described(low: Column, cond: Column) -> Column:
        longest = F.array_max(F.transform(cells, lambda c: F.length(c["text"])))
        fragment = F.exists(cells, lambda c: c["text"] != "") & ~cond & (longest < FRAGMENT_MAX)
        sub = _has(low, HEADER_HINTS[1:] + STAGE_KEYS)
        hint = sub | F.contains(low, F.lit(HEADER_HINTS[0]))
        return F.struct(head["row"].alias("row"), cond.alias("cond"), sub.alias("sub"), hint.alias("hint"), fragment.alias("fragment"))

    # many phrases are looked for in the labels, which are joined once
    named = F.exists(cells, lambda c: c["scenario"].isNotNull())
    return let(labels, lambda low: let(named, lambda cond: described(low, cond)))


def _column_profile(head: Column) -> Column:
    """Role and growth stage of a column from its joined header text."""
    h = head["header"]
    crop = F.contains(h, F.lit("crop"))
    role = (
        F.when((F.contains(h, F.lit("change in")) & crop) | F.contains(h, F.lit("crop management")), "change")
        .when(_has(h, AGRO_HINTS), "agro")
        .when(F.contains(h, F.lit("remarks")), "remarks")
        .when(crop & F.contains(h, F.lit("system")), "normal")
        .when(F.contains(h, F.lit("farming situation")), "farming")
        .when(F.contains(h, F.lit("condition")), "condition")
    )
    stage = reduce(lambda expr, key: expr.when(F.contains(h, F.lit(key)), key), STAGE_KEYS[1:], F.when(F.contains(h, F.lit(STAGE_KEYS[0])), STAGE_KEYS[0]))
    return F.struct(head["col"].alias("col"), h.alias("header"), role.alias("role"), stage.alias("stage"))


def analyzed(rows: DataFrame) -> DataFrame:
    """Every table of three columns and two rows or more, with its ``analysis`` where its header is recognised.

    The analysis has kind (``measures`` or ``stages``), first data row, width, the sorted
    ``anchors`` (col, role), the table's scenario and the column headers. Only the first
    five rows are looked at.
    """
    head = F.when(F.col("row") < HEADER_DEPTH, F.struct(F.col("row").cast("int").alias("row"), "cells"))
    tables = rows.groupBy(*TABLE).agg(
        F.sort_array(F.collect_list(head)).alias("heads"), (F.max(F.element_at("cells", -1)["col"]) + 1).alias("ncols"), (F.max("row") + 1).alias("nrows"),
        F.bool_or(F.exists("cells", lambda c: c["scenario"].isNotNull())).alias("names_condition"),
        F.bool_or("may").alias("may"),
    ).where("ncols >= 3 and nrows >= 2")
    return tables.select(*TABLE, "ncols", "nrows", "names_condition", F.when(F.col("may"), _analysis()).alias("analysis"))


def _header_block(features: Column) -> Column:
    """(start, end) of the header and first data row: a scan of the first rows for the header, then fragments below it are taken in."""
    def state(start: Column, end: Column, done: bool) -> Column:
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(done).alias("done"))

    def scan(s: Column, r: Column) -> Column:
        return (
            F.when(s["done"], s)
            .when(r["cond"] & r["sub"], state(r["row"], r["row"] + 1, True))
            .when(r["cond"] & (s["start"] > 0), state(s["start"], s["end"], True))
            .when(r["cond"], state(s["start"], r["row"] + 1, False))
            .when(r["hint"], state(r["row"] + 1, r["row"] + 1, False))
            .otherwise(s)
        )

    def absorb(s: Column, r: Column) -> Column:
        return (
            F.when(s["done"] | (r["row"] < s["start"]), s)
            .when((r["row"] == s["start"]) & r["fragment"], state(s["start"] + 1, F.greatest(s["end"], s["start"] + 1), False))
            .otherwise(state(s["start"], s["end"], True))
        )

    zero = F.lit(0)
    scanned = F.aggregate(features, state(zero, zero, False), scan)
    return let(scanned, lambda found: F.when(found["end"] > 0, F.aggregate(features, state(found["start"], found["end"], False), absorb)))


def _analysis() -> Column:
    """Analysis of a table from ``heads`` and ``ncols``, null where its header is not recognised.

    Each step is bound once, so that the whole is one expression of plain size.
    """
    def columns(block: Column) -> Column:
        above = F.filter("heads", lambda h: h["row"] < block["end"])

        def header(col: Column) -> Column:
            texts = F.filter(F.transform(above, lambda h: cell_at(h["cells"], col)["text"]), lambda t: t != "")
            return F.struct(col.cast("int").alias("col"), F.lower(F.array_join(texts, " ")).alias("header"))

        return F.transform(F.transform(F.sequence(F.lit(0), F.col("ncols") - 1), header), _column_profile)

    def first_of_roles(cols: Column) -> Column:
        """The first column of each role."""
        with_role = F.filter(cols, lambda c: c["role"].isNotNull())
        return let(
            with_role,
            lambda held: F.transform(
                F.filter(held, lambda c, i: ~F.exists(F.slice(held, F.lit(1), i), lambda x: x["role"] == c["role"])),
                lambda c: F.struct(c["col"].alias("col"), c["role"].alias("role")),
            ),
        )

    def last_of_stages(cols: Column) -> Column:
        """The last column of each growth stage."""
        return F.transform(
            F.filter(cols, lambda c, i: ~F.exists(F.slice(cols, i + 2, F.size(cols)), lambda x: x["stage"] == c["stage"])),
            lambda c: F.struct(c["col"].alias("col"), F.concat(F.lit("stage:"), c["stage"]).alias("role")),
        )

    def stage_anchors(roles: Column, staged_cols: Column) -> Column:
        at = F.coalesce(F.get(F.filter(roles, lambda x: x["role"] == "condition"), F.lit(0))["col"], F.lit(0))

        def with_condition(col: Column) -> Column:
            own = last_of_stages(staged_cols)
            condition = F.array(F.struct(col.alias("col"), F.lit("condition").alias("role")))
            return F.when(F.exists(staged_cols, lambda c: c["col"] == col), own).otherwise(F.concat(own, condition))

        return let(at, with_condition)

    def described(block: Column, cols: Column, roles: Column, staged_cols: Column) -> Column:
        measures = F.exists(roles, lambda x: x["role"].isin("change", "agro"))
        headers = F.transform(cols, lambda c: c["header"])
        known = F.struct(
            F.when(measures, "measures").otherwise("stages").alias("kind"), block["start"].alias("data_start"), F.col("ncols"),
            F.array_sort(F.when(measures, roles).otherwise(stage_anchors(roles, staged_cols))).alias("anchors"),
            let(F.array_join(headers, " "), scenario_of).alias("table_scenario"), headers.alias("col_headers"),
        )
        return F.when(measures | (F.size(staged_cols) >= 2), known)

    def over(block: Column, cols: Column) -> Column:
        staged_cols = F.filter(cols, lambda c: c["stage"].isNotNull())
        return let(first_of_roles(cols), lambda roles: let(staged_cols, lambda held: described(block, cols, roles, held)))

    block = let(F.transform("heads", _row_features), _header_block)
    return let(block, lambda b: F.when(b.isNotNull(), let(columns(b), lambda cols: over(b, cols))))


def analyze_tables(cells: DataFrame) -> DataFrame:
    """Roles, first data row, table scenario and column headers of every matrix.

    Tables that are neither of measures nor of stages do not appear. Of the cells below a
    table's first rows only their places are looked at, so one aggregate finds all: their
    texts are neither gathered nor searched.
    """
    at = F.struct(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), squeeze(F.col("text")).alias("text"))
    first = cells.select(*TABLE, "row", "col", F.when(F.col("row") < HEADER_DEPTH, at).alias("_at"))
    tables = first.groupBy(*TABLE).agg(
        F.sort_array(F.collect_list("_at")).alias("_at"), (F.max("col").cast("int") + 1).alias("ncols"), (F.max("row") + 1).alias("nrows")
    ).where("ncols >= 3 and nrows >= 2")
    tables = tables.where(F.exists("_at", lambda c: c["text"].rlike(_HEADER_WORD)))

    def cell(c: Column) -> Column:
        named = F.when(c["text"] != "", scenario_of(F.lower(c["text"])))
        return F.struct(c["col"].alias("col"), c["text"].alias("text"), named.alias("scenario"))

    def of_row(row: Column) -> Column:
        return F.struct(row.alias("row"), F.transform(F.filter("_at", lambda c: c["row"] == row), cell).alias("cells"))

    heads = F.transform(F.array_distinct(F.transform("_at", lambda c: c["row"])), of_row)
    known = tables.select(*TABLE, "ncols", heads.alias("heads"))
    # a generator, not a filter, drops the tables without one: a filter would be pushed down and analyse twice
    return known.select(*TABLE, F.inline(F.array_compact(F.array(_analysis()))))


def nearest_role(anchors: Column, col: Column) -> Column:
    """Role and column of the closest header anchor, the left one on ties."""
    return F.array_min(
        F.transform(
            anchors,
            lambda a: F.struct(F.abs(a["col"] - col).alias("dist"), a["col"].alias("anchor"), a["role"].alias("role")),
        )
    )


def _anchor_col(role: str) -> Column:
    return F.expr(f"get(filter(anchors, x -> x.role = '{role}'), 0).col")


def usable_tables(rows: DataFrame) -> DataFrame:
    """Analysed tables of :func:`table_rows` plus header-less continuations of the last analysed one.

    A continuation has the same width and either two filled stage cells or one
    cell that names a condition. ``advice`` lists the columns that hold advice.
    """
    tables = staged(analyzed(rows), "plan-analysis")
    marked = carry_forward(tables.withColumn("own", F.col("analysis").isNotNull()), ["doc_id"], ["page", "table"], {"src": F.col("analysis")}, block=F.floor(F.col("page") / 1000))
    known = marked.where("src is not null and (own or ncols = src.ncols)").select(*TABLE, "own", "names_condition", "nrows", "src.*")
    # a stage continuation needs its cells counted; the other tables are decided already
    follow = known.where("not own and kind = 'stages'").select(*TABLE, "anchors")
    stage_cells = F.filter("cells", lambda c: (c["text"] != "") & F.startswith(nearest_role(F.col("anchors"), c["col"])["role"], F.lit("stage:")))
    filled = rows.join(follow, TABLE).groupBy(*TABLE).agg(F.sum(F.size(stage_cells)).alias("filled"))
    accepted = F.col("own") | F.when(F.col("kind") == "measures", F.col("names_condition")).otherwise(F.coalesce("filled", F.lit(0)) >= 2)
    return known.join(filled, TABLE, "left").where(accepted).select(
        *TABLE, "kind", "anchors", "ncols", "table_scenario", "col_headers",
        F.when(F.col("own"), F.col("data_start")).otherwise(0).alias("data_start"),
        F.coalesce(_anchor_col("condition"), F.lit(0)).alias("condition_col"),
        F.coalesce(
            _anchor_col("normal"), F.when(F.col("kind") == "stages", _anchor_col("condition"))
        ).alias("crop_col"),
        _anchor_col("farming").alias("farming_col"),
        advice_columns().alias("advice"), "nrows",
    )


def advice_columns() -> Column:
    """Columns of a table that hold advice as an array of (col, column, header): their place, role and header text."""
    def described(col: Column) -> Column:
        near = nearest_role(F.col("anchors"), col)
        own = F.coalesce(F.get("col_headers", col), F.lit(""))
        anchor = F.coalesce(F.get("col_headers", near["anchor"]), F.lit(""))
        header = (
            F.when(near["anchor"] == col, own)
            .when(near["anchor"] < col, F.concat_ws(" ", anchor, own))
            .otherwise(F.concat_ws(" ", own, anchor))
        )
        return F.struct(col.cast("int").alias("col"), near["role"].alias("column"), header.alias("header"))

    def advises(x: Column) -> Column:
        return ((F.col("kind") == "measures") & x["column"].isin("change", "agro")) | F.startswith(x["column"], F.lit("stage:"))

    return F.filter(F.transform(F.sequence(F.lit(0), F.col("ncols") - 1), described), advises)


# --- row walk -----------------------------------------------------------------

def fill_scenarios(rows: DataFrame, keys: list[str], named: str, table_level: Column) -> DataFrame:
    """Row scenario: its own, else the last one above, else the table's; other rows drop out."""
    out = carry_forward(rows, keys, "row", {"scenario": F.col(named)})
    return out.withColumn("scenario", F.coalesce("scenario", table_level)).where(F.col("scenario").isNotNull())


def fill_context(rows: DataFrame, keys: list[str], farming: str, crop: str) -> DataFrame:
    """Carry the farming situation and crop down; headers and condition texts do not count."""
    farm, crop_text = squeeze(F.col(farming)), squeeze(F.col(crop))
    return carry_forward(
        rows,
        keys,
        "row",
        {
            "farming_situation": F.when((farm != "") & ~is_header_label(farm), farm),
            "crop": F.when(
                (crop_text != "") & ~is_header_label(crop_text) & condition_scenario(crop_text).isNull(), crop_text
            ),
        },
    )


def walked_rows(rows: DataFrame, tables: DataFrame, block: int | None = BLOCK) -> DataFrame:
    """Body rows with scenario, farming situation, crop and their advice cells, carried down in one pass.

    Scenario as in :func:`fill_scenarios`; farming situation and crop as in
    :func:`fill_context`, from rows that have a scenario.
    """
    body = rows.join(tables.select(*TABLE, "data_start", "table_scenario", "condition_col", "crop_col", "farming_col", "advice"), TABLE)
    body = body.where(F.col("row") >= F.col("data_start"))
    named = F.get(F.filter("cells", lambda c: (c["col"] <= F.col("condition_col")) & c["scenario"].isNotNull()), F.lit(0))["scenario"]
    texts = F.transform("advice", lambda a: a.withField("text", cell_at(F.col("cells"), a["col"])["text"]))
    body = body.select(
        *TABLE, "row", "table_scenario", named.alias("named"), cell_at(F.col("cells"), F.col("farming_col")).alias("_farm"),
        cell_at(F.col("cells"), F.col("crop_col")).alias("_crop"), F.filter(texts, lambda a: a["text"] != "").alias("advice"),
    )

    def counts(cell: str) -> Column:
        return (F.col(f"{cell}.text") != "") & ~is_label(F.lower(f"{cell}.text"))

    def told(cell: str, when: Column) -> Column:
        return F.when(when, F.struct("row", F.col(f"{cell}.text").alias("text")))

    carried = carry_forward(
        body.withColumn("_named", F.col("named")), TABLE, "row",
        {"named": F.col("_named"), "_farm": told("_farm", counts("_farm")), "_crop": told("_crop", counts("_crop") & F.col("_crop.scenario").isNull())},
        block=block, firsts={"_since": F.when(F.col("_named").isNotNull(), F.col("row"))},
    )

    def since(c: str) -> Column:
        return F.when(F.col("table_scenario").isNotNull() | (F.col(f"{c}.row") >= F.col("_since")), F.col(f"{c}.text"))

    scenario = F.coalesce("named", "table_scenario")
    return carried.where(scenario.isNotNull()).select(
        *TABLE, "row", scenario.alias("scenario"), since("_farm").alias("farming_situation"), since("_crop").alias("crop"), "advice"
    )


def resolve_dittos(cells: DataFrame, keys: list[str], text: str, block: int | None = BLOCK, squeezed: bool = False) -> DataFrame:
    """Replace ditto cells by the last real text above in their column; none above drops the cell.

    ``squeezed`` says that the cells are squeezed already.
    """
    filled = cells.withColumn("_t", F.col(text) if squeezed else squeeze(F.col(text))).where(F.col("_t") != "")
    filled = filled.withColumn("resolved_from_ditto", F.trim(F.lower("_t"), F.lit(CELL_TRIM)).isin(*DITTOS))
    ditto = F.col("resolved_from_ditto")
    out = carry_forward(filled, keys, "row", {"_above": F.when(~ditto, F.col("_t"))}, include_current=False, block=block)
    return out.withColumn("resolved", F.when(ditto, F.col("_above")).otherwise(F.col("_t"))).where(F.col("resolved").isNotNull()).drop("_above", "_t")


def harvest(cells: DataFrame) -> DataFrame:
    """All action rows of all documents with their provenance.

    Cells are read once: table rows and usable tables are written to the shared folder,
    and the walk is one query over them. Tables are walked in blocks where one is longer
    than a block.
    """
    rows = staged(table_rows(cells), "plan-rows")
    tables = staged(usable_tables(rows), "plan-tables")
    block = BLOCK if (tables.agg(F.max("nrows")).first()[0] or 0) > BLOCK else None
    advice = walked_rows(rows, tables, block).select(*TABLE, "row", "scenario", "farming_situation", "crop", F.inline("advice"))
    texts = resolve_dittos(advice, [*TABLE, "col"], "text", block, squeezed=True)
    texts = texts.withColumn("placeholder", F.trim(F.lower("resolved"), F.lit(CELL_TRIM)).isin(*PLACEHOLDERS))
    pieces = explode_actions(texts, "resolved", "header", squeezed=True)
    low_crop, low_farm = F.lower(F.coalesce("crop", F.lit(""))), F.lower(F.coalesce("farming_situation", F.lit("")))
    first = keep_first(
        pieces.drop("text", "header"),
        [F.col("doc_id"), F.col("scenario"), F.lower("action"), low_crop, low_farm, F.col("column")],
        F.struct("page", "table", "row", "col", "piece"),
    )
    return first.select(
        "doc_id", "scenario", "action", "page", "table", "row", "col", "piece", "column", "crop", "farming_situation",
        "resolved_from_ditto", "placeholder",
    )


def contingency_rows(actions: DataFrame) -> DataFrame:
    """Extracted rows without placeholders, once per action, crop and situation, routed by kind."""
    kept = actions.where(~F.coalesce("placeholder", F.lit(False)))
    low = [F.lower(F.coalesce(c, F.lit(""))) for c in ("action", "crop", "farming_situation")]
    first = keep_first(kept, [F.col("doc_id"), F.col("scenario"), *low], F.struct("page", "table", "row", "col", "piece"))
    return first.withColumn("kind", F.when(is_livestock(F.col("action")), "livestock").otherwise("crop"))


def major_crops(actions: DataFrame, keys: list[str], crop: str, n: int = 10) -> DataFrame:
    """First ``n`` distinct crop names in order, cut at the first dash.

    Names are made distinct by aggregation and pruned per task before the shuffle.
    """
    from skyfold.operators.ordered import first_n

    name = F.trim(F.get(F.split(F.col(crop), "-"), F.lit(0)))
    distinct = actions.where(F.coalesce(crop, F.lit("")) != "").select(*keys, name.alias("_name")).distinct()
    top = first_n(distinct, keys, [F.col("_name")], n)
    return top.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "_name"))), lambda x: x["_name"]).alias("major_crops")
    )


def nest_contingency(rows: DataFrame) -> DataFrame:
    """Nested plan record per document; a plan's actions are one document's rows."""
    item = F.struct("page", "table", "row", "col", "piece", "action", "crop", "farming_situation")
    lists = rows.groupBy("doc_id", "scenario").agg(
        *[
            F.transform(
                F.sort_array(F.collect_list(F.when(F.col("kind") == kind, item))),
                lambda x: F.struct(x["action"].alias("action"), x["crop"].alias("crop"), x["farming_situation"].alias("farming_situation")),
            ).alias(f"{kind}_actions")
            for kind in ("crop", "livestock")
        ]
    )
    return lists.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("scenario", F.struct("crop_actions", "livestock_actions")))).alias("scenarios")
    )


# --- bulletins ------------------------------------------------------------------

def warning_tag(line: Column) -> Column:
    """First warning keyword of a line."""
    expr = None
    for phrase, tag in WARNINGS:
        hit = F.contains(line, F.lit(phrase))
        expr = F.when(hit, tag) if expr is None else expr.when(hit, tag)
    return expr


def section_lines(lines: DataFrame, key: str, pos: str, line: str, is_header: Column, is_item: Column) -> DataFrame:
    """Item lines with the last section header above them.

    A later section of the same name replaces an earlier one.
    """
    text = F.trim(F.col(line))
    marked = carry_forward(
        lines, [key], pos,
        {"section": F.when(is_header, text), "section_pos": F.when(is_header, F.col(pos))},
    )
    items = marked.where(is_item & F.col("section").isNotNull())
    last = items.groupBy(key, "section").agg(F.max("section_pos").alias("section_pos"))
    return items.join(last, [key, "section", "section_pos"]).select(key, "section", pos, text.alias("item"))


def is_crop_header(line: Column) -> Column:
    return F.contains(line, F.lit("CROP")) & F.contains(line, F.lit("(")) & F.contains(line, F.lit(")"))


def is_bullet_line(line: Column) -> Column:
    return F.startswith(F.trim(line), F.lit("•"))


def lines_after(lines: DataFrame, key: str, pos: str, line: str, is_header: Column, n: int = 5) -> DataFrame:
    """Numbers of the ``n`` lines after each header: six tokens at least, first three numeric.

    Header lines are few; each names the positions it covers and meets the lines by equality.
    """
    heads = lines.where(is_header).select(
        key, F.col(pos).alias("header_pos"), F.explode(F.sequence(F.col(pos) + 1, F.col(pos) + n)).alias(pos)
    )
    tokens = F.split(F.trim(F.col(line)), r"\s+")

    plain = [F.expr(f"try_cast(get(split(trim({line}), '\\\\s+'), {i}) as double)") for i in range(3)]
    hits = lines.join(heads, [key, pos]).where(F.size(tokens) >= 6)
    return hits.select(
        key, "header_pos", pos, *[c.alias(n_) for c, n_ in zip(plain, ("rainfall", "max_temp", "min_temp"))]
    ).where(F.col("rainfall").isNotNull() & F.col("max_temp").isNotNull() & F.col("min_temp").isNotNull())


def bulletin_heads(lines: DataFrame, key: str, pos: str, line: str) -> DataFrame:
    """District, and date of each bulletin; the last matching line wins."""
    title = F.contains(line, F.lit("District")) & F.contains(line, F.lit("Advisory"))
    words = F.regexp_extract_all(F.col(line), F.lit(r"(\S+)\s+District(?=\s|$)"), F.lit(1))
    named = F.when(title & (F.size(words) > 0), F.element_at(words, -1))
    dated = F.when(
        ~title & F.contains(line, F.lit("Date :")), F.trim(F.substring_index(F.substring_index(line, "Date :", 2), "Date :", -1))
    )
    return lines.groupBy(key).agg(
        F.max_by(named, F.when(named.isNotNull(), F.col(pos))).alias("district"),
        F.max_by(dated, F.when(dated.isNotNull(), F.col(pos))).alias("date"),
    )

