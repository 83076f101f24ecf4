"""Advisories for every district and user context at once.

A record and context is one row from beginning to end. What depends on a context alone
is settled in a guide of one row a context, what depends on a district alone in one row
a district; the lists are then put together, freed of repeats and capped by array
functions in the row.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.functions import labels
from skyfold.functions.signals import OUTLOOK_LABELS_EN, OUTLOOK_LABELS_HI, outlook_label, signed
from skyfold.functions.text import ACTION_TEMPLATES, ACTION_TEMPLATES_HI, action_id, any_phrase, replace_all, translate_label
from skyfold.operators import dedup, rules
from skyfold.operators.matching import catalog_lookup
from skyfold.session import stage

# Keyword lists, caps and sentences.
CROP_KEYWORDS = ("planting", "sowing", "crop", "fertilizer", "seed", "field operations")
SOWING_KEYWORDS = ("sow", "sowing", "planting", "seed bed", "nursery", "germination")
HARVEST_KEYWORDS = ("harvest", "threshing", "post-harvest", "storage of grain")
FLOWERING_KEYWORDS = ("flowering", "reproductive", "grain filling", "panicle")
EVERGREEN = (
    "stay updated with official", "monitor weather", "monitor imd", "monitor forecasts",
    "check local kvk", "official weather forecast", "check on elderly", "children, pregnant women",
    "people with health conditions", "keep basic heat illness response", "store drinking water",
    "identify shaded or cooler",
)
FORBIDDEN = (
    "monsoon will fail", "do not plant", "crop will fail", "official government advice", "medical advice",
)
CAPS = {"do_now": 12, "prepare": 8}
CATEGORIES = ("do_now", "prepare", "avoid", "general_guidance")
RAINFED_SCENARIOS = ("delayed_monsoon", "early_season_dry_spell", "mid_season_break", "terminal_drought")
IRRIGATED_SCENARIOS = ("delayed_monsoon", "early_season_dry_spell", "mid_season_break")
RAINFED_NOW = "Rainfed field: prioritize soil moisture conservation — mulching, weeding, and dust mulch"
RAINFED_PREPARE = "Without irrigation backup, plan for shorter-duration or drought-tolerant varieties if re-sowing is needed"
IRRIGATED_NOW = "Use irrigation strategically at critical crop stages — you have more flexibility than rainfed farmers"
BASE_GOOD = "Good moisture conditions expected this week — favorable for sowing or field operations"
BASE_RECOVERY = "Take advantage of rainfall for deficit recovery — conserve soil moisture where possible"
BASE_NORMAL = "Conditions are near normal — continue routine crop management and monitoring"
BASE_DRYING = "Rainfall outlook dries out over weeks 2-4 — conserve soil moisture and plan water use carefully"
BASE_DRYING_2 = "Check irrigation sources and repair water-harvesting structures"
BASE_DRYING_COMMUNITY = "Rainfall outlook dries out over weeks 2-4 — review community water sources"
BASE_WETTING = "Above-normal rainfall expected in coming weeks — ensure field drainage is clear"
BASE_WETTING_2 = "Plan pesticide/fungicide applications around expected wet spells"
BASE_MONITOR = "Monitor IMD forecasts and local KVK advisories for updates"
ACTIONS_HI = {
    BASE_GOOD: "इस सप्ताह मिट्टी में नमी की अच्छी स्थिति रहेगी — बुवाई या खेत के काम के लिए अनुकूल",
    BASE_NORMAL: "स्थितियाँ सामान्य के आसपास हैं — नियमित फसल प्रबंधन और निगरानी जारी रखें",
    BASE_MONITOR: "अपडेट के लिए IMD पूर्वानुमान और स्थानीय KVK सलाह देखते रहें",
    BASE_DRYING_2: "सिंचाई स्रोतों की जाँच करें और जल-संचयन संरचनाओं की मरम्मत करें",
    BASE_WETTING: "आने वाले सप्ताहों में सामान्य से अधिक वर्षा की संभावना है — खेत की जल निकासी साफ रखें",
    BASE_WETTING_2: "संभावित बारिश के दौर को ध्यान में रखकर कीटनाशक/फफूंदनाशक के उपयोग की योजना बनाएँ",
    RAINFED_NOW: "वर्षा आधारित खेत: मिट्टी की नमी बचाने को प्राथमिकता दें — मल्चिंग, निराई और धूल मल्च करें",
    RAINFED_PREPARE: "सिंचाई की सुविधा न होने पर दोबारा बुवाई की स्थिति में कम अवधि या सूखा-सहने वाली किस्मों की योजना बनाएँ",
    IRRIGATED_NOW: "फसल की महत्वपूर्ण अवस्थाओं में सिंचाई का रणनीतिक उपयोग करें — वर्षा आधारित किसानों की तुलना में आपके पास अधिक सुविधा है",
}
PHRASES_HI = {
    "Season-to-date rainfall is": "अब तक की मौसमी वर्षा",
    "below normal — prioritize moisture conservation": "सामान्य से कम है — नमी संरक्षण को प्राथमिकता दें",
    "Rainfall outlook dries out over weeks 2-4 —": "सप्ताह 2-4 में वर्षा कम होने की संभावना है —",
    "conserve soil moisture and plan water use carefully": "मिट्टी की नमी बचाएँ और पानी के उपयोग की सावधानीपूर्वक योजना बनाएँ",
}
DISCLAIMER = "Decision support only; check with the local extension office before acting."
RECORD_KEY = ["state", "district", "context_id"]


# --- sentences ------------------------------------------------------------

def _three(v: Column) -> Column:
    return F.when(v >= 3.0, "above normal").when(v <= -3.0, "below normal").otherwise("near normal")


def _all(weeks: tuple[Column, ...], test) -> Column:
    hit = F.lit(True)
    for w in weeks:
        hit = hit & test(w)
    return hit


def _pct(v: Column) -> Column:
    return F.abs(v).cast("string")


def summary_en() -> Column:
    """Season, outlook and heat in one sentence."""
    x = rules.inputs()
    first = (
        F.when(x.since_june < -20, F.concat(F.lit("Rainfall has been "), _pct(x.since_june), F.lit("% below normal since June 1")))
        .when(x.since_june > 20, F.concat(F.lit("Rainfall has been "), _pct(x.since_june), F.lit("% above normal since June 1")))
        .otherwise("Rainfall has been near normal since June 1")
    )
    this_week = F.concat(F.lit("this week's rainfall is "), _three(x.weeks[0]))
    second = (
        F.when(_all(x.weeks, lambda w: w <= -3.0), "the 4-week outlook shows persistently below-normal rainfall")
        .when(_all(x.weeks, lambda w: w >= 3.0), "the 4-week outlook shows sustained above-normal rainfall")
        .when(x.relief, F.concat(this_week, F.lit(" but the outlook improves over weeks 2-4")))
        .when(x.drying, F.concat(this_week, F.lit(" but the outlook dries out over weeks 2-4")))
        .otherwise(
            F.concat(
                F.lit("the 4-week rainfall outlook is mixed ("), _three(x.weeks[0]), F.lit(" this week, "),
                _three(x.weeks[3]), F.lit(" by week 4)"),
            )
        )
    )
    heat = F.when(x.heat_wave, "Heat stress is elevated with heat wave warnings in effect").when(
        x.tmax_above, "Above-normal temperatures are expected"
    )
    return F.concat(first, F.lit(", "), second, F.coalesce(F.concat(F.lit(", and "), heat), F.lit("")), F.lit("."))


def summary_hi() -> Column:
    x = rules.inputs()
    first = (
        F.when(x.since_june < -20, F.concat(F.lit("1 जून से वर्षा सामान्य से "), _pct(x.since_june), F.lit("% कम रही है")))
        .when(x.since_june > 20, F.concat(F.lit("1 जून से वर्षा सामान्य से "), _pct(x.since_june), F.lit("% अधिक रही है")))
        .otherwise("1 जून से वर्षा सामान्य के आसपास रही है")
    )
    second = (
        F.when(_all(x.weeks, lambda w: w <= -3.0), "4 सप्ताह के पूर्वानुमान में लगातार सामान्य से कम वर्षा दिख रही है")
        .when(_all(x.weeks, lambda w: w >= 3.0), "4 सप्ताह के पूर्वानुमान में लगातार सामान्य से अधिक वर्षा दिख रही है")
        .otherwise("4 सप्ताह का वर्षा पूर्वानुमान मिला-जुला है")
    )
    heat = F.when(x.heat_wave, "लू का खतरा बढ़ा हुआ है और लू की चेतावनी लागू है").when(
        x.tmax_above, "सामान्य से अधिक तापमान की संभावना है"
    )
    return F.concat(F.concat_ws("। ", first, second, heat), F.lit("।"))


def describe_later_weeks(labels: tuple[Column, Column, Column]) -> Column:
    """Phrase for weeks 2 to 4 with equal neighbours collapsed."""
    a, b, c = labels
    return (
        F.when((a == b) & (b == c), F.concat(a, F.lit(" rainfall throughout weeks 2-4")))
        .when(a == b, F.concat(a, F.lit(" in weeks 2-3, shifting to "), c, F.lit(" by week 4")))
        .when(b == c, F.concat(a, F.lit(" in week 2, then "), b, F.lit(" through weeks 3-4")))
        .otherwise(F.concat(a, F.lit(" in week 2, "), b, F.lit(" in week 3, "), c, F.lit(" by week 4")))
    )


def _capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))


def narrative_en() -> Column:
    x = rules.inputs()
    t = F.col("week1_tmax_anomaly_degC")
    labels = [outlook_label(w) for w in x.weeks]
    later = describe_later_weeks((labels[1], labels[2], labels[3]))
    this_week = F.concat(F.lit("This week: rainfall "), labels[0], F.lit(" ("), signed(x.weeks[0], 1), F.lit(" mm/day)"))
    course = (
        F.when(x.relief, F.concat(F.lit("Outlook improves — "), later, F.lit(". Some relief expected.")))
        .when(x.drying, F.concat(F.lit("Caution — while this week is "), labels[0], F.lit(", the outlook dries: "), later, F.lit(".")))
        .when(_all(x.weeks, lambda w: w <= -3.0), "Persistent dry conditions expected across all 4 weeks.")
        .when(_all(x.weeks, lambda w: w >= 3.0), "Sustained above-normal rainfall expected across all 4 weeks.")
        .otherwise(F.concat(_capitalised(later), F.lit(".")))
    )
    season = F.when(
        x.since_june <= -30,
        F.concat(F.lit("Season-to-date rainfall is "), _pct(x.since_june),
                 F.lit("% below normal — any above-normal rain is helpful for deficit recovery.")),
    ).when(
        x.since_june >= 20,
        F.concat(F.lit("Season-to-date rainfall is "), _pct(x.since_june),
                 F.lit("% above normal — additional heavy rain increases waterlogging risk.")),
    )
    heat = F.when(
        t >= 2.0, F.concat(F.lit("Temperatures are elevated ("), signed(t, 1), F.lit("°C above normal this week)."))
    ).when(
        t <= -2.0,
        F.concat(F.lit("Temperatures are cooler than normal ("), signed(t, 1), F.lit("°C this week), likely due to cloud cover.")),
    )
    return F.concat_ws(" ", this_week, course, season, heat)


def narrative_hi() -> Column:
    x = rules.inputs()
    t = F.col("week1_tmax_anomaly_degC")

    def label(v: Column) -> Column:
        return outlook_label(v, OUTLOOK_LABELS_HI)

    this_week = F.concat(F.lit("इस सप्ताह: वर्षा "), label(x.weeks[0]), F.lit(" ("), signed(x.weeks[0], 1), F.lit(" मिमी/दिन)"))
    course = (
        F.when(x.relief, "पूर्वानुमान में सुधार है; अगले सप्ताहों में कुछ राहत की उम्मीद है।")
        .when(x.drying, "सावधानी: आगे के सप्ताहों में वर्षा कम हो सकती है।")
        .when(_all(x.weeks, lambda w: w <= -3.0), "सभी 4 सप्ताह में लगातार सूखी स्थिति की संभावना है।")
        .when(_all(x.weeks, lambda w: w >= 3.0), "सभी 4 सप्ताह में लगातार सामान्य से अधिक वर्षा की संभावना है।")
        .otherwise(F.concat(F.lit("सप्ताह 2-4 में वर्षा "), label(x.later), F.lit(" रहने की संभावना है।")))
    )
    season = F.when(
        x.since_june <= -30,
        F.concat(F.lit("अब तक की वर्षा सामान्य से "), _pct(x.since_june), F.lit("% कम है; अधिक वर्षा से कमी की भरपाई में मदद मिलेगी।")),
    ).when(
        x.since_june >= 20,
        F.concat(F.lit("अब तक की वर्षा सामान्य से "), _pct(x.since_june), F.lit("% अधिक है; अतिरिक्त भारी वर्षा से जलभराव का जोखिम बढ़ सकता है।")),
    )
    heat = F.when(
        t >= 2, F.concat(F.lit("इस सप्ताह तापमान सामान्य से अधिक ("), signed(t, 1), F.lit("°C) रहने की संभावना है।"))
    ).when(t <= -2, F.concat(F.lit("इस सप्ताह तापमान सामान्य से कम ("), signed(t, 1), F.lit("°C) रहने की संभावना है।")))
    return F.concat_ws(" ", this_week, course, season, heat)


def outlook_weeks(labels: tuple[str, ...] = OUTLOOK_LABELS_EN) -> Column:
    x = rules.inputs()
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("week"),
                w.alias("anomaly_mm_day"),
                outlook_label(w, labels).alias("label"),
                F.col(f"week{i}_tmax_anomaly_degC").alias("tmax_anomaly_degC"),
            )
            for i, w in enumerate(x.weeks, 1)
        ]
    )


# --- filters --------------------------------------------------------------

def fits_crop_stage(text: Column, stage: Column) -> Column:
    """False where the text belongs to another crop stage; true when the stage is unknown."""
    return stage_fit(*stage_marks(text), stage)


def stage_marks(text: Column) -> tuple[Column, Column, Column]:
    """Whether a text speaks of sowing (but not of re-sowing), harvest or flowering."""
    sowing = any_phrase(text, SOWING_KEYWORDS) & ~F.contains(F.lower(text), F.lit("re-sow"))
    return sowing, any_phrase(text, HARVEST_KEYWORDS), any_phrase(text, FLOWERING_KEYWORDS)


def stage_fit(sowing: Column, harvest: Column, flowering: Column, stage: Column) -> Column:
    late = stage.isin("flowering", "flowering_reproductive", "harvesting") & sowing
    early = stage.isin("recently_sown", "vegetative", "not_sown") & harvest
    young = stage.isin("not_sown", "recently_sown") & flowering
    return F.coalesce(~(late | early | young), F.lit(True))


def evergreen_category(text: Column, category: Column) -> Column:
    return F.when(any_phrase(text, EVERGREEN), "general_guidance").otherwise(category)


def annotate(df: DataFrame) -> DataFrame:
    """Keyword classes of a text table, found once per text and not per district and context."""
    t = F.col("text")
    sowing, harvest, flowering = stage_marks(t)
    return df.withColumns(
        {
            "crop_advice": any_phrase(t, CROP_KEYWORDS),
            "sowing": sowing,
            "harvest": harvest,
            "flowering": flowering,
            "evergreen": any_phrase(t, EVERGREEN),
            "concept": dedup.concept(t),
            "bag": dedup.bag(t),
            "action_id": action_id(t),
        }
    )


def guardrail_hits(text: Column) -> Column:
    return dedup.let(F.lower(text), lambda low: reduce(Column.__or__, (F.contains(low, F.lit(p)) for p in FORBIDDEN)))


# --- actions --------------------------------------------------------------

def prepare_contexts(records: DataFrame, contexts: list[dict]) -> DataFrame:
    """Records in all contexts with scenarios and normalised user type.

    What a record alone decides is derived before the contexts multiply the rows.
    """
    told = [{**c, "user_type": re.sub(r"[^a-z0-9]+", "_", "farmer" if c.get("user_type") is None else c["user_type"])} for c in contexts]
    out = rules.expand_contexts(rules.with_weather(records), told)
    return rules.with_stage(out).withColumn("scenarios", rules.scenarios())


def _user_key(user: Column) -> Column:
    return F.regexp_replace(F.coalesce(user, F.lit("farmer")), r"[^a-z0-9]+", "_")


def guidance_table(library: DataFrame, community: DataFrame) -> DataFrame:
    """Library, irrigation and community texts under one key: scenario and audience.

    ``block`` keeps the order of the lists: general, by user, by irrigation, (plan,) community.
    """
    spark = library.sparkSession
    water = [(s, "farmer:rainfed", "do_now", RAINFED_NOW) for s in RAINFED_SCENARIOS]
    water += [(s, "farmer:rainfed", "prepare", RAINFED_PREPARE) for s in RAINFED_SCENARIOS]
    water += [(s, "farmer:assured_irrigation", "do_now", IRRIGATED_NOW) for s in IRRIGATED_SCENARIOS]
    irrigation = spark.createDataFrame(water, "scenario string, audience string, category string, text string")
    cols = ["scenario", "audience", "category", "block", "pos", "text"]
    general = F.when(F.col("audience") == "all", 1).otherwise(2)
    return (
        library.withColumn("block", general).select(*cols)
        .unionByName(irrigation.withColumn("block", F.lit(3)).withColumn("pos", F.lit(0)).select(*cols))
        .unionByName(community.withColumn("block", F.lit(5)).select(*cols))
    )


def own_text_hi(text: Column) -> Column:
    """Hindi of the texts that are written here, known phrases replaced in others."""
    exact = translate_label(text, ACTIONS_HI)
    return F.when(exact == text, replace_all(text, PHRASES_HI)).otherwise(exact)


def in_hindi(texts: DataFrame, catalog: DataFrame | None) -> DataFrame:
    """Adds ``text_hi``: the catalog's translation of ``text``, else what :func:`own_text_hi` gives."""
    if catalog is None:
        return texts.withColumn("text_hi", own_text_hi(F.col("text")))
    return catalog_lookup(texts, catalog, "hi", own_text_hi(F.col("text"))).withColumnRenamed("translated", "text_hi")


def _part(category: Column, evergreen: Column) -> Column:
    """Number of the category among the lists; evergreen texts have their own numbers behind these."""
    at = F.when(category == CATEGORIES[0], 0)
    for i, c in enumerate(CATEGORIES[1:], 1):
        at = at.when(category == c, i)
    return F.when(evergreen, at + len(CATEGORIES)).when(~evergreen, at)


def _entry(category: Column, block: Column, pos: Column) -> Column:
    """One action as every later step needs it; found once per text and not per district and context."""
    return F.struct(
        category.alias("category"), block.cast("int").alias("block"), pos.cast("long").alias("pos"), F.col("text"), F.col("text_hi"),
        F.col("evergreen"), F.col("concept").cast("int").alias("concept"), F.col("bag"), F.col("action_id"), _part(category, F.col("evergreen")).alias("part"),
    )


BAG = "struct<words:array<string>,marks:bigint>"
ENTRY = f"struct<category:string,block:int,pos:bigint,text:string,text_hi:string,evergreen:boolean,concept:int,bag:{BAG},action_id:string,part:int>"
_NONE = f"array<{ENTRY}>"


def context_guide(contexts: list[dict], library: DataFrame, community: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """``context_id, before, after``: maps of a scenario to its texts in a context, in order.

    Audience, crop advice and crop stage are settled here, at the size of the libraries
    times the contexts. ``before`` is told before a district's plan, ``after`` behind it.
    """
    spark = library.sparkSession
    fields = ("user_type", "irrigation_status", "crop_stage")
    rows = [(i, *(c.get(f) for f in fields)) for i, c in enumerate(contexts)]
    told = spark.createDataFrame(rows, "context_id int, user_type string, irrigation_status string, crop_stage string")
    told = told.withColumn("user_type", _user_key(F.col("user_type")))
    audiences = F.array(F.lit("all"), F.col("user_type"), F.concat_ws(":", "user_type", "irrigation_status"))
    texts = annotate(in_hindi(guidance_table(library, community), catalog))
    met = told.withColumn("audience", F.explode(audiences)).join(texts, "audience")
    shown = (F.col("audience") != "all") | (F.col("user_type") != "livestock_owner") | ~F.col("crop_advice")
    fits = stage_fit(F.col("sowing"), F.col("harvest"), F.col("flowering"), F.col("crop_stage"))
    kept = met.where(shown & fits).withColumn("entry", _entry(F.col("category"), F.col("block"), F.col("pos")))

    def in_order(test: Column) -> Column:
        listed = F.sort_array(F.collect_list(F.when(test, F.struct("block", "pos", "category", "entry"))))
        return F.transform(listed, lambda x: x["entry"])

    lists = kept.groupBy("context_id", "scenario").agg(in_order(F.col("block") < 4).alias("before"), in_order(F.col("block") > 4).alias("after"))
    maps = [F.map_from_entries(F.collect_list(F.struct("scenario", c))).alias(c) for c in ("before", "after")]
    guide = lists.groupBy("context_id").agg(*maps)
    none = F.create_map().cast(f"map<string,{_NONE}>")
    return told.select("context_id").join(guide, "context_id", "left").select("context_id", *(F.coalesce(c, none).alias(c) for c in ("before", "after")))


def district_plans(plan: DataFrame, catalog: DataFrame | None = None, bags: bool = True) -> DataFrame:
    """``state, district, plan``: a district's plan actions in order, one row a district.

    ``plan`` has scenario, kind, pos, action and crop. Rows of the older flat list have
    kind ``flat``: they are told to farmers whatever their crop. ``bags=False`` leaves out
    the word sets and ids, which action rows do not show.
    """
    p = plan.select("state", "district", "scenario", "kind", "pos", F.col("action").alias("text"), F.col("crop").alias("p_crop"))
    # dealt as short rows, so that all tasks look into the texts and a district's are gathered where they are
    p = annotate(in_hindi(p.repartition("state", "district"), catalog))
    if not bags:
        p = p.withColumns({"bag": F.lit(None).cast(BAG), "action_id": F.lit(None).cast("string")})
    item = F.struct(
        (F.col("kind") != "flat").alias("later"), "pos", "scenario", "kind", "p_crop", "sowing", "harvest", "flowering",
        _entry(F.lit("do_now"), F.lit(4), F.col("pos")).alias("entry"),
    )
    return p.groupBy("state", "district").agg(F.sort_array(F.collect_list(item)).alias("plan"))


def _plan_entries(scenario: Column) -> Column:
    """The plan's entries for a scenario and the row's user, crop and crop stage."""
    wants = F.when(F.col("user_type") == "farmer", "crop").when(F.col("user_type") == "livestock_owner", "livestock")

    def asked(p: Column) -> Column:
        mine = (p["kind"] == wants) | ((p["kind"] == "flat") & (F.col("user_type") == "farmer"))
        return (p["scenario"] == scenario) & F.coalesce(mine, F.lit(False)) & stage_fit(p["sowing"], p["harvest"], p["flowering"], F.col("crop_stage"))

    def placed(p: Column) -> Column:
        named = F.coalesce(F.contains(F.lower(p["p_crop"]), F.lower("crop")), F.lit(False)) & (p["p_crop"] != "")
        now = (p["kind"] != "crop") | (F.coalesce("crop", F.lit("")) == "") | F.coalesce(named, F.lit(False))
        category = F.when(now, "do_now").otherwise("prepare")
        return dedup.let(category, lambda c: p["entry"].withField("category", c).withField("part", _part(c, p["entry"]["evergreen"])))

    return F.transform(F.filter(F.coalesce("plan", F.array()), asked), placed)


def with_entries(
    ctx: DataFrame, contexts: list[dict], library: DataFrame, community: DataFrame, plan: DataFrame | None = None, catalog: DataFrame | None = None
) -> DataFrame:
    """Rows of :func:`prepare_contexts` with ``entries``: per fired scenario its actions in order.

    The guide has a row for each context and is written to the shared folder, so its
    size is known when its join is planned; plans meet the rows by district. ``plan``
    may already be a column of ``ctx``, joined before the contexts multiply the rows.
    """
    guide = stage(context_guide(contexts, library, community, catalog), "context-guide")
    rows = ctx
    if "plan" not in ctx.columns:
        rows = ctx.withColumn("plan", F.lit(None)) if plan is None else ctx.join(district_plans(plan, catalog), ["state", "district"], "left")
    if plan is None and "plan" not in ctx.columns:
        def local(scenario: Column) -> Column:
            return F.array().cast(_NONE)
    else:
        local = _plan_entries
    none = F.array().cast(_NONE)

    def told(s: Column) -> Column:
        name = s["scenario"]
        return F.concat(F.coalesce(F.try_element_at("before", name), none), local(name), F.coalesce(F.try_element_at("after", name), none))

    return rows.join(guide, "context_id").withColumn("entries", F.transform("scenarios", told)).drop("before", "after", "plan")


def scenario_actions(
    ctx: DataFrame, contexts: list[dict], library: DataFrame, community: DataFrame, plan: DataFrame | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Ordered action rows of every fired scenario, with the columns of ``ctx`` that ``keep`` names."""
    key = [*RECORD_KEY, *keep]
    rows = with_entries(ctx, contexts, library, community, plan).select(*key, F.posexplode("entries").alias("rank", "_told"))
    each = rows.select(*key, "rank", F.inline("_told"))
    return each.select(*key, "category", "rank", "block", "pos", "text", "evergreen", "concept")


def baseline_entries(bags: bool = True) -> Column:
    """Planning guidance for rows in which no scenario fires, as entries in order; without word sets if ``bags`` is false."""
    x = rules.inputs()
    user = F.col("user_type")
    field = user.isin("farmer", "livestock_owner")
    official = user.isin("village_official", "ngo_extension_worker")
    wk1, later = x.weeks[0], x.later
    deficit = F.concat(
        F.lit("Season-to-date rainfall is "), _pct(x.since_june), F.lit("% below normal — prioritize moisture conservation")
    )
    said = (
        ((wk1 >= 3.0) & field, "do_now", F.lit(BASE_GOOD)),
        ((wk1 >= 3.0) & field & (x.since_june <= -20), "do_now", F.lit(BASE_RECOVERY)),
        ((wk1 > -3.0) & (wk1 < 3.0) & field, "do_now", F.lit(BASE_NORMAL)),
        ((later <= -3.0) & field, "prepare", F.lit(BASE_DRYING)),
        ((later <= -3.0) & field, "prepare", F.lit(BASE_DRYING_2)),
        ((later <= -3.0) & official, "prepare", F.lit(BASE_DRYING_COMMUNITY)),
        ((later >= 3.0) & field, "prepare", F.lit(BASE_WETTING)),
        ((later >= 3.0) & field, "prepare", F.lit(BASE_WETTING_2)),
        ((x.since_june <= -30) & field, "prepare", deficit),
        (F.lit(True), "do_now", F.lit(BASE_MONITOR)),
    )

    def entry(category: str, text: Column) -> Column:
        evergreen = any_phrase(text, EVERGREEN)
        return F.struct(
            F.lit(category).alias("category"), F.lit(0).alias("block"), F.lit(0).cast("long").alias("pos"), text.alias("text"), own_text_hi(text).alias("text_hi"),
            evergreen.alias("evergreen"), dedup.concept(text).cast("int").alias("concept"), (dedup.bag(text) if bags else F.lit(None)).alias("bag"),
            (action_id(text) if bags else F.lit(None)).alias("action_id"), _part(F.lit(category), evergreen).alias("part"),
        ).cast(ENTRY)

    def told(category: str, text: Column) -> Column:
        # what is found of a fixed text is a fixed value, but for its words
        return dedup.let(text, lambda t: entry(category, t)) if text is deficit else entry(category, text)

    offered = (F.when(when, told(category, text)) for when, category, text in said)
    return F.transform(F.array_compact(F.array(*offered)), lambda e, i: e.withField("pos", i.cast("long")))


def baseline_actions(ctx: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Planning guidance for records where no scenario fires, with the columns of ``ctx`` that ``keep`` names."""
    key = [*RECORD_KEY, *keep]
    rows = ctx.where(F.size("scenarios") == 0).select(*key, F.inline(baseline_entries(bags=False)))
    return rows.select(*key, "category", F.lit(0).alias("rank"), "block", "pos", "text", "evergreen", "concept")


def category_list(entries: Column, category: str) -> Column:
    """The entries of a list in order; evergreen ones of all lists make up general guidance."""
    def of(part: int) -> Column:
        return F.filter(entries, lambda e: e["part"] == part)

    n = len(CATEGORIES)
    if category != "general_guidance":
        return of(CATEGORIES.index(category))
    evergreen = F.concat(*(of(n + i) for i in range(n)), of(n - 1))
    return F.when(F.exists(entries, lambda e: e["part"] >= n), evergreen).otherwise(of(n - 1))


def settled_list(entries: Column) -> Column:
    """A list without repeats: equal texts, then texts of one concept, then texts that share their words."""
    return dedup.fold_overlaps(dedup.longest_of_concepts(dedup.first_of_texts(entries)))


def settled_records(entries: Column) -> Column:
    """:func:`action_records` of :func:`settled_list`, with the ids that the entries hold."""
    def record(e: Column) -> Column:
        return F.struct(e["action_id"].alias("action_id"), e["text"].alias("text_en"), e["text_hi"].alias("text_hi"), F.lit("action_pipeline").alias("source"))

    def settled(all_: Column) -> Column:
        kept = dedup.let(dedup.longest_of_concepts(all_), lambda own: F.transform(dedup.folded_places(own), lambda i: record(F.get(own, i))))
        return F.when(F.size(all_) < 2, F.transform(all_, record)).otherwise(kept)

    return dedup.let(dedup.first_of_texts(entries), settled)


def separate_evergreen(actions: DataFrame) -> DataFrame:
    """Move evergreen advice to general guidance, keeping the order of the source lists."""
    origin = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category")).cast("int")
    moved = F.when(F.col("evergreen"), "general_guidance").otherwise(F.col("category"))
    first = F.when(moved == "general_guidance", origin).otherwise(0)
    order = F.struct(first.alias("list"), "rank", "block", "pos")
    return actions.select(*RECORD_KEY, moved.alias("category"), order.alias("order"), "text", "concept")


def action_records(items: Column) -> Column:
    """Items of a settled list as bilingual records with a stable id and their origin."""
    return F.transform(
        items,
        lambda e: F.struct(action_id(e["text"]).alias("action_id"), e["text"].alias("text_en"), e["text_hi"].alias("text_hi"), F.lit("action_pipeline").alias("source")),
    )


def _note(template: str, count: Column) -> Column:
    """Record of an overflow note; its template's name is its id."""
    return F.struct(
        F.lit(template).alias("action_id"), F.format_string(ACTION_TEMPLATES[template], count).alias("text_en"),
        F.format_string(ACTION_TEMPLATES_HI[template], count).alias("text_hi"), F.lit("generated").alias("source"),
    )


def capped(rows: DataFrame) -> DataFrame:
    """Rows whose four lists of action records are cut to their caps, with a note on what is left out."""
    def settled(lists: Column) -> Column:
        over = {c: F.size(lists[c]) - n for c, n in CAPS.items()}
        general = lists["general_guidance"]
        now_note = F.when(over["do_now"] > 0, _note("additional_contingency", over["do_now"]))
        already = (over["do_now"] > 0) | F.exists(general, lambda g: F.contains(g["text_en"], F.lit("Additional contingency measures")))
        prepare_note = F.when((over["prepare"] > 0) & ~already, _note("additional_preparatory", over["prepare"]))
        return F.struct(
            *(F.slice(lists[c], 1, n).alias(c) for c, n in CAPS.items()), lists["avoid"].alias("avoid"),
            F.concat(general, F.array_compact(F.array(now_note, prepare_note))).alias("general_guidance"),
        )

    others = [c for c in rows.columns if c not in CATEGORIES]
    # a generator, not a projection: what is asked of a list later would be pushed down and make all lists anew for each question
    return rows.select(*others, F.inline(F.array(dedup.let(F.struct(*CATEGORIES), settled))))


def assemble(rows: DataFrame, entries: str = "entries") -> DataFrame:
    """Rows with the four lists of ``entries`` as action records, capped, with overflow notes.

    Everything happens in the row: no shuffle, no Python.
    """
    def lists(all_: Column) -> Column:
        settled = F.transform(F.array(*(category_list(all_, c) for c in CATEGORIES)), settled_records)
        return dedup.let(settled, lambda found: F.struct(*(F.get(found, F.lit(k)).alias(c) for k, c in enumerate(CATEGORIES))))

    listed = rows.withColumn("_lists", dedup.let(F.col(entries), lists)).drop(entries)
    return capped(listed.select(*(c for c in listed.columns if c != "_lists"), *(F.col(f"_lists.{c}").alias(c) for c in CATEGORIES)))


def shown(actions: Column, language: str = "en") -> Column:
    """The texts of action records in a language; without a translation in English."""
    return F.transform(actions, lambda a: F.coalesce(a["text_hi"], a["text_en"]) if language == "hi" else a["text_en"])


def first_and_overflow(actions: Column, n: int = 6) -> tuple[Column, Column]:
    """Items shown at first and the number held back."""
    return F.slice(actions, 1, n), F.greatest(F.lit(0), F.size(actions) - n)


# Sources named in an advisory.
FORECAST_SOURCE = "IMD forecast products"
AGRICULTURE_SOURCE = "ICAR/CRIDA district agriculture contingency plans"
HEALTH_SOURCE = "NDMA / state heat action / health guidance where available"


def source_notes(records: DataFrame) -> Column:
    """Sources and date of an advisory; the forecast's own source where the record has one."""
    own = F.col("forecast_source") if "forecast_source" in records.columns else F.lit(None)
    return F.struct(
        F.coalesce(own.cast("string"), F.lit(FORECAST_SOURCE)).alias("forecast_source"),
        F.lit(AGRICULTURE_SOURCE).alias("agriculture_source"),
        F.lit(HEALTH_SOURCE).alias("health_source"),
        F.date_format(F.current_date(), "yyyy-MM-dd").alias("last_updated"),
    )


def advisories(
    records: DataFrame,
    contexts: list[dict],
    library: DataFrame,
    community: DataFrame,
    plan: DataFrame | None = None,
    language: str = "en",
    catalog: DataFrame | None = None,
) -> DataFrame:
    """Complete advisory record for every district and context, sentences in English or Hindi.

    Plans meet records by district before the contexts multiply them; every later step
    stays in the row. Actions carry both languages; ``catalog`` (``pos, source_text,
    lang, text``) translates the texts of libraries and plans.
    """
    hindi = language == "hi"
    if plan is not None:
        records = records.join(district_plans(plan, catalog), ["state", "district"], "left")
    ctx = prepare_contexts(records, contexts)
    rows = with_entries(ctx, contexts, library, community, None, catalog)
    quiet = F.size("scenarios") == 0
    rows = rows.withColumn("entries", F.when(quiet, baseline_entries()).otherwise(F.flatten("entries")))
    heads = {
        "overall_risk": rules.overall_risk(F.col("scenarios")),
        "main_concerns": F.transform("scenarios", lambda s: labels.scenario_name(s["scenario"], s["display_name"], language)),
        "confidence": F.coalesce(F.get("scenarios", F.lit(0))["confidence"], F.lit("Low")),
        "forecast_summary": summary_hi() if hindi else summary_en(),
        "outlook_narrative": narrative_hi() if hindi else narrative_en(),
        "outlook_weeks": outlook_weeks(OUTLOOK_LABELS_HI if hindi else OUTLOOK_LABELS_EN),
        "source_notes": source_notes(records),
        "disclaimer": F.lit(DISCLAIMER),
    }
    named = rows.select(*RECORD_KEY, "user_type", "forecast_date", "scenarios", "entries", *(c.alias(n) for n, c in heads.items()))
    return assemble(named)
