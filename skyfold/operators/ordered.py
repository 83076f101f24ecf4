"""Order-aware building blocks that stay safe when one key holds much of the data.

A plain window puts a whole key into one task. The helpers here cut a key into
blocks of its order column, summarise the blocks, and stitch them together, or
use partial aggregation so that no task ever sees a whole hot key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from skyfold.session import stage

BLOCK = 100_000
#: Steps of a bucket of values when its quantile is searched.
STEPS = 4096


def carry_forward(
    df: DataFrame,
    keys: list[str],
    order: str | list[str],
    values: dict[str, Column],
    include_current: bool = True,
    block: int | Column | None = BLOCK,
    firsts: dict[str, Column] | None = None,
) -> DataFrame:
    """Add one column per entry of ``values``: its last non-null value in ``order``; of ``firsts`` the first one.

    ``order`` is unique within the keys: a non-negative whole number, or several columns
    with ``block`` as an expression that does not fall along them. With
    ``include_current=False`` only earlier rows count. Keys are cut into blocks, of
    ``block`` positions where it is a number; what earlier blocks carry enters a block as
    a row of its own before all others, so one window does the rest. ``block=None`` is
    for keys that are known to be short, which need no blocks.
    """
    firsts = firsts or {}
    given = values | firsts
    names = list(given)
    by = [order] if isinstance(order, str) else list(order)
    if block is None:
        cut = F.lit(0)
    else:
        cut = block if isinstance(block, Column) else F.floor(F.col(by[0]) / F.lit(block))
    work = df.select("*", cut.alias("_block"), *(given[name].alias(f"_v_{name}") for name in names))
    place = F.struct(*by) if len(by) > 1 else F.col(by[0])

    def end(name: str) -> Column:
        pick = F.min_by if name in firsts else F.max_by
        return pick(f"_v_{name}", F.when(F.col(f"_v_{name}").isNotNull(), place)).alias(f"_v_{name}")

    def along(name: str, window: WindowSpec) -> Column:
        pick = F.first if name in firsts else F.last
        return pick(f"_v_{name}", ignorenulls=True).over(window)

    frame = (Window.unboundedPreceding, Window.currentRow if include_current else -1)
    kept = [c for c in df.columns if c not in names]
    if block is None:
        whole = Window.partitionBy(*keys).orderBy(*by).rowsBetween(*frame)
        return work.select(*kept, *(along(name, whole).alias(name) for name in names))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        work.groupBy(*keys, "_block").agg(*(end(name) for name in names))
        .select(*keys, "_block", *(along(name, earlier).alias(f"_v_{name}") for name in names))
        .where(reduce(Column.__or__, (F.col(f"_v_{name}").isNotNull() for name in names)))
    )
    both = work.withColumn("_real", F.lit(True)).unionByName(carried.withColumn("_real", F.lit(False)), allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_block").orderBy("_real", *by).rowsBetween(*frame)
    out = both.select(*kept, "_real", *(along(name, inside).alias(name) for name in names))
    return out.where("_real").drop("_real")


def _null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    renamed = right.select(
        *[F.col(c).alias(f"_r_{c}") for c in on], *[c for c in right.columns if c not in on]
    )
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{c}" for c in on])


def keep_first(df: DataFrame, keys: list[Column], order: Column) -> DataFrame:
    """First row of every key by ``order``, as a partial aggregate (no window, no sort)."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    row = F.struct(*[F.col(c) for c in df.columns])
    picked = df.groupBy(*named).agg(F.min_by(row, order).alias("_row"))
    return picked.select("_row.*")


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank_name: str = "rank") -> DataFrame:
    """First ``n`` rows of every key. Spark prunes each partition to ``n`` before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_name, F.row_number().over(w)).where(F.col(rank_name) <= n)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles of unbounded groups, one column for each entry of ``probs``."""
    return joint_quantiles(df, keys, value, {name: (lambda v: v, p) for name, p in probs.items()})


def joint_quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple[Callable[[Column], Column], float]]) -> DataFrame:
    """Exact quantiles of several expressions of one value, selected together.

    ``wanted`` gives a name its expression of the value and its probability. Values are
    collapsed to counts, written once; an expression's counts are those of the values it
    comes from. All expressions are counted in order-preserving logarithmic buckets (a
    bounded number for each group); buckets that hold a wanted rank are counted again in
    equal steps between their smallest and largest value, since values may crowd round
    one level, and only the steps that hold a wanted rank are sorted.
    """
    kinds = list(dict.fromkeys(kind for kind, _ in wanted.values()))
    v = F.col(value)
    counts = stage(df.where(v.isNotNull()).groupBy(*keys, v.cast("double").alias("_v")).agg(F.count("*").alias("_n")), "quantile-counts")
    each = counts.select(*keys, "_n", F.posexplode(F.array(*(kind(F.col("_v")) for kind in kinds))).alias("_e", "_x"))
    magnitude = F.ceil(F.log2(F.lit(1.0) + F.abs("_x") * F.lit(1e6)) * 1024)
    each = each.withColumn("_b", (F.signum("_x") * magnitude).cast("long"))

    def rank(kind: Callable[[Column], Column], p: float) -> tuple[Column, Column]:
        return F.col("_e") == kinds.index(kind), F.floor(F.lit(p) * (F.col("_total") - 1))

    def holds_a_rank() -> Column:
        """Rows whose range of places holds a wanted rank or the one after it."""
        found = F.lit(False)
        for mine, low in (rank(*w) for w in wanted.values()):
            found = found | (mine & (F.col("_before") <= low + 1) & (F.col("_before") + F.col("_bn") > low))
        return found

    group = Window.partitionBy(*keys, "_e")
    so_far = (Window.unboundedPreceding, Window.currentRow)
    size = F.sum("_n").alias("_bn")
    buckets = each.groupBy(*keys, "_e", "_b").agg(size, F.min("_x").alias("_from"), F.max("_x").alias("_to"))
    buckets = buckets.withColumn("_before", F.sum("_bn").over(group.orderBy("_b").rowsBetween(*so_far)) - F.col("_bn"))
    buckets = stage(buckets.withColumn("_total", F.sum("_bn").over(group)).where(holds_a_rank()), "quantile-buckets")
    near = _null_safe_join(each, buckets.drop("_bn"), [*keys, "_e", "_b"], "inner")
    share = F.coalesce(F.try_divide(F.col("_x") - F.col("_from"), F.col("_to") - F.col("_from")), F.lit(0.0))
    near = near.withColumn("_s", F.floor(share * STEPS).cast("long")).drop("_from", "_to")
    steps = near.groupBy(*keys, "_e", "_b", "_s").agg(size, F.first("_before").alias("_before"), F.first("_total").alias("_total"))
    inside = Window.partitionBy(*keys, "_e", "_b").orderBy("_s").rowsBetween(*so_far)
    steps = steps.withColumn("_before", F.col("_before") + F.sum("_bn").over(inside) - F.col("_bn")).where(holds_a_rank())
    last = _null_safe_join(near.drop("_before", "_total"), steps.drop("_bn"), [*keys, "_e", "_b", "_s"], "inner")
    inside = Window.partitionBy(*keys, "_e", "_b", "_s").orderBy("_x").rowsBetween(*so_far)
    last = last.withColumn("_hi", F.col("_before") + F.sum("_n").over(inside)).withColumn("_lo", F.col("_hi") - F.col("_n"))
    aggs, cols = [], []
    for name, (kind, p) in wanted.items():
        mine, low = rank(kind, p)

        def at(place: Column) -> Column:
            return F.max(F.when(mine & (F.col("_lo") <= place) & (F.col("_hi") > place), F.col("_x")))

        aggs += [at(low).alias(f"_a_{name}"), at(low + 1).alias(f"_b_{name}")]
        h = F.lit(p) * (F.col("_total") - 1)
        a = F.col(f"_a_{name}")
        cols.append((a + (F.coalesce(f"_b_{name}", a) - a) * (h - F.floor(h))).alias(name))
    return last.groupBy(*keys).agg(F.max("_total").alias("_total"), *aggs).select(*keys, *cols)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with their place from 1 in an order over the whole table.

    Rows are range-partitioned and sorted once and written to the shared folder; a
    place is the row's place in its partition plus the rows of the partitions
    before, of which there is one number each.
    """
    number = F.monotonically_increasing_id()
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = stage(ordered.withColumns({"_part": F.shiftright(number, 33), "_place": number.bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    counts = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return ordered.join(before, "_part").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")
