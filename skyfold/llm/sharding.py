"""Shards along a Hilbert curve over metadata.

Language, source and size of a document are quantised to a grid cell each, language
and source by their rank among all rows' values; the cells' index on a Hilbert curve
orders the documents, and the order is cut into runs of equal row counts. A run then
covers a compact part of every dimension, so files can be skipped by any of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfold.llm.common import split_join, whole_text
from skyfold.session import stage

#: Bits of each dimension of the grid.
BITS = 6
SHARDS = 16


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of a grid cell, by Skilling's transposition on column expressions.

    ``axes`` are integers from 0 to ``2^bits - 1``. Each step is bound to an array
    column of the row, so the expression stays small.
    """
    n = len(axes)
    x = F.array(*(a.cast("long") for a in axes))

    def step(x: Column, i: int, q: int) -> Column:
        def moved(v: Column) -> Column:
            low, high = v[0], v[i]
            t = low.bitwiseXOR(high).bitwiseAND(F.lit(q - 1))
            set_ = high.bitwiseAND(F.lit(q)) != 0
            first = F.when(set_, low.bitwiseXOR(F.lit(q - 1))).otherwise(low.bitwiseXOR(t) if i else low)
            parts = [first if k == 0 else F.when(set_, v[k]).otherwise(v[k].bitwiseXOR(t)) if k == i else v[k] for k in range(n)]
            return F.array(*parts)

        return F.element_at(F.transform(F.array(x), moved), 1)

    for bit in range(bits - 1, 0, -1):
        for i in range(n):
            x = step(x, i, 1 << bit)

    def gray(v: Column) -> Column:
        parts = [v[0]]
        for k in range(1, n):
            parts.append(v[k].bitwiseXOR(parts[-1]))
        t = F.lit(0).cast("long")
        for bit in range(bits - 1, 0, -1):
            t = t.bitwiseXOR(F.when(parts[-1].bitwiseAND(F.lit(1 << bit)) != 0, F.lit((1 << bit) - 1)).otherwise(F.lit(0)))
        return F.array(*(p.bitwiseXOR(t) for p in parts))

    x = F.element_at(F.transform(F.array(x), gray), 1)

    def interleave(v: Column) -> Column:
        places = [
            F.shiftleft(F.shiftright(v[k], bit).bitwiseAND(F.lit(1)), bit * n + (n - 1 - k)) for bit in range(bits) for k in range(n)
        ]
        return reduce(lambda a, b: a.bitwiseOR(b), places)

    return F.element_at(F.transform(F.array(x), interleave), 1)


def _cells(rows: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """``column, cell``: each distinct value with its place among the values of all rows on ``bits`` bits.

    The place is that of the middle of the value's rows in the order of values, so
    values that hold more than one cell's share of the rows never meet in a cell. The
    rows of a value are counted first; values are ranked like rows in :func:`cut_runs`.
    """
    values = rows.groupBy(column).agg(F.count("*").alias("n"))
    ordered = values.repartitionByRange(column).sortWithinPartitions(column)
    ordered = stage(ordered.withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33)), f"hilbert-{column}")
    counts = ordered.groupBy("part").agg(F.sum("n").alias("held"))
    before = counts.select(
        "part",
        (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("before"),
        F.sum("held").over(Window.partitionBy()).alias("total"),
    )
    within = F.sum("n").over(Window.partitionBy("part").orderBy(column)) - F.col("n")
    ranked = ordered.withColumn("within", within).join(F.broadcast(before), "part")
    return ranked.select(column, F.expr(f"cast(((2 * (before + within) + n) * {1 << bits}) div (2 * total) as int)").alias("cell"))


def curve_position(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, text_hash, curve`` of every row.

    Dimensions: language and source (ranks by rows, see :func:`_cells`) and size
    (steps of a quarter of a doubling). Rows of equal text take the dimensions of
    their smallest ``doc_id`` (then of the smallest language and source), so they stand together on the curve.
    """
    raw = docs["text"].cast("string").cast("binary")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(raw, F.lit(b""))).alias("text_crc32"),
        F.xxhash64(whole_text(docs)).alias("text_hash"),
        F.coalesce((docs["lang"] if "lang" in docs.columns else F.lit(None)).cast("string"), F.lit("")).alias("lang"),
        F.coalesce((docs["source"] if "source" in docs.columns else F.lit(None)).cast("string"), F.lit("")).alias("source"),
    )
    group = rows.groupBy("text_hash").agg(F.min(F.struct("doc_id", "lang", "source")).alias("first"))
    placed = group.select("text_hash", F.col("first.lang").alias("lang"), F.col("first.source").alias("source"))
    size_code = F.least(F.lit((1 << BITS) - 1), F.floor(4 * F.log2(F.col("size").cast("double"))) - 8)
    known = stage(split_join(rows.drop("lang", "source"), placed, ["text_hash"]), "hilbert-rows")
    for column in ("lang", "source"):
        known = split_join(known, _cells(known.select(column), column).withColumnRenamed("cell", f"{column}_cell"), [column])
    return known.select(
        "doc_id", "size", "text_crc32", "text_hash",
        hilbert_index([F.col("lang_cell"), F.col("source_cell"), F.greatest(F.lit(0), size_code)]).alias("curve"),
    )


def cut_runs(placed: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard and slot of every row: runs of the curve whose row counts differ by one at most.

    Rows are range-partitioned and sorted once and written to the shared folder; a
    row's rank is its place in its partition plus the rows of the partitions before.
    Ties on the curve follow the text's hash, then ``doc_id``. Only one number a
    partition is summed over all partitions. Rows that are equal in all keys (nulls
    included) take neighbouring slots in any order.
    """
    keys = ["curve", "text_hash", "doc_id"]
    number = F.monotonically_increasing_id()
    ordered = placed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = stage(ordered.withColumn("part", F.shiftright(number, 33)).withColumn("place", number.bitwiseAND(F.lit((1 << 33) - 1))), "hilbert")
    counts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select(
        "part",
        (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
    )
    ranked = ordered.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("place"))
    small, extra = F.expr(f"total div {shards}"), F.expr(f"total % {shards}")
    # the first ``extra`` shards hold one row more
    in_large = F.col("rank") < extra * (small + 1)
    ranked = ranked.withColumn("small", small).withColumn("extra", extra)
    shard = F.when(in_large, F.expr("rank div (small + 1)")).otherwise(F.expr("extra + (rank - extra * (small + 1)) div greatest(small, 1)"))
    ranked = ranked.withColumn("shard", shard.cast("int"))
    start = F.col("shard") * F.col("small") + F.least(F.col("shard").cast("long"), F.col("extra"))
    return ranked.select("doc_id", "size", "text_crc32", "curve", "shard", (F.col("rank") - start).cast("long").alias("slot"))


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """All documents in shards 0 to ``shards - 1`` under the law ``rows``.

    A null text has size 1 (none plus 1). Missing ``lang`` or ``source`` columns and
    nulls in them count as empty. Every row gets exactly one slot.
    """
    cut = cut_runs(curve_position(docs), shards)
    return cut.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
