"""Removal of repeated actions: exact, by concept, by shared words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.functions.text import STOP_WORDS, WHITESPACE, any_phrase

# Phrase groups; actions that hit the same group say the same thing.
CONCEPTS = (
    ("conserve water", "use water efficiently", "water judiciously", "essential needs only"),
    ("applying fertilizer before", "fertilizer to dry soil", "fertilizer without moisture"),
    ("re-sowing too early", "re-sowing if plant stand", "consider re-sowing"),
    ("non-essential water", "waste water on non-essential"),
    ("prepare contingency plans for water", "review water conservation"),
    ("short-duration crop", "short-duration rice", "shorter-duration"),
    ("delay fertilizer application", "delay fertilizer"),
)


#: Half the size of a bag that no other one reaches.
NO_OVERLAP = 1 << 30


def concept(text: Column) -> Column:
    """Index of the first phrase group the text hits, else null."""
    expr = None
    for i, phrases in enumerate(CONCEPTS):
        hit = any_phrase(text, phrases)
        expr = F.when(hit, i) if expr is None else expr.when(hit, i)
    return expr


def exact_first(df: DataFrame, keys: list[str], text: str, order: str) -> DataFrame:
    """Each distinct text once, at its first position. Map-side combined."""
    return df.groupBy(*keys, text).agg(F.min(order).alias(order))


def concept_longest(df: DataFrame, keys: list[str], text: str, order: str, known: str | None = None) -> DataFrame:
    """One action per concept: first position, longest text, earlier text on equal length.

    ``order`` is of any type with an order. ``known`` names a column that already holds the concept of the text.
    """
    c = F.col(known) if known else concept(F.col(text))
    work = df.withColumn("_c", c)
    work = work.withColumn("_t", F.when(F.col("_c").isNull(), F.col(text)))
    best = F.min_by(F.col(text), F.struct(-F.length(text), F.col(order)))
    return work.groupBy(*keys, "_c", "_t").agg(F.min(order).alias(order), best.alias(text)).drop("_c", "_t")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bag(text: Column) -> Column:
    """A text's significant words, and 64 marks of which each word sets one."""
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])
    words = F.array_distinct(F.filter(F.split(F.lower(text), WHITESPACE), lambda w: (F.length(w) > 2) & ~F.array_contains(stops, w)))
    return let(
        words,
        lambda own: F.struct(
            own.alias("words"),
            F.aggregate(own, F.lit(0).cast("long"), lambda m, w: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(w), F.lit(64)).cast("int")))).alias("marks"),
        ),
    )


def first_of_texts(items: Column) -> Column:
    """Items of a list whose text did not stand before."""
    def kept(all_: Column, texts: Column) -> Column:
        # most lists repeat nothing, which a set of their texts tells
        plain = F.size(F.array_distinct(F.array_compact(texts))) == F.size(all_)
        return F.when(plain, all_).otherwise(F.filter(all_, lambda x, i: F.array_position(texts, x["text"]) == i + 1))

    return let(items, lambda all_: let(F.transform(all_, lambda x: x["text"]), lambda texts: kept(all_, texts)))


def longest_of_concepts(items: Column) -> Column:
    """One item for each concept in a list: in the first one's place the longest, of equal ones the earlier."""
    def best(all_: Column, concept: Column) -> Column:
        same = F.filter(all_, lambda y: y["concept"] == concept)
        return F.array_max(F.transform(same, lambda y, j: F.struct(F.length(y["text"]).alias("n"), (-j).alias("o"), y.alias("item"))))["item"]

    def kept(all_: Column, concepts: Column) -> Column:
        picked = F.transform(
            all_, lambda x, i: F.when(x["concept"].isNull(), x).when(F.array_position(concepts, x["concept"]) == i + 1, best(all_, x["concept"]))
        )
        known = F.array_remove(concepts, -1)
        return F.when(F.size(F.array_distinct(known)) == F.size(known), all_).otherwise(F.filter(picked, lambda x: x.isNotNull()))

    return let(items, lambda all_: let(F.transform(all_, lambda x: F.coalesce(x["concept"], F.lit(-1))), lambda concepts: kept(all_, concepts)))


def folded_places(items: Column) -> Column:
    """Places, from 0, of the items that the pass of :func:`fold_overlaps` keeps, in its order.

    The pass carries places alone, and what pairs are ruled out by is measured once an item.
    Common words set common marks, and no more words share a mark than a bag has words beyond
    its marks: a pair without half of the smaller bag in marks is not compared by words.
    """
    def measures(all_: Column) -> Column:
        n = F.transform(all_, lambda x: F.size(x["bag"]["words"]))
        # a bag without words overlaps with none
        half = F.transform(n, lambda k: F.when(k == 0, NO_OVERLAP).otherwise(F.shiftright(k + 1, 1)))
        marks = F.transform(all_, lambda x: x["bag"]["marks"])
        spare = F.transform(all_, lambda x: F.size(x["bag"]["words"]) - F.bit_count(x["bag"]["marks"]))
        length = F.transform(all_, lambda x: F.length(x["text"]))
        return F.struct(half.alias("half"), marks.alias("marks"), spare.alias("spare"), length.alias("length"))

    def over(all_: Column, m: Column) -> Column:
        def words(i: Column) -> Column:
            return F.get(all_, i)["bag"]["words"]

        def step(kept: Column, i: Column) -> Column:
            def may(k: Column) -> Column:
                common = F.bit_count(F.get(m["marks"], k).bitwiseAND(F.get(m["marks"], i))) + F.get(m["spare"], k)
                return common >= F.least(F.get(m["half"], k), F.get(m["half"], i))

            def shares(k: Column) -> Column:
                return F.size(F.array_intersect(words(k), words(i))) >= F.least(F.get(m["half"], k), F.get(m["half"], i))

            def placed(near: Column) -> Column:
                longer = F.get(m["length"], i) > F.get(m["length"], near)
                return (
                    F.when(near.isNull(), F.array_append(kept, i))
                    .when(longer, F.transform(kept, lambda k: F.when(k == near, i).otherwise(k)))
                    .otherwise(kept)
                )

            return let(F.get(F.filter(F.filter(kept, may), shares), F.lit(0)), placed)

        return F.aggregate(F.transform(all_, lambda x, i: i), F.array().cast("array<int>"), step)

    return let(items, lambda all_: let(measures(all_), lambda m: over(all_, m)))


def fold_overlaps(items: Column) -> Column:
    """Greedy pass over an ordered list of items with ``text`` and ``bag``.

    An item that shares at least half of the smaller word set with a kept one is
    absorbed by the first such; the kept item is replaced when the new text is longer,
    and its words count from then on. Every decision depends on the ones before it, so
    the pass is an aggregate over one row's own list.
    """
    return let(items, lambda all_: F.transform(folded_places(all_), lambda i: F.get(all_, i)))


def overlap_fold(texts: Column) -> Column:
    """The greedy pass of :func:`fold_overlaps` over an ordered array of texts."""
    folded = fold_overlaps(F.transform(texts, lambda t: F.struct(t.alias("text"), bag(t).alias("bag"))))
    return F.transform(folded, lambda x: x["text"])
