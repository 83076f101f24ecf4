"""Name resolution: aliases, exact then fuzzy matching, catalog lookups."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.functions.text import catalog_key

CUTOFF = 0.85


def apply_aliases(names: DataFrame, state_aliases: DataFrame, district_aliases: DataFrame) -> DataFrame:
    """One hop of aliases: states by lower-case key, districts by exact name whatever the state.

    Alias tables have ``alias``, ``name`` and ``pos``; a later duplicate wins.
    """
    s = state_aliases.groupBy(F.lower("alias").alias("_sa")).agg(F.max_by("name", "pos").alias("_sn"))
    d = district_aliases.groupBy(F.col("alias").alias("_da")).agg(F.max_by("name", "pos").alias("_dn"))
    return (
        names.join(s, F.lower("state") == F.col("_sa"), "left")
        .join(d, F.col("district") == F.col("_da"), "left")
        .withColumn("resolved_state", F.coalesce("_sn", "state"))
        .withColumn("resolved_district", F.coalesce("_dn", "district"))
        .drop("_sa", "_sn", "_da", "_dn")
    )


def _common_letters(word: str, candidate: str) -> int:
    """Length of the longest common subsequence, a bit for each letter of the word."""
    where: dict[str, int] = {}
    for i, x in enumerate(word):
        where[x] = where.get(x, 0) | 1 << i
    every = (1 << len(word)) - 1
    open_ = every
    for x in candidate:
        hit = open_ & where.get(x, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & every
    return len(word) - open_.bit_count()


def _scored(pairs: DataFrame, cutoff: float) -> DataFrame:
    """``_s, word, cand, score`` of the pairs whose matching-block similarity reaches the cutoff.

    Edit distance built-ins rank differently. Matched blocks are common letters in order,
    so pairs with too few of these are not scored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, last = difflib.SequenceMatcher(), None
        for batch in batches:
            scores = []
            for w, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                need = cutoff * (len(w) + len(c)) - 1e-9  # a pair exactly at the cutoff stays
                if 2 * _common_letters(w, c) < need:
                    scores.append(-1.0)
                    continue
                if w != last:
                    matcher.set_seq2(w)
                    last = w
                matcher.set_seq1(c)
                scores.append(matcher.ratio())
            yield batch.append_column("score", pa.array(scores, pa.float64()))

    scored = pairs.select("_s", "word", "cand").mapInArrow(run, "_s string, word string, cand string, score double")
    return scored.where(F.col("score") >= cutoff)


def _lengths(n: Column, cutoff: float) -> Column:
    """Lengths that a name similar to one of ``n`` letters can have."""
    apart = (1 - cutoff) / (1 + cutoff)
    return F.sequence(F.floor(n * apart).cast("int"), F.ceil(n / max(apart, 0.01)).cast("int"))


def _unmatched(a: Column, b: Column, cutoff: float) -> Column:
    """Letters of two names of these lengths that may stay unmatched at the cutoff."""
    return F.floor((1 - cutoff) * (a + b) + 1e-9).cast("int")


def _segment(b: Column, d: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of segment ``i`` of ``d + 1`` even segments of a name of ``b`` letters."""
    start = F.floor(i * b / (d + 1)).cast("int")
    return start, F.floor((i + 1) * b / (d + 1)).cast("int") - start


def _segments_of(name: str, cutoff: float) -> Column:
    """Array of (b, d, i, piece): the segments of a roster name for every limit that a similar name can bring."""
    b = F.length(name)
    limits = F.array_distinct(F.transform(F.filter(_lengths(b, cutoff), lambda a: F.abs(a - b) <= _unmatched(a, b, cutoff)), lambda a: _unmatched(a, b, cutoff)))

    def cut(d: Column, i: Column) -> Column:
        start, size = _segment(b, d, i)
        return F.struct(b.alias("b"), d.alias("d"), i.alias("i"), F.substring(name, start + 1, size).alias("piece"))

    return F.flatten(F.transform(limits, lambda d: F.transform(F.sequence(F.lit(0), d), lambda i: cut(d, i))))


def _lookups_of(name: str, cutoff: float) -> Column:
    """Array of (b, d, i, piece): what a name holds where segment ``i`` of a similar roster name can stand.

    Of ``d + 1`` segments one stays whole with at most ``i`` unmatched letters before it
    and ``d - i`` behind it, which bounds its shift from both sides.
    """
    a = F.length(name)

    def at(b: Column, d: Column, i: Column) -> Column:
        start, size = _segment(b, d, i)
        low = F.greatest(F.lit(0), start - i, start + (a - b) - (d - i))
        high = F.least(a - size, start + i, start + (a - b) + (d - i))
        places = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        return F.transform(
            F.array_distinct(F.transform(places, lambda q: F.substring(name, q + 1, size))),
            lambda piece: F.struct(b.alias("b"), d.alias("d"), i.alias("i"), piece.alias("piece")),
        )

    def of_length(b: Column) -> Column:
        d = _unmatched(a, b, cutoff)
        return F.flatten(F.transform(F.sequence(F.lit(0), d), lambda i: at(b, d, i)))

    return F.flatten(F.transform(F.filter(_lengths(a, cutoff), lambda b: F.abs(a - b) <= _unmatched(a, b, cutoff)), of_length))


def similar_candidates(words: DataFrame, pool: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Distinct pairs ``_s, word, cand`` of one state that can reach the cutoff: a partition join.

    A ratio at the cutoff leaves at most ``d`` letters of both names unmatched, so of
    ``d + 1`` segments of the roster name one stands whole in the other, at a bounded
    shift. State, length, limit, number and text of a segment are the equality key, and
    an edit distance with the same limit follows on what meets.
    """
    # a name becomes a hundred rows, so the names are dealt to all partitions however few bytes they are;
    # by a hash of their own, or the shuffle would pass for the one before it, whose partitions are merged by size
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = pool.repartition(parts, F.xxhash64("_s", "cand")).select("_s", "cand", F.inline(_segments_of("cand", cutoff)))
    asked = words.repartition(parts, F.xxhash64("_s", "word")).select("_s", "word", F.inline(_lookups_of("word", cutoff)))
    met = asked.join(cut, ["_s", "b", "d", "i", "piece"]).where(F.expr("levenshtein(word, cand, d) >= 0"))
    return met.select("_s", "word", "cand").distinct()


def fuzzy_best(names: DataFrame, roster: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Best roster district in the same state with similarity at or above the cutoff.

    Distinct names only are joined; candidates come from :func:`similar_candidates`,
    and those whose common letters suffice are scored in Arrow batches.
    ``names`` has ``id``, ``state``, ``district``; equal scores take the larger name.
    """
    q = names.select("id", F.lower("state").alias("_s"), F.lower("district").alias("word"))
    pool = roster.select(F.lower("state").alias("_s"), F.lower("district").alias("cand")).distinct()
    pairs = similar_candidates(q.select("_s", "word").distinct(), pool, cutoff)
    best = _scored(pairs, cutoff).groupBy("_s", "word").agg(F.max(F.struct("score", "cand")).alias("_b"))
    return q.join(best, ["_s", "word"]).select("id", F.col("_b.cand").alias("match"), F.col("_b.score").alias("score"))


def resolve_plans(names: DataFrame, roster: DataFrame) -> DataFrame:
    """Exact match first, then fuzzy, else default. Fuzzy runs only for names without an exact hit."""
    pool = roster.select(F.lower("state").alias("_s"), F.lower("district").alias("_d")).distinct()
    q = names.withColumn("_s", F.lower("state")).withColumn("_d", F.lower("district"))
    exact = q.join(pool.withColumn("_hit", F.lit(True)), ["_s", "_d"], "left")
    missing = exact.where(F.col("_hit").isNull()).select("id", "state", "district")
    fuzzy = fuzzy_best(missing, roster).select("id", "match", "score")
    out = exact.join(fuzzy, "id", "left")
    return out.select(
        "id",
        "state",
        "district",
        F.when(F.col("_hit"), F.col("_d")).otherwise(F.col("match")).alias("match"),
        F.when(F.col("_hit"), "exact").when(F.col("match").isNotNull(), "fuzzy").otherwise("default").alias("how"),
        F.when(F.col("_hit"), F.lit(1.0)).otherwise(F.col("score")).alias("score"),
    )


def catalog_lookup(texts: DataFrame, catalog: DataFrame, language: str, fallback: Column | None = None) -> DataFrame:
    """Translation of each text in a language, else the fallback column, else the text itself.

    ``catalog`` is exploded: ``pos``, ``source_text``, ``lang``, ``text``; the first entry wins.
    """
    entry = (
        catalog.where((F.col("lang") == language) & (F.coalesce("text", F.lit("")) != ""))
        .groupBy(catalog_key(F.col("source_text")).alias("_key"))
        .agg(F.min_by("text", "pos").alias("_translated"))
    )
    joined = texts.withColumn("_key", catalog_key(F.col("text"))).join(entry, "_key", "left")
    options = ["_translated"] + ([fallback] if fallback is not None else []) + ["text"]
    return joined.withColumn("translated", F.coalesce(*options)).drop("_key", "_translated")


def untranslated(texts: DataFrame, catalog: DataFrame, limit: int | None = None) -> DataFrame:
    """Texts without a catalog entry in a case-blind order, optionally the first ``limit``."""
    known = catalog.select(catalog_key(F.col("source_text")).alias("_key")).distinct()
    missing = (
        texts.select("text").distinct().withColumn("_key", catalog_key(F.col("text"))).join(known, "_key", "left_anti")
    ).drop("_key")
    ordered = missing.orderBy(F.lower("text"), "text")
    return ordered.limit(limit) if limit else ordered
