"""Collocations by SETM: relations of phrase occurrences, joined by adjacent position and counted as sets.

A relation of length k holds, block by block, the sorted places of phrases of k words in
the pieces of the texts. Places are numbered with a gap between pieces, so two words
stand next to each other in a piece exactly if their places differ by one. A length is
extended in three steps: places whose phrase is not frequent leave (semi-join), the rest
meets itself one place further (merge-join of sorted places), and the longer phrases are
counted (group-count). Every relation is written to the shared folder.

The semi-join asks a bitmap of fixed size that holds the hashes of the frequent phrases
of a length. A phrase that it lets through by accident costs work only: its count decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfold.llm.common import slices, split_join, whole_text
from skyfold.session import stage

MOST_WORDS = 3
LEAST_COUNT = 10
#: A phrase goes if a longer one that holds it has this share of its occurrences, in percent.
COVERED = 50
BEST = 2000
NO_LANGUAGE = "und"
#: Bytes of text that one row of a relation is made from; a piece is never cut. A task holds four times as much at most.
BLOCK_BYTES = 2 << 20
#: Bits of the bitmap of frequent phrases: 8 MB, whatever the input.
FILTER_BITS = 1 << 26
BITMAP_BITS = 1 << 15
#: Phrases of a part on average when they are counted, those of each block by themselves.
PART_PHRASES = 100_000

# Bytes that end a piece, bytes between words.
_BREAK = re.compile(rb"[.,;:!?\n-\r]")
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

RELATION = "lang string, size long, words long, phrases binary, counts binary, places binary"
_ARROW = pa.schema([("lang", pa.string()), ("size", pa.int64()), ("words", pa.int64()), *((c, pa.binary()) for c in ("phrases", "counts", "places"))])


def _bytes_of(strings: pa.Array) -> bytes:
    """Strings as one run of bytes: their number, their lengths, their letters."""
    if not len(strings):
        return bytes(4)
    ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]
    return len(strings).to_bytes(4, "little") + np.diff(ends).astype(np.int32).tobytes() + strings.buffers()[2][int(ends[0]) : int(ends[-1])].to_pybytes()


def _strings_of(run: bytes) -> pa.Array:
    n = int.from_bytes(run[:4], "little")
    ends = np.zeros(n + 1, np.int32)
    np.cumsum(np.frombuffer(run, np.int32, n, 4), out=ends[1:])
    return pa.StringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(memoryview(run)[4 + 4 * n :]))


def _row(lang: str, phrases: pa.Array, at: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
    """A row of a relation: ``code`` numbers the phrases, ``at`` are their sorted places; both stay packed outside of tasks."""
    pack = zstandard.ZstdCompressor(level=1).compress
    gaps = np.diff(at, prepend=0).astype(np.int32)
    counts = np.bincount(code, minlength=len(phrases)).astype(np.int64)
    packed = [pack(_bytes_of(phrases)), pack(counts.tobytes()), pack(gaps.tobytes() + code.astype(np.int32).tobytes())]
    return pa.RecordBatch.from_arrays(
        [pa.array([lang], pa.string()), pa.array([len(phrases)], pa.int64()), pa.array([len(code)], pa.int64()), *(pa.array([x], pa.binary()) for x in packed)],
        schema=_ARROW,
    )


def _unpacked(cell: pa.Scalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(cell.as_py())


def _places(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(packed, np.int32)
    half = len(both) // 2
    return np.cumsum(both[:half], dtype=np.int64), both[half:]


def _portions(text: bytes) -> Iterator[bytes]:
    """A long text in portions that end where a piece ends."""
    at = 0
    while len(text) - at > BLOCK_BYTES:
        cut = _BREAK.search(text, at + BLOCK_BYTES)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def words_in_order(text: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the places of all occurrences, and the number of the word at each."""
    raw = np.frombuffer(text, np.uint8)
    kind = _KIND[raw]
    inside = kind == 0
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    ends_of_words = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=ends_of_words[1:])
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends_of_words), pa.py_buffer(_LOWER[raw[inside]]))
    coded = words.dictionary_encode()
    return coded.dictionary.cast(pa.string()), np.arange(len(starts)) + piece, coded.indices.to_numpy()


def occurrences(docs: DataFrame) -> DataFrame:
    """The relation of single words: a row for each language and block of a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[bytes]] = {}
        held: dict[str, int] = {}

        def out(lang: str) -> Iterator[pa.RecordBatch]:
            held.pop(lang)
            for portion in _portions(b"\n".join(waiting.pop(lang))):
                yield _row(lang, *words_in_order(portion))

        for part in slices(batches):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                waiting.setdefault(lang, []).append(text)
                held[lang] = held.get(lang, 0) + len(text) + 1
                if held[lang] >= BLOCK_BYTES:
                    yield from out(lang)
                elif sum(held.values()) >= 4 * BLOCK_BYTES:
                    yield from out(max(held, key=held.get))
        for lang in list(held):
            yield from out(lang)

    rows = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), whole_text(docs).alias("text"))
    return rows.mapInArrow(run, RELATION)


def _deal(phrases: pa.Array, parts: int) -> np.ndarray:
    """A part for each phrase, the same wherever it stands: a polynomial of its bytes."""
    ends = np.frombuffer(phrases.buffers()[1], np.int32)[phrases.offset : phrases.offset + len(phrases) + 1].astype(np.int64)
    raw = np.frombuffer(phrases.buffers()[2], np.uint8)[ends[0] : ends[-1]].astype(np.uint64)
    sizes, starts = np.diff(ends), ends[:-1] - ends[0]
    powers = np.multiply.accumulate(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
    total = np.add.reduceat(raw * powers[np.arange(len(raw)) - np.repeat(starts, sizes)], starts)
    return ((total >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def counted(relation: DataFrame, least: int) -> DataFrame:
    """``lang, phrase, f``: the occurrences of the phrases of a relation that occur ``least`` times.

    Phrases travel as arrays, cut by a hash into parts of a bounded average size; each
    part of a language is summed in one go.
    """
    parts = max(1, (relation.agg(F.sum("size")).first()[0] or 0) // PART_PHRASES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in slices(batches, 1):
            phrases, counts = _strings_of(_unpacked(row.column(1)[0])), np.frombuffer(_unpacked(row.column(2)[0]), np.int64)
            if not len(phrases):
                continue
            part = _deal(phrases, parts)
            order = np.argsort(part, kind="stable")
            held, firsts = np.unique(part[order], return_index=True)
            taken, counts = phrases.take(pa.array(order)), counts[order]
            ends = [*firsts[1:].tolist(), len(order)]
            runs = [(_bytes_of(taken.slice(a, b - a)), counts[a:b].tobytes()) for a, b in zip(firsts.tolist(), ends, strict=True)]
            langs = pa.array([row.column(0)[0].as_py()] * len(held), pa.string())
            yield pa.RecordBatch.from_arrays([langs, pa.array(held), *(pa.array(x, pa.binary()) for x in zip(*runs, strict=True))], ["lang", "part", "phrases", "counts"])

    def total(group: pa.Table) -> pa.Table:
        lang = group["lang"][0].as_py()
        phrases = pa.chunked_array([_strings_of(x) for x in group["phrases"].to_pylist()])
        counts = pa.chunked_array([pa.array(np.frombuffer(x, np.int64)) for x in group["counts"].to_pylist()])
        sums = pa.table({"phrase": phrases, "f": counts}).group_by("phrase").aggregate([("f", "sum")])
        sums = sums.filter(pa.compute.greater_equal(sums["f_sum"], least))
        return pa.table({"lang": pa.array([lang] * sums.num_rows, pa.string()), "phrase": sums["phrase"], "f": sums["f_sum"]})

    dealt = relation.select("lang", "phrases", "counts").mapInArrow(cut, "lang string, part long, phrases binary, counts binary")
    return dealt.groupBy("lang", "part").applyInArrow(total, "lang string, phrase string, f long")


def _bitmap(frequent: DataFrame) -> bytes:
    """Bits at the hashes of the phrases of ``lang, phrase``; the pieces collected are FILTER_BITS long together."""
    bit = F.xxhash64("lang", "phrase").bitwiseAND(FILTER_BITS - 1)
    parts = frequent.select(bit.alias("bit")).groupBy(F.shiftright("bit", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(BITMAP_BITS - 1)).alias("bits"))
    out = bytearray(FILTER_BITS // 8)
    for part, bits in parts.collect():
        out[part * BITMAP_BITS // 8 : (part + 1) * BITMAP_BITS // 8] = bits
    return bytes(out)


def extended(relation: DataFrame, frequent: DataFrame) -> DataFrame:
    """The relation of phrases one word longer: two frequent phrases of the relation, one place apart."""
    shared = relation.sparkSession.sparkContext.broadcast(_bitmap(frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for part in slices(batches, 1):
            lang, phrases = part.column(0)[0].as_py(), _strings_of(_unpacked(part.column(1)[0])).to_pylist()
            seed = xxhash.xxh64_intdigest(lang, 42)  # as xxhash64 of both columns
            hashes = np.fromiter((xxhash.xxh64_intdigest(p, seed) & (FILTER_BITS - 1) for p in phrases), np.int64, len(phrases))
            passes = (bits[hashes >> 3] >> (hashes & 7).astype(np.uint8) & 1).astype(bool)
            at, code = _places(_unpacked(part.column(2)[0]))
            kept = passes[code]
            at, code = at[kept], code[kept]
            left = np.flatnonzero(np.diff(at) == 1)
            pair = code[left].astype(np.int64) << 32 | code[left + 1]
            distinct, number = np.unique(pair, return_inverse=True)
            last = {k: phrases[k].rpartition(" ")[2] for k in np.unique(distinct & 0xFFFFFFFF).tolist()}
            longer = [f"{phrases[a]} {last[b]}" for a, b in zip((distinct >> 32).tolist(), (distinct & 0xFFFFFFFF).tolist(), strict=True)]
            yield _row(lang, pa.array(longer, pa.string()), at[left], number)

    return relation.select("lang", "phrases", "places").mapInArrow(run, RELATION)


def _part(first: int | Column, length: int | Column) -> Column:
    return F.array_join(F.slice("words", first, length), " ")


def scored(candidates: DataFrame, frequent: DataFrame) -> DataFrame:
    """``lang, phrase, words, a`` with ``l, r, score`` of the cut that scores lowest.

    The score is floor(1000000 * a * a / (l * r)) in whole numbers of 38 digits.
    """
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _part(1, F.col("cut")).alias("first"), _part(F.col("cut") + 1, F.size("words") - F.col("cut")).alias("rest"))
    firsts = frequent.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    rests = frequent.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    met = split_join(split_join(cuts, firsts, ["lang", "first"]), rests, ["lang", "rest"])
    exact = "(cast(a as decimal(20,0)) * cast(a as decimal(20,0)) * 1000000) div (cast(l as decimal(20,0)) * cast(r as decimal(20,0)))"
    lowest = F.min(F.struct(F.expr(exact).alias("score"), "cut", "l", "r", "a")).alias("lowest")
    return met.groupBy("lang", "phrase").agg(lowest).select("lang", "phrase", "lowest.a", "lowest.l", "lowest.r", "lowest.score")


def uncovered(candidates: DataFrame, longest: int, covered: int = COVERED) -> DataFrame:
    """Candidates that no longer candidate holds with ``covered`` percent of their occurrences or more."""
    longer = candidates.where(F.size("words") > 2).withColumn("length", F.explode(F.sequence(F.lit(2), F.size("words") - 1)))
    inner = longer.select("lang", "a", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1), lambda k: F.array_join(F.slice("words", k, F.col("length")), " "))).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    if longest < 3:
        return candidates
    both = candidates.join(most, ["lang", "phrase"], "left")
    return both.where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))).drop("longer")


def collocations(
    docs: DataFrame, longest: int = MOST_WORDS, least: int = LEAST_COUNT, covered: int = COVERED, best: int = BEST
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of 2 to ``longest`` words of each language.

    ``n`` counts the words of the language, ``a`` the phrase, ``l`` and ``r`` the parts of
    its lowest-scoring cut. Order: score and count descending, phrase by its bytes. A
    null language is ``und``, a null text empty; an empty table gives no rows. Repeated
    rows count as often as they stand. Other columns are not read.
    """
    relation = stage(occurrences(docs), "phrases-1")
    totals = relation.groupBy("lang").agg(F.sum("words").alias("n"))
    frequent = [stage(counted(relation, least), "phrases-frequent-1")]
    for length in range(2, longest + 1):
        relation = stage(extended(relation, frequent[-1]), f"phrases-{length}")
        frequent.append(stage(counted(relation, least), f"phrases-frequent-{length}"))
    phrases = reduce(DataFrame.unionAll, frequent[1:])
    candidates = phrases.select("lang", "phrase", F.split("phrase", " ").alias("words"), F.col("f").alias("a"))
    rows = scored(uncovered(candidates, longest, covered), reduce(DataFrame.unionAll, frequent))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, part FROM (
    SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part FROM documents)),
split AS (SELECT lang, piece, regexp_extract_all(part, '[^\x20\x09]+') AS words FROM pieces),
occurrences AS (SELECT lang, piece, unnest(words) AS w, generate_subscripts(words, 1) AS at FROM split),
totals AS (SELECT lang, count(*) AS n FROM occurrences GROUP BY lang),
c1 AS (SELECT lang, w AS phrase, count(*) AS f FROM occurrences GROUP BY ALL),
c2 AS (SELECT x.lang, x.w || ' ' || y.w AS phrase, x.w AS w1, y.w AS w2, count(*) AS f
       FROM occurrences x JOIN occurrences y ON y.piece = x.piece AND y.at = x.at + 1 GROUP BY ALL HAVING count(*) >= 10),
c3 AS (SELECT x.lang, x.w || ' ' || y.w || ' ' || z.w AS phrase, x.w AS w1, y.w AS w2, z.w AS w3, count(*) AS f
       FROM occurrences x JOIN occurrences y ON y.piece = x.piece AND y.at = x.at + 1
       JOIN occurrences z ON z.piece = x.piece AND z.at = x.at + 2 GROUP BY ALL HAVING count(*) >= 10),
longer AS (SELECT lang, phrase, max(f) AS f FROM (
  SELECT lang, w1 || ' ' || w2 AS phrase, f FROM c3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM c3) GROUP BY ALL),
kept2 AS (SELECT c2.* FROM c2 LEFT JOIN longer USING (lang, phrase) WHERE longer.f IS NULL OR 100 * longer.f < 50 * c2.f),
cuts AS (
  SELECT lang, phrase, f AS a, 1 AS k, w1 AS first, w2 AS rest FROM kept2
  UNION ALL SELECT lang, phrase, f, 1, w1, w2 || ' ' || w3 FROM c3
  UNION ALL SELECT lang, phrase, f, 2, w1 || ' ' || w2, w3 FROM c3),
known AS (SELECT lang, phrase, f FROM c1 UNION ALL SELECT lang, phrase, f FROM c2),
scores AS (
  SELECT cuts.lang, cuts.phrase, a, k, p.f AS l, q.f AS r, (1000000::HUGEINT * a * a) // (p.f::HUGEINT * q.f) AS score
  FROM cuts JOIN known p ON p.lang = cuts.lang AND p.phrase = cuts.first JOIN known q ON q.lang = cuts.lang AND q.phrase = cuts.rest),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
