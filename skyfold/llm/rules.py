"""Quality rules kept in a ledger of failure bits.

Every rule is evaluated once a document; the ledger keeps the measurements and one
bit a failed rule. A policy is a versioned mask over the bits, so changing a policy,
or asking what a rule costs, reads the ledger and never the texts again. Everything
is expressions of the DataFrame API.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import whole_text

SPACES = "[\\x20\\x09-\\x0D]+"
NOT_SPACE = "[^\\x20\\x09-\\x0D]"
#: Words of a window that counts as repeated.
WINDOW = 8

#: Rule name to the condition under which a document fails it, over its measurements. A rule's bit is its place here.
RULES = (
    ("few_words", lambda m: m["n_words"] < 20),
    ("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
    ("many_symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    ("repeated_lines", lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
    ("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])),
)

#: Policy version to the rules that it applies.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "many_symbols"),
    "v2": tuple(name for name, _ in RULES),
}
CURRENT = "v2"


def mask_of(rules: tuple[str, ...]) -> int:
    """Bits of some rules."""
    names = [name for name, _ in RULES]
    return sum(1 << names.index(rule) for rule in rules)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for the row, wherever the optimizer moves the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more, from the windows' hashes in order.

    Rows without a repeated hash are settled by a distinct; the others sort their
    windows by hash, take the places of equal neighbours and add up what each covers
    beyond the place before it.
    """

    def covered(ordered: Column) -> Column:
        def same(k: Column, step: int) -> Column:
            return F.get(ordered, k + step)["x"] == F.get(ordered, k)["x"]

        places = F.sort_array(
            F.transform(
                F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda k: F.coalesce(same(k, -1), F.lit(False)) | F.coalesce(same(k, 1), F.lit(False))),
                lambda k: F.get(ordered, k)["i"],
            )
        )
        start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(
            places, start,
            lambda acc, i: F.struct((acc["total"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("total"), i.alias("last")),
            lambda acc: acc["total"],
        )

    by_hash = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(by_hash, covered))


def measure(text: Column) -> Column:
    """All measurements of a text as one struct. Windows are compared by a 64-bit hash of their words."""

    def windows(words: Column) -> Column:
        n = F.size(words)
        each = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
        return F.when(n >= WINDOW, each).otherwise(F.array().cast("array<bigint>"))

    def of_words(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _let(windows(words), _repeated_words).alias("n_repeat_words"),
        )

    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(NOT_SPACE))
    return _let(F.array_remove(F.split(text, SPACES), ""), lambda words: _let(lines, lambda held: of_words(words, held)))


def fail_bits(measured: Column) -> Column:
    """One bit for each rule that the measurements fail."""
    bits = (F.when(rule(measured), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, rule) in enumerate(RULES))
    return sum(bits, F.lit(0)).cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and failure bits of every document, from its whole text.

    A null or empty text has no words: all measurements are 0 and it fails
    ``few_words``. Every input row gives one row; only ``doc_id`` and ``text`` are read.
    """
    measured = docs.select("doc_id", measure(whole_text(docs)).alias("m"))
    return measured.select("doc_id", "m.*", fail_bits(F.col("m")).alias("fail_bits"))


def passes(bits: Column, policy: str = CURRENT) -> Column:
    """Whether a document passes a policy."""
    return bits.bitwiseAND(F.lit(mask_of(POLICIES[policy]))) == 0


def verdicts(recorded: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The measurements with ``base_failed`` and ``kept`` under a policy; what fails the base is never kept."""
    base = ~passes(F.col("fail_bits"), "base")
    return recorded.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits",
        base.alias("base_failed"), (~base & passes(F.col("fail_bits"), policy)).alias("kept"),
    )


def ablations(recorded: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail nothing else of the policy, and that would be kept without it.

    The ledger is first counted by its bits, so at most ``2^rules`` rows are looked at a rule.
    """
    mask = mask_of(POLICIES[policy])
    patterns = recorded.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(mask_of((r,))).cast("long").alias("bit")) for r in POLICIES[policy])))
    each = patterns.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("failed_only"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )


def keep_passing(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of ``docs`` that a policy keeps, all columns as they are; what fails the base is never kept.

    The rules are one expression over the text, so no column is added and none can clash.
    """

    def kept(bits: Column) -> Column:
        return passes(bits, "base") & passes(bits, policy)

    return docs.where(_let(_let(measure(whole_text(docs)), fail_bits), kept))


#: The ledger under the current policy in DuckDB's SQL.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), chr(31)) AS win
      FROM w, unnest(range(1, len(ws) - 6)) AS u(i)),
p AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
c AS (SELECT doc_id, sum(least(8, coalesce(i - prev, 8)))::BIGINT AS n FROM
      (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM p) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
b AS (SELECT *, ((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
             + 8 * (2 * n_dup_lines > n_lines)::INT + 16 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits,
       fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept FROM b
"""
