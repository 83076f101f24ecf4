"""Ranked lexical search by a dual tree.

Items and documents are vectors over the items' terms: an item has the weights of its
terms, a document their saturated frequencies. Both stand in hierarchies whose nodes hold
the coordinate maxima of what is below them, so the product of two nodes bounds every
score between their items and documents. A pair of nodes is left out when its bound does
not reach the weakest of the best scores that the node's items have so far; what remains
is opened, best bounds first, down to leaves that are scored exactly. All numbers are
whole, so bounds and scores are exact.

Items are taken in blocks of a bounded number of terms. For a block every task holds the
items' hierarchy and builds one for each portion of its documents. A first look at every
64th document gives each item a score that its last result has at least.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyfold.llm.common import slices, whole_text
from skyfold.session import stage

NEAREST = 20
#: Terms of a block's items together, repeats between items counted.
TERMS_AT_ONCE = 16_384
#: Documents of a hierarchy, of a leaf, and children of a node above; items likewise.
PORTION, LEAF_DOCS, LEAF_ITEMS, CHILDREN = 2048, 32, 8, 8
#: One in so many documents is looked at first.
FIRST_LOOK = 64
LAST_ID = (1 << 63) - 1
#: Saturated frequencies stay below this (fixed by the score's definition).
FULL = 1_000_000

# Letters A-Z become small, all other bytes below 0x80 but letters and digits end a term.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(_TABLE).split()


class Items(NamedTuple):
    """A block of items: their ids, and the terms of each as numbers with repeats."""

    ids: list[int]
    terms: list[list[int]]
    counts: list[list[int]]


class Node(NamedTuple):
    """A node over items. ``weights`` has a row for each child: its maxima at ``columns``; children of a leaf are items."""

    columns: np.ndarray
    weights: np.ndarray
    children: list["Node"]
    items: np.ndarray


def item_tree(items: Items, weight: np.ndarray) -> Node:
    """Hierarchy over items; those that share their weightiest terms stand together.

    Numbers are doubles while every sum stays exact in them, else 64-bit integers.
    """
    values = [np.array(c, np.int64) * weight[t] for t, c in zip(items.terms, items.counts, strict=True)]
    exact = np.float64 if max((int(v.sum()) for v in values), default=0) * FULL < 1 << 53 else np.int64
    order = sorted(range(len(values)), key=lambda k: [items.terms[k][j] for j in np.argsort(-values[k], kind="stable")[:4]])

    def over(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        columns = np.unique(np.concatenate([c for c, _ in parts]))
        weights = np.zeros((len(parts), len(columns)), exact)
        for row, (c, w) in zip(weights, parts, strict=True):
            row[np.searchsorted(columns, c)] = w
        return columns, weights

    sorted_terms = [(np.array(t, np.int64)[o], v[o]) for t, v in zip(items.terms, values, strict=True) for o in [np.argsort(t)]]
    level = []
    for k in range(0, len(order), LEAF_ITEMS):
        chosen = order[k : k + LEAF_ITEMS]
        level.append(Node(*over([sorted_terms[i] for i in chosen]), [], np.array(chosen)))
    while len(level) > 1:
        groups = [level[k : k + CHILDREN] for k in range(0, len(level), CHILDREN)]
        level = [Node(*over([(n.columns, n.weights.max(0)) for n in g]), g, np.concatenate([n.items for n in g])) for g in groups]
    return level[0]


class Best:
    """The best documents of each item so far; the weakest of a full list is what others have to beat."""

    def __init__(self, items: int, nearest: int, least: np.ndarray):
        self.nearest = nearest
        self.score, self.doc = least - 1, np.full(items, -1 << 62, np.int64)  # to beat
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * items
        self.docs: list[np.ndarray] = [np.zeros(0, np.int64)] * items

    def offer(self, item: int, scores: np.ndarray, docs: np.ndarray) -> None:
        better = (scores > self.score[item]) | ((scores == self.score[item]) & (docs < self.doc[item]))
        if not better.any():
            return
        scores, docs = np.append(self.scores[item], scores[better]), np.append(self.docs[item], docs[better])
        order = np.lexsort((docs, -scores))[: self.nearest]
        self.scores[item], self.docs[item] = scores[order], docs[order]
        if len(order) == self.nearest:
            self.score[item], self.doc[item] = scores[order[-1]], docs[order[-1]]

    def out_of_reach(self, items: np.ndarray, bound: int, first_doc: int) -> bool:
        """Whether no document with a score up to ``bound`` and an id from ``first_doc`` on enters any list."""
        weakest = self.score[items].min()
        return bound < weakest or (bound == weakest and first_doc >= self.doc[items[self.score[items] == weakest]].max())


class Documents:
    """Hierarchy over a portion of documents. ``levels`` go from leaves to the root: maxima, and first ids."""

    def __init__(self, docs: np.ndarray, sizes: np.ndarray, term: np.ndarray, value: np.ndarray, weight: np.ndarray, columns: int):
        row = np.repeat(np.arange(len(docs)), sizes)
        strongest = np.lexsort((-weight[term] * value, row))
        first = np.r_[True, row[strongest][1:] != row[strongest][:-1]]
        order = np.lexsort((docs, term[strongest[first]]))  # documents whose weightiest term is the same stand together
        self.docs = docs[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.matrix = np.zeros((len(docs), columns), np.float32)  # values below 2^24 are exact
        self.matrix[place[row], term] = value
        starts = np.arange(0, len(docs), LEAF_DOCS)
        self.levels = [(np.maximum.reduceat(self.matrix, starts, 0), np.minimum.reduceat(self.docs, starts))]
        while len(self.levels[-1][1]) > 1:
            maxima, firsts = self.levels[-1]
            starts = np.arange(0, len(firsts), CHILDREN)
            self.levels.append((np.maximum.reduceat(maxima, starts, 0), np.minimum.reduceat(firsts, starts)))


def dual_search(tree: Node, documents: Documents, best: Best) -> int:
    """Offer every document that can enter an item's list; the number of scored pairs."""
    waiting = [(math.inf, tree, len(documents.levels) - 1, 0)]
    scored = 0
    while waiting:
        bound, node, level, at = waiting.pop()
        if best.out_of_reach(node.items, bound, int(documents.levels[level][1][at])):
            continue
        if level == 0 and not node.children:
            rows = slice(at * LEAF_DOCS, (at + 1) * LEAF_DOCS)
            scores = documents.matrix[rows][:, node.columns].astype(node.weights.dtype) @ node.weights.T
            scored += scores.size
            for k, item in enumerate(node.items.tolist()):
                best.offer(item, scores[:, k].astype(np.int64), documents.docs[rows])
            continue
        if level:
            level -= 1
            below = range(at * CHILDREN, min((at + 1) * CHILDREN, len(documents.levels[level][1])))
        else:
            below = range(at, at + 1)
        weights = node.weights if node.children else node.weights.max(0, keepdims=True)
        bounds = documents.levels[level][0][below.start : below.stop][:, node.columns].astype(weights.dtype) @ weights.T
        found = [
            (int(bounds[d, i]), child, level, doc_node)
            for d, doc_node in enumerate(below)
            for i, child in enumerate(node.children or [node])
            if bounds[d, i] > 0
        ]
        waiting += sorted(found, key=lambda pair: pair[0])
    return scored


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, terms, counts`` of the distinct items (null text: no term)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            counts = [Counter(terms(t)) for t in part.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([list(c) for c in counts], pa.list_(pa.binary())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))],
                ["item_id", "terms", "counts"],
            )

    rows = items.select(items["item_id"].cast("long").alias("item_id"), whole_text(items).alias("text")).distinct()
    return rows.mapInArrow(run, "item_id long, terms array<binary>, counts array<long>")


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, term, tf`` of each document with a term: its terms, and those of the vocabulary with their occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for part in slices(batches):
            ids, sizes, held = [], [], []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = terms(text)
                if words:
                    ids.append(doc)
                    sizes.append(len(words))
                    held.append(Counter(map(number, words)))
                    held[-1].pop(None, None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array([list(c) for c in held], pa.list_(pa.int32())),
                 pa.array([list(c.values()) for c in held], pa.list_(pa.int64()))],
                ["doc_id", "n", "term", "tf"],
            )

    rows = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST_ID)).alias("doc_id"), whole_text(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, term array<int>, tf array<long>")


def _best_of_tasks(held: DataFrame, items: Items, weight: np.ndarray, total: int, length: int, nearest: int, least: np.ndarray) -> DataFrame:
    """``item, doc_id, score``: each task's best documents of each item."""
    shared = held.sparkSession.sparkContext.broadcast((item_tree(items, weight), weight, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, weight, least = shared.value
        best = Best(len(least), nearest, least.copy())
        for part in slices(batches, PORTION):
            lists, tf = part.column(2), part.column(3).flatten().to_numpy()
            n, term = part.column(1).to_numpy(), lists.flatten().to_numpy()
            sizes = lists.value_lengths().to_numpy()
            length_share = np.repeat(100 - 25 + 25 * n * total // length, sizes)
            value = 1_000_000_000 * tf // (1000 * tf + 12 * length_share)
            dual_search(tree, Documents(part.column(0).to_numpy(), sizes, term, value, weight, len(weight)), best)
        sizes = [len(s) for s in best.scores]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int32()), pa.array(np.concatenate(best.docs), pa.int64()), pa.array(np.concatenate(best.scores), pa.int64())],
            ["item", "doc_id", "score"],
        )

    return held.mapInArrow(run, "item int, doc_id long, score long")


def _ranked(found: DataFrame, nearest: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest)


def _search_block(docs: DataFrame, items: Items, names: list[bytes], nearest: int) -> DataFrame | None:
    held = stage(vectors(docs, {t: k for k, t in enumerate(names)}), "lexical-vectors")
    total, length = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not total:
        return None
    df = np.zeros(len(names), np.int64)
    for term, count in held.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # a row a term of the block at most
        df[term] = count
    weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    some = held.where(F.size("term") > 0).select("doc_id", "n", "term", "tf")
    least = np.ones(len(items.ids), np.int64)
    first_look = some.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(FIRST_LOOK)) == 0)
    for item, score in _ranked(_best_of_tasks(first_look, items, weight, total, length, nearest, least), nearest).where(F.col("rank") == nearest).select("item", "score").collect():
        least[item] = score
    found = _ranked(_best_of_tasks(some, items, weight, total, length, nearest, least), nearest)
    ids = F.array(*(F.lit(k).cast("long") for k in items.ids))
    doc = F.when(F.col("doc_id") != LAST_ID, F.col("doc_id"))
    return found.select(F.get(ids, F.col("item")).alias("item_id"), F.col("rank").cast("int").alias("rank"), doc.alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``nearest`` best documents of each item, scores above 0 only.

    Every row of ``docs`` is a document; null text has no term. Equal scores are ranked
    by ``doc_id``, null last. Equal rows of ``items`` are one item; an id with several
    texts is ranked once for each. Other columns are not read. Without documents or
    items that have a term there are no rows.
    """
    spark = docs.sparkSession
    known = stage(item_terms(items).where(F.size("terms") > 0), "lexical-items")
    held = known.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-held // TERMS_AT_ONCE)
    parts = []
    for block in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == block).collect()
        if not rows:
            continue
        names = sorted({bytes(t) for r in rows for t in r["terms"]})
        number = {t: k for k, t in enumerate(names)}
        block_items = Items([r["item_id"] for r in rows], [[number[bytes(t)] for t in r["terms"]] for r in rows], [r["counts"] for r in rows])
        parts.append(_search_block(docs, block_items, names, nearest))
    parts = [p for p in parts if p is not None]
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionAll, parts)


ORACLE_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
docs AS (SELECT row, doc_id, words, len(words) AS n FROM words WHERE len(words) > 0),
size AS (SELECT count(*) AS total, sum(n)::BIGINT AS length FROM docs),
tf AS (SELECT row, doc_id, n, w, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(words) AS w FROM docs) GROUP BY ALL),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
weights AS (SELECT w, floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM df, size),
items AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
wanted AS (SELECT item_id, w, count(*) AS times FROM items GROUP BY ALL),
scores AS (
  SELECT item_id, row, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * total) // length))))::BIGINT AS score
  FROM wanted JOIN weights USING (w) JOIN tf USING (w), size GROUP BY item_id, row, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
