"""Near-duplicates by order MinHash.

A document is the sequence of its five-word shingles, each labelled with how often it
occurred before. For each of several hash functions a sketch keeps the few shingles
with the smallest hashes in the order of the text, so it is sensitive to edits and
order and not to shared words alone. Documents that share a sketch are compared with
a hub, the member of the sketch's bucket whose sketches are the commonest, and with
the hubs of finer buckets (two to eight sketches in a row alike), so a bucket of any
size gives a few pairs for each member. Pairs are verified by a banded alignment of the
shingle sequences, and verified links are joined into classes. Members of buckets that
hold several classes then meet by their rarest shared shingles: similar texts share one
of the first few in the order of rarity, and shingle sets whose parities differ too much
are not similar. So each two texts that share a sketch are in one class, compared, or
known to differ, and no bucket is paired in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfold.llm.common import slices, split_join, whole_text
from skyfold.session import stage

WORDS = 5
#: Sketches of a document and shingles in each. Two long texts whose shingles agree to 0.8 share none with a chance of
#: 5 in 10^8; with 4 shingles against 5 the chance is 0.8^32, 8 in 10^4.
SKETCHES = 32
SHINGLES = 4
#: How many sketches in a row a bucket needs alike.
LEVELS = (1, 2, 3, 4, 5, 6, 8)
#: From this level on a bucket has a drawn hub besides.
DRAWN_FROM = 3
#: Links that a task thins to a spanning forest at a time.
LINKS_AT_ONCE = 200_000
#: A pair is similar if 9 * common >= 4 * (n1 + n2), which is common / (n1 + n2 - common) >= 0.8.
NUMERATOR, DENOMINATOR = 4, 9
LAST_ID = (1 << 63) - 1
#: Longs that hold the parities of a text's labelled shingles.
PARITIES = 16

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    return x ^ (x >> np.uint64(27))


def shingles(text: str) -> np.ndarray:
    """Hashes of the five-word shingles in order; fewer words are one shingle, no word none."""
    words = text.lower().split()
    each = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    n = max(min(len(each), 1), len(each) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(each))):
        out = _mix(out * _M1 + each[k : k + n])
    return out


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Hashes that tell the occurrences of one shingle apart."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    opens = np.r_[True, ordered[1:] != ordered[:-1]] if len(hashes) else np.zeros(0, bool)
    if opens.all():
        return hashes
    place = np.arange(len(hashes))
    number = np.empty(len(hashes), np.uint64)
    number[order] = (place - np.maximum.accumulate(np.where(opens, place, 0))).astype(np.uint64)
    return np.where(number == 0, hashes, _mix(hashes + number * _M1))


def sketches(hashes: np.ndarray) -> list[int]:
    """One number for each hash function, from the smallest labelled shingles in the order of the text."""
    n = len(hashes)
    if not n:
        return []
    own = labelled(hashes)
    out = np.zeros(SKETCHES, np.uint64)
    at_once = max(1, min(SKETCHES, 1_000_000 // n))
    for a in range(0, SKETCHES, at_once):
        seeds = np.arange(a + 1, min(SKETCHES, a + at_once) + 1, dtype=np.uint64)[:, None] * _M1
        values = _mix(own[None] ^ seeds) * _M1
        chosen = np.sort(np.argpartition(values, SHINGLES, 1)[:, :SHINGLES], 1) if n > SHINGLES else np.tile(np.arange(n), (len(seeds), 1))
        kept = own[chosen]
        total = seeds[:, 0].copy()
        for k in range(kept.shape[1]):
            total = _mix(total * _M1 + kept[:, k])
        out[a : a + len(seeds)] = total
    return out.view(np.int64).tolist()


def common_in_order(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence of two sequences within a band round the diagonal.

    Equal ends are taken off; the rest is a bit-parallel row-by-row alignment in
    which a row touches the columns of the band only. Exact whenever no more than
    ``band`` elements of either sequence stay unmatched.
    """
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(same.argmin())
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    same = a[::-1][:n] == b[::-1][:n]
    tail = n if same.all() else int(same.argmin())
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not (len(a) and len(b)):
        return head + tail
    where: dict[int, int] = {}
    wanted = set(b.tolist())
    for i, x in enumerate(a.tolist()):
        if x in wanted:
            where[x] = where.get(x, 0) | 1 << i
    width = len(a)
    open_ = (1 << width) - 1  # zero bits are matched columns
    step = max(64, band)
    rows = b.tolist()
    for j in range(0, len(rows), step):
        low, high = max(0, j - band), min(width, j + step + band)
        if low >= high:
            break
        mask = (1 << (high - low)) - 1
        part = (open_ >> low) & mask
        before = part
        for x in rows[j : j + step]:
            hit = part & (where.get(x, 0) >> low)
            if hit:
                part = ((part + hit) | (part - hit)) & mask
        open_ ^= (before ^ part) << low
    return head + tail + width - open_.bit_count()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two shingle sequences agree in order to 0.8 of what either holds."""
    total = len(a) + len(b)
    band = total - 2 * -(-NUMERATOR * total // DENOMINATOR)
    if abs(len(a) - len(b)) > band:
        return False
    return DENOMINATOR * common_in_order(a, b, max(1, band)) >= NUMERATOR * total


def sketched(docs: DataFrame) -> DataFrame:
    """``row, doc_id, text_key, n, sketch``, a row for each row of ``docs``, written to the shared folder.

    ``text_key`` is the text's MD5; ``row`` is a number of its own for each row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            hashes = [shingles(t) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([len(h) for h in hashes], pa.int64()), pa.array([sketches(h) for h in hashes], pa.list_(pa.int64()))],
                ["doc_id", "text_key", "n", "sketch"],
            )

    text = whole_text(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.md5(text.cast("binary")).alias("text_key"), text.alias("text"))
    made = rows.mapInArrow(run, "doc_id long, text_key string, n long, sketch array<long>")
    return stage(made.select(F.monotonically_increasing_id().alias("row"), "*"), "neardup-sketches")


def _pairs(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs ``a < b`` of texts to verify: every member of a shared bucket with the bucket's hubs; and the buckets' members.

    A hub is the member whose sketches are the commonest, which in a group of edited
    copies is the text that all others were made from. Fine buckets have a second hub
    drawn by a hash, which brings their few members together in other ways.
    """
    turns = F.explode(F.sequence(F.lit(0), F.lit(SKETCHES - 1))).alias("j")

    def key(depth: int) -> Column:
        return F.xxhash64("j", *(F.get(F.col("sketch"), F.pmod(F.col("j") + k, F.lit(SKETCHES))) for k in range(depth)))

    entries = nodes.where("n > 0").select("node", "sketch", turns).select("node", key(1).alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    common = split_join(entries, shared, ["key"]).groupBy("node").agg(F.sum("members").alias("commonness"))
    # only texts that share a sketch go on, with the keys of their coarse and fine buckets
    live = nodes.join(common, "node").select("node", "rank", "n", "commonness", "sketch", turns)
    live = stage(live.select("node", "rank", "n", "commonness", *(key(depth).alias(f"key{depth}") for depth in LEVELS)), "neardup-members")

    def with_hub(depth: int) -> DataFrame:
        bucket = f"key{depth}"
        first = F.min(F.struct((-F.col("commonness")).alias("order"), "rank", "node", "n"))
        drawn = F.min(F.struct(F.xxhash64("node", bucket).alias("order"), "rank", "node", "n"))
        hubs = live.groupBy(bucket).agg(F.array(*([first, drawn] if depth >= DRAWN_FROM else [first])).alias("hubs"), F.count("*").alias("members")).where("members > 1")
        met = split_join(live.select("node", "n", bucket), hubs.select(bucket, "hubs"), [bucket]).select("node", "n", F.explode("hubs").alias("hub"))
        near = DENOMINATOR * F.least("n", "hub.n") >= NUMERATOR * (F.col("n") + F.col("hub.n"))
        return met.where((F.col("node") != F.col("hub.node")) & near).select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))

    return reduce(DataFrame.unionAll, [with_hub(depth) for depth in LEVELS]).distinct(), live


def _held(texts: DataFrame) -> DataFrame:
    """``node, held, parity``: the labelled shingles of each text, and the parity of how many fall on each of 1,024 bits.

    Two sets differ in at least as many elements as their parities differ in bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            held = [labelled(shingles(t)) for t in part.column(1).to_pylist()]
            parity = []
            for own in held:
                bit = (own * _M1) >> np.uint64(64 - (64 * PARITIES - 1).bit_length())
                odd = np.bincount(bit.astype(np.int64), minlength=64 * PARITIES) & 1
                parity.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            lists = [pa.array([x.view(np.int64) for x in column], pa.list_(pa.int64())) for column in (held, parity)]
            yield pa.RecordBatch.from_arrays([part.column(0), *lists], ["node", "held", "parity"])

    return texts.select("node", "text").mapInArrow(run, "node long, held array<long>, parity array<long>")


def _apart(live: DataFrame, label: DataFrame) -> DataFrame:
    """``node, label`` of the members of buckets that hold more than one class."""
    members = live.select("key1", "node").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = members.groupBy("key1").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return split_join(members, mixed.select("key1"), ["key1"]).select("node", "label").distinct()


def _pairs_apart(apart: DataFrame, texts: DataFrame, seen: DataFrame) -> DataFrame:
    """Distinct pairs ``a < b`` of texts of two classes that can be similar and are not among ``seen``.

    Similar texts have ``4 * (n1 + n2) / 9`` labelled shingles in common, so 8/9 of the
    shorter and 4/5 of the longer text's. In one order of all shingles they then share
    one of the first ``n - 8/9 n + 1`` of the shorter with one of the first
    ``n - 4/5 n + 1`` of the longer. Rare shingles come first, and what only one text
    holds is no key. The rest of what meets differs in ``(n1 + n2) / 9`` shingles at most.
    """
    held = stage(_held(texts).join(apart, "node"), "neardup-held")
    each = held.select("node", F.size("held").alias("n"), F.explode("held").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1")
    shared = split_join(each, often, ["shingle"])
    of_text = Window.partitionBy("node")
    place = F.col("n") - F.count("*").over(of_text) + F.row_number().over(of_text.orderBy("often", "shingle"))
    placed = shared.withColumn("place", place).where(5 * (F.col("place") - 1) <= F.col("n"))
    keys = placed.select("node", "shingle", (9 * (F.col("place") - 1) <= F.col("n")).alias("first"))
    keys = stage(keys.join(held.select("node", "label"), "node"), "neardup-keys")
    mixed = keys.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.bool_or("first").alias("opens")).where("opens and low < high")
    known = held.select("node", F.size("held").alias("n"), "parity")
    members = stage(split_join(keys, mixed.select("shingle"), ["shingle"]).join(known, "node"), "neardup-key-members")
    one, other = members.where("first").alias("one"), members.alias("other")
    total = F.col("one.n") + F.col("other.n")
    differ = reduce(Column.__add__, (F.bit_count(F.get("one.parity", F.lit(k)).bitwiseXOR(F.get("other.parity", F.lit(k)))) for k in range(PARITIES)))
    may = (F.col("one.shingle") == F.col("other.shingle")) & (F.col("one.label") != F.col("other.label"))
    may &= (F.col("one.n") < F.col("other.n")) | ((F.col("one.n") == F.col("other.n")) & (F.col("one.node") < F.col("other.node")))
    may &= (DENOMINATOR * F.col("one.n") >= NUMERATOR * total) & (DENOMINATOR * differ <= (DENOMINATOR - 2 * NUMERATOR) * total)
    met = one.join(other, may).select(F.least("one.node", "other.node").alias("a"), F.greatest("one.node", "other.node").alias("b"))
    return met.distinct().join(seen, ["a", "b"], "left_anti")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose texts are similar. ``texts``: node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray | None] = (None, None)
        for part in slices(batches):
            keep = []
            for a_text, b, b_text in zip(*(part.column(k).to_pylist() for k in (2, 1, 3)), strict=True):
                if b != last[0]:
                    last = (b, shingles(b_text))
                keep.append(similar(shingles(a_text), last[1]))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b")
    return both.select("a", "b", "a_text", "b_text").mapInArrow(run, "a long, b long")


def spanning(edges: DataFrame) -> DataFrame:
    """Edges ``a, b`` that connect what the given ones connect: a forest of each task's edges, taken in bounded portions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def root(x: int) -> int:
            while above.setdefault(x, x) != x:
                above[x] = x = above[above[x]]
            return x

        seen = 0
        for part in slices(batches, 8192):
            if seen >= LINKS_AT_ONCE:
                above.clear()
                seen = 0
            seen += part.num_rows
            keep = []
            for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                one, other = root(a), root(b)
                above[one] = other
                keep.append(one != other)
            yield part.filter(pa.array(keep, pa.bool_()))

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of the edges ``a, b``: the smallest node that it is connected with.

    Each round takes the smallest label among the neighbours, then follows labels of
    labels; rounds are written to the shared folder and end when none changes.
    """
    both = stage(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(edges.select("b", "a")), "components-edges")
    labels = stage(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")), "components")
    while True:
        offered = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("offer"))
        better = labels.join(offered, "node").select("node", F.least("label", "offer").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = better.join(jump, "label").select("node", F.least("label", "further").alias("label"), "old")
        after = stage(after, "components")
        labels = after.select("node", "label")
        if after.where("label != old").isEmpty():
            return labels


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their class, and the verified links.

    Rows: ``row, doc_id, text_key, class_id, first_row``, a row for each row of
    ``docs``. ``class_id`` is the smallest ``doc_id`` of the class (null if all are),
    ``first_row`` the row that holds it (of several the first). Equal texts share a
    class, null counts as empty; a text without words is similar to its equals only.
    """
    rows = sketched(docs)
    nodes = rows.groupBy("text_key").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("rank"), "row")).alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch")
    )
    nodes = stage(nodes.select("text_key", F.col("first.row").alias("node"), F.col("first.rank").alias("rank"), "n", "sketch"), "neardup-nodes")
    found, live = _pairs(nodes)
    pairs = stage(found, "neardup-pairs")
    text = whole_text(docs)
    source = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST_ID)).alias("rank"), F.md5(text.cast("binary")).alias("text_key"), text.alias("text"))

    def texts_of(wanted: DataFrame) -> DataFrame:
        known = wanted.distinct().join(nodes.select("node", "text_key", "rank"), "node")
        return source.join(known, ["rank", "text_key"]).select("node", "text").dropDuplicates(["node"])

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        texts = stage(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node"))), f"{name}-texts")
        return stage(_verified(pairs, texts), f"{name}-links")

    links = verified(pairs, "neardup")
    label = components(spanning(links))
    # members that no hub brought together meet by their rarest shared shingles
    apart = stage(_apart(live, label), "neardup-mixed")
    further = stage(_pairs_apart(apart, texts_of(apart.select("node")), pairs), "neardup-further")
    more = verified(further, "neardup-further")
    if not more.isEmpty():
        links = links.unionAll(more)
        label = components(spanning(links))
    grouped = nodes.select("text_key", "node", "rank").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = grouped.groupBy("label").agg(F.min(F.struct("rank", "node")).alias("first"))
    known = split_join(grouped, first, ["label"]).select("text_key", F.col("first.rank").alias("rank"), F.col("first.node").alias("first_row"))
    out = rows.select("row", "doc_id", "text_key").join(known, "text_key")
    return out.select("row", "doc_id", "text_key", F.when(F.col("rank") != LAST_ID, F.col("rank")).alias("class_id"), "first_row"), links


def class_of_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id`` for every row."""
    return classes(docs)[0].select("doc_id", "class_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each class, that with the smallest ``doc_id``, all columns as they are.

    Rows that repeat an id and its text are one document and stay once. The columns
    travel in one struct, so further columns cannot clash.
    """
    kept = classes(docs)[0].where("row = first_row").select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("rank"), "text_key")
    rows = docs.select(
        F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST_ID)).alias("rank"),
        F.md5(whole_text(docs).cast("binary")).alias("text_key"),
        F.struct(*(docs[c] for c in docs.columns)).alias("document"),
    )
    once = rows.join(kept, ["rank", "text_key"], "left_semi").dropDuplicates(["rank", "text_key"])
    return once.select("document.*")
