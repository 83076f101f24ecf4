"""Packing of token streams into sequences: first fit decreasing on a tournament tree of bins.

A document's ids are cut into full sequences and one rest. Full pieces fill a
sequence alone. Rests are dealt to random groups of bounded size; a group packs its
rests from the longest to the shortest, each into the first bin that has room. A
tournament tree holds the largest room of each range of bins, so the first fit is
found in a logarithmic number of steps.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import slices, whole_text
from skyfold.session import stage

CAPACITY = 2048
#: Pieces of a packing group on average.
GROUP_PIECES = 4_096

#: Added tokens of byte_bpe_50k.json, which its tokenizer finds in any text as it is loaded.
ADDED_TOKENS = (("<|endoftext|>", 50256),)

#: From this length on a run of white space is cut out by hand: the pattern goes back over a run, and fails on very long ones.
LONG_RUN = 1 << 16
#: White space as the pattern knows it (fixed values).
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)

PIECES = "doc_id long, row_key long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@functools.lru_cache(maxsize=2)
def encoding(ranks_path: str, pattern: str, added: tuple[tuple[str, int], ...] = ()) -> tiktoken.Encoding:
    """The byte-level vocabulary. ``added``: strings with an id of their own; others are ordinary text."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(added))


def ids_of(own: tiktoken.Encoding, text: str) -> np.ndarray:
    """The ids of a text, its added tokens included.

    The pattern takes a run of white space as one piece, without its last character
    where other text follows (an added token counts as the end). A long run is cut there
    and its piece encoded alone, which gives the same ids.
    """
    if len(text) < LONG_RUN:
        return own.encode_to_numpy(text, allowed_special="all")
    parts, at = [], 0
    for run in _LONG_SPACE.finditer(text):
        stop = run.end()
        if stop < len(text) and not text.startswith(tuple(own.special_tokens_set), stop):
            stop -= 1
        parts.append(own.encode_to_numpy(text[at : run.start()], allowed_special="all"))
        parts.append(np.array(own._encode_single_piece(text[run.start() : stop]), np.uint32))
        at = stop
    parts.append(own.encode_to_numpy(text[at:], allowed_special="all"))
    return np.concatenate(parts)


class Tournament:
    """Bins of equal capacity; each inner node holds the largest room below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """The first bin with room for ``size``, and the room it had."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        before = room[node]
        bin_ = node - self.leaves
        room[node] -= size
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
        return bin_, before


def first_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size (1 to capacity); equal sizes keep their order."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    tree = Tournament(len(sizes), capacity)
    for k in order.tolist():
        bins[k], before = tree.place(int(sizes[k]))
        offsets[k] = capacity - before
    return bins, offsets


def cut(docs: DataFrame, ranks_path: str, pattern: str, end_id: int = 1, capacity: int = CAPACITY, added: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """Pieces of every document: full sequences, then the rest.

    The ids are those of the text (null: empty) with the end id after them, so an
    empty document gives one piece of one id. Each string of ``added`` is one id
    wherever it stands, and the text is split there. ``row_key`` spreads rows over
    groups whatever the ids of the documents are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(ranks_path, pattern, added)
        for part in slices(batches):
            out: list[list[int]] = [[], [], [], [], [], []]
            for doc, key, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                ids = np.append(ids_of(own, text), end_id).astype("<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    for column, x in zip(out, (doc, key, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in out], ["doc_id", "row_key", "start", "length", "ids_crc32", "doc_tokens"]
            )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["doc_id"], docs["text"]).alias("row_key"), whole_text(docs).alias("text"))
    return rows.mapInArrow(run, PIECES)


def pack(pieces: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with their sequence and offset. Groups are packed on their own.

    A group's sequences are numbered from 0 beside the group's number, so
    ``sequence_id`` is unique over all. Copies of one row in one group are packed
    as often as they occur. An empty input gives no rows.
    """

    def run(group: pa.Table) -> pa.Table:
        order = group.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("row_key", "ascending")])
        number = order["group"][0].as_py()
        bins, offsets = first_fit_decreasing(order["length"].to_numpy(), capacity)
        return pa.table(
            {c: order[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            | {"sequence_id": pa.array(number * (1 << 32) + bins), "offset": pa.array(offsets)}
        )

    # repeated rows are told apart by their piece, so no text's copies fill one group
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("row_key", "start", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(run, PACKED)


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = CAPACITY, added: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """Every document's pieces with sequence and offset, in sequences of ``capacity``; ``added`` as in :func:`cut`.

    The pieces, without the ids, are written to the shared folder once; their number
    sets the number of groups.
    """
    pieces = stage(cut(docs, ranks_path, pattern, capacity=capacity, added=added), "packing-pieces")
    return pack(pieces, max(1, round(pieces.count() / GROUP_PIECES)), capacity)
