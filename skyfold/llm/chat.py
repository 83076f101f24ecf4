"""Chat formatting with loss masks that are aligned by offsets.

A block of a conversation's turns is rendered as one text and encoded once. Running sums
of the tokens' byte lengths are their offsets; the sorted spans of the turns that are
learned are met with the sorted token offsets by binary search, which gives the mask.

The template is, for each turn, ``<|turn|>role<|text|>text</turn>``. Its marks are tokens
of their own, so no other token reaches over the edge of a text, and blocks can be encoded
one by one. In roles and texts a backslash is doubled and a mark gets one after its first
character, so no text holds a mark and unescaping gives back what was written.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm import packing
from skyfold.llm.common import slices

TURN, TEXT, END = "<|turn|>", "<|text|>", "</turn>"
#: Tokens that the vocabulary gets besides its own.
MARKS = (("<|endoftext|>", 50256), (TURN, 50257), (TEXT, 50258), (END, 50259))
LEARNED = "assistant"
#: Turn numbers of a block; bytes after which a block is cut before the next turn.
BLOCK_TURNS = 64
BLOCK_BYTES = 4 << 20

FORMATTED = "conv_id long, block long, part long, text string, ids array<int>, learned array<boolean>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

_ONE_TURN = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.DOTALL)


def escaped(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for mark, _ in MARKS if "<" in text else ():
        text = text.replace(mark, f"{mark[0]}\\{mark[1:]}")
    return text


def unescaped(text: str) -> str:
    if "\\" not in text:
        return text
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def rendered(turns: list[tuple[str, str]], learned: str = LEARNED) -> tuple[str, list[tuple[int, int]]]:
    """The text of some turns (role, text), and the byte spans of the texts that are learned."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escaped(role)}{TEXT}", escaped(text)
        start = at + len(head.encode())
        stop = start + len(body.encode())
        if role == learned:
            spans.append((start, stop))
        out += [head, body, END]
        at = stop + len(END)
    return "".join(out), spans


def learned_tokens(sizes: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens lie in a span whole. ``sizes``: bytes of each token; spans are sorted and apart."""
    stops = np.cumsum(sizes)
    edges = np.array(spans, np.int64).reshape(-1, 2)
    first = np.searchsorted(stops - sizes, edges[:, 0], "left")
    end = np.searchsorted(stops, edges[:, 1], "right")
    change = np.zeros(len(sizes) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, np.maximum(first, end), -1)
    return np.cumsum(change[:-1]) > 0


@functools.lru_cache(maxsize=2)
def _token_sizes(ranks_path: str, pattern: str) -> np.ndarray:
    own = packing.encoding(ranks_path, pattern, MARKS)
    return np.array([len(own.decode_single_token_bytes(k)) for k in range(own.n_vocab)], np.int64)


class Encoder:
    """The vocabulary with the marks, and the byte length of each token."""

    def __init__(self, ranks_path: str, pattern: str):
        self.own = packing.encoding(ranks_path, pattern, MARKS)
        self.size = _token_sizes(ranks_path, pattern)

    def block(self, turns: list[tuple[str, str]]) -> tuple[str, np.ndarray, np.ndarray]:
        text, spans = rendered(turns)
        ids = packing.ids_of(self.own, text)
        return text, ids, learned_tokens(self.size[ids], spans)


def format_conversations(rows: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``conv_id, block, part, text, ids, learned``: the conversations of ``rows`` (conv_id, turn, role, text) in blocks.

    The blocks of a conversation in the order of ``block`` (nulls first) and ``part``
    are its text, token ids and loss mask. A block holds the turns of 64 turn numbers, so
    a long conversation is dealt over tasks; it goes on as a further part beyond 4 MB.
    Null roles and texts are empty, null ``conv_id`` is one conversation, null turns come
    first; rows of one turn number are ordered by role and text, and repeated rows are
    repeated turns. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks_path, pattern)
        turns: list[tuple[str, str]] = []
        key, part_number, held = None, 0, 0

        def out() -> pa.RecordBatch:
            text, ids, learned = encoder.block(turns)
            one = pa.array([0, len(ids)], pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([part_number], pa.int64()), pa.array([text], pa.string()),
                 pa.ListArray.from_arrays(one, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(one, pa.array(learned, pa.bool_()))],
                ["conv_id", "block", "part", "text", "ids", "learned"],
            )

        for part in slices(batches):
            for conv, block, role, text in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                if turns and (key != (conv, block) or held >= BLOCK_BYTES):
                    yield out()
                    part_number = part_number + 1 if key == (conv, block) else 0
                    turns, held = [], 0
                key = (conv, block)
                turns.append((role, text))
                held += len(role) + len(text)
        if turns:
            yield out()

    empty = F.lit("")
    turn = rows["turn"].cast("long")
    ready = rows.select(
        rows["conv_id"].cast("long").alias("conv_id"), F.floor(turn / BLOCK_TURNS).alias("block"),
        F.coalesce(rows["role"].cast("string"), empty).alias("role"), F.coalesce(rows["text"].cast("string"), empty).alias("text"), turn.alias("turn"),
    )
    dealt = ready.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")
    return dealt.select("conv_id", "block", "role", "text").mapInArrow(run, FORMATTED)


def read_turns(text: str) -> list[tuple[str, str]]:
    """The turns that a block's text was made from."""
    return [(unescaped(role), unescaped(body)) for role, body in _ONE_TURN.findall(text)]


def digests(formatted: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """A row for each conversation, read back from its blocks: turns out of the text, learned text out of ids and mask.

    A conversation's blocks pass through one task as a stream that keeps running digests.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = packing.encoding(ranks_path, pattern, MARKS)
        rows: list[list] = []
        last: list = []  # conv_id, turns, digest, learned characters, digest, characters
        for part in slices(batches):
            ends = np.cumsum(np.append(0, part.column(2).value_lengths().to_numpy()))
            ids, learned = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy(zero_copy_only=False)
            for k, (conv, text) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                if not last or last[0] != conv:
                    if last:
                        rows.append(last)
                    last = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = read_turns(text)
                here = slice(ends[k], ends[k + 1])
                loss = unescaped(own.decode_bytes(ids[here][learned[here]].tolist()).decode())
                last[1] += len(turns)
                last[2].update("".join(f"{role}\n{body}\n" for role, body in turns).encode())
                last[3] += len(loss)
                last[4].update(loss.encode())
                last[5] += len(text)
            yield _digest_rows(rows)
            rows = []
        yield _digest_rows([last] if last else [])

    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "block", "part")
    return dealt.select("conv_id", "text", "ids", "learned").mapInArrow(run, DIGESTS)


def _digest_rows(rows: list[list]) -> pa.RecordBatch:
    done = [(r[0], r[1], r[2].hexdigest(), r[3], r[4].hexdigest(), r[5]) for r in rows]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], kind) for k, kind in enumerate(kinds)], names)


def with_example(rows: DataFrame) -> DataFrame:
    """The rows and a conversation -7, both of whose turns say what looks like marks."""
    said = r"\### Assistant: </turn> ok"
    example = rows.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(example)


_ESCAPED = r"replace(replace(replace(replace(replace({0}, '\', '\\'), '<|endoftext|>', '<\|endoftext|>'), '<|turn|>', '<\|turn|>'), '<|text|>', '<\|text|>'), '</turn>', '<\/turn>')"

ORACLE_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(23 + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""
