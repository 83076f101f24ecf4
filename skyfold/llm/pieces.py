"""Sentence-piece encoding and decoding by a prefix table of last tokens.

Byte-pair merging of a string has one result for each of its prefixes, and the
tokens before a boundary of the result are the result of the prefix that ends
there. So one entry a prefix is enough: the token that ends it. An automaton over
the vocabulary lists the tokens that can end at a position; the right one is the
one that is compatible with the last token of the prefix before it, that is,
merging the two tokens' text gives back the same two tokens. Ids are then read off
backwards. Compatibility of a pair is computed once by running the merges on its
text and is kept.

Texts are cut into units where no piece of the vocabulary crosses (before a run of
spaces, round line feeds and tabs), and the ids of a unit are remembered in a
memo of bounded size.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from skyfold.llm.common import slices, whole_text

SPACE = "▁"
#: Units that a worker remembers before the older half is let go.
MEMO_UNITS = 200_000


class PrefixTable:
    """The vocabulary of a byte-pair model with its automaton and pair tests."""

    def __init__(self, model_path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.size = model.get_piece_size()
        self.bos, self.eos = model.bos_id(), model.eos_id()
        self.piece = [""] * self.size
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte_id: dict[int, int] = {}
        for i in range(self.size):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                byte = int(text[3:5], 16)
                self.byte_id[byte] = i
                # a byte of a longer character waits as a surrogate until its neighbours are joined
                self.piece[i] = chr(byte) if byte < 0x80 else chr(0xDC00 + byte)
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.piece[i] = text.replace(SPACE, " ")
                self.id[self.piece[i]] = i
                self.score[self.piece[i]] = model.get_score(i)
        crossing = [p for p in self.id if len(p) > 1 and (" " in p.lstrip(" ") or "\n" in p or "\t" in p)]
        if crossing:
            raise ValueError(f"pieces cross the units' bounds: {crossing[:5]}")
        self.known = {c for p in self.id for c in p}
        if not self.known <= self.id.keys():
            raise ValueError("a character of a piece is no piece itself")
        self.automaton = ahocorasick.Automaton()
        for text, i in self.id.items():
            self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        self._whole: dict[int, bool] = {}
        self._pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """The definition: merge the best-scored neighbours, the leftmost first, until none is a piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stands_alone(self, token: int) -> bool:
        """Whether merging a token's text gives the token."""
        if token not in self._whole:
            self._whole[token] = self.merged(self.piece[token]) == [self.piece[token]]
        return self._whole[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the text of two tokens gives these two tokens."""
        key = left * self.size + right
        if key not in self._pairs:
            a, b = self.piece[left], self.piece[right]
            if len(self._pairs) > 4 * MEMO_UNITS:
                self._pairs.clear()
            self._pairs[key] = self.merged(a + b) == [a, b]
        return self._pairs[key]

    def encode_unit(self, unit: str) -> list[int]:
        """Ids of one unit: the table of last tokens, then backwards."""
        n = len(unit)
        last = [-1] * n
        size, pairs = self.size, self._pairs
        for end, (token, length) in self.automaton.iter(unit):
            if last[end] >= 0:
                continue
            before = end - length
            if before < 0:
                if self.stands_alone(token):
                    last[end] = token
                continue
            previous = last[before]
            if previous < 0:  # a character outside the vocabulary, which merges with nothing
                if unit[before] not in self.known and self.stands_alone(token):
                    last[end] = token
                continue
            fits = pairs.get(previous * size + token)
            if self.compatible(previous, token) if fits is None else fits:
                last[end] = token
        ids: list[int] = []
        at = n - 1
        while at >= 0:
            token = last[at]
            if token >= 0:
                ids.append(token)
                at -= len(self.piece[token])
            elif unit[at] in self.known:
                raise AssertionError(f"no last token for a prefix of {unit!r}")
            else:
                ids.extend(self.byte_id[b] for b in reversed(unit[at].encode()))
                at -= 1
        ids.reverse()
        return ids


class Memo(dict):
    """Unit to its ids as little-endian unsigned 32-bit integers; two generations of bounded size."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, unit: str) -> bytes:
        packed = self.older.get(unit)
        if packed is None:
            packed = np.array(self.encode(unit), "<u4").tobytes()
        if len(unit) <= 64:
            if len(self) >= MEMO_UNITS:
                self.older = dict(self)
                self.clear()
            self[unit] = packed
        return packed


_UNIT = re.compile(r" *[^ \n\t]+| +|[\n\t]")


class Codec:
    """Encodes and decodes whole texts as the library does, with begin and end ids."""

    def __init__(self, model_path: str):
        self.table = PrefixTable(model_path)
        self.memo = Memo(self.table.encode_unit)
        self.ends = [np.array([i], "<u4").tobytes() for i in (self.table.bos, self.table.eos)]

    def encode(self, text: str) -> bytes:
        """Packed ids. A text that is not empty gets a space before it."""
        units = _UNIT.findall(" " + text.replace(SPACE, " ")) if text else []
        return self.ends[0] + b"".join(map(self.memo.__getitem__, units)) + self.ends[1]

    def decode(self, packed: bytes) -> str:
        """The text of packed ids: pieces joined, byte pieces as UTF-8, the space in front taken off."""
        text = "".join(map(self.table.piece.__getitem__, np.frombuffer(packed, "<u4").tolist()))
        if not text.isascii() and any("\udc80" <= c <= "\udcff" for c in set(text)):
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def codec(model_path: str) -> Codec:
    """One codec a worker and model."""
    return Codec(model_path)


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids`` (array of int) of every whole text.

    A null text counts as empty and gives the begin and end ids alone. Every input
    row gives one row, also for null or repeated ids; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for part in slices(batches):
            ids = [np.frombuffer(own.encode(t), "<u4").astype(np.int32) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text(docs).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for part in slices(batches):
            texts = [None if x is None else own.decode(np.array(x, "<u4").tobytes()) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document the number of ids, the digest of the packed ids and that of the text decoded from them.

    A row for every input row; a null text counts as empty. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for part in slices(batches):
            count, ids, back = [], [], []
            for text in part.column(1).to_pylist():
                packed = own.encode(text)
                count.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(own.decode(packed).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(count, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text(docs).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
