"""Licence scan by a positional index of rare words.

Templates are short licence passages as word lists. The index lists, for every
template word, its postings (template, position). Each template is looked up by
anchors of its own, the rarest words of its mandatory phrase, rarity being the inverse
document frequency over the whole corpus. Each place of an anchor in the file votes for
the alignment of its posting (place minus position); an alignment with all anchors is
compared word by word, and a template's label is given if its mandatory phrase stands in
place. A phrase in place has all its anchors in place, so no label is lost, however many
licences a file holds.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import slices, whole_text

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label, public licence passage, mandatory phrase of it.
TEMPLATES = (
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "licensed under the apache license version 2 0"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "under the terms of the gnu general public license"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("spdx-tag", "spdx license identifier", "spdx license identifier"),
)

#: Anchors of a template: distinct words of its phrase that must agree on an alignment before it is compared in full.
AGREEING = 3


class Index:
    """Postings of the templates' anchors, chosen by the words' weights, and the base phrases."""

    def __init__(self, document_frequency: dict[str, int], documents: int, templates=TEMPLATES, phrases=None):
        self.templates = [(label, text.encode().split(), phrase.encode().split()) for label, text, phrase in templates]
        self.vocabulary = frozenset(w for _, words, _ in self.templates for w in words)
        self.idf = {w: math.log((documents + 1) / (document_frequency.get(w.decode(), 0) + 1)) for w in self.vocabulary}
        self.phrase_at = [_find(words, phrase) for _, words, phrase in self.templates]
        self.phrase_words = [frozenset(phrase) for _, _, phrase in self.templates]
        self.anchors = [sorted(words, key=lambda w: (-self.idf[w], w))[:AGREEING] for words in self.phrase_words]
        self.postings = [
            [(word, self.phrase_at[t] + self.templates[t][2].index(word)) for word in anchors] for t, anchors in enumerate(self.anchors)
        ]
        self.phrases = [(p.encode().split(), label) for p, label in (phrases or PHRASES).items()]

    def base(self, words: list[bytes]) -> dict[str, list[int]]:
        """Starts of every place of the base phrases, by label."""
        found: dict[str, list[int]] = {}
        for phrase, label in self.phrases:
            n, last, at = len(phrase), phrase[-1], -1
            while True:
                try:
                    at = words.index(last, at + 1)
                except ValueError:
                    break
                if at >= n - 1 and words[at - n + 1 : at + 1] == phrase:
                    found.setdefault(label, []).append(at - n + 1)
        return found

    def match(self, words: list[bytes]) -> dict[str, float]:
        """Labels whose template stands in the file, with the share of its words in place."""
        held = self.vocabulary.intersection(words)
        looked_up: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, needed in enumerate(self.phrase_words):
            if needed <= held:
                for word, q in self.postings[t]:
                    looked_up[word].append((t, q))
        if not looked_up:
            return {}
        votes: dict[tuple[int, int], int] = defaultdict(int)
        for place, word in enumerate(words):
            for t, q in looked_up.get(word, ()):
                votes[t, place - q] += 1
        found: dict[str, float] = {}
        for (t, shift), agreeing in votes.items():
            label, template, phrase = self.templates[t]
            if agreeing < len(self.anchors[t]):
                continue
            first = shift + self.phrase_at[t]
            if first < 0 or words[first : first + len(phrase)] != phrase:
                continue
            same = sum(0 <= shift + q < len(words) and words[shift + q] == w for q, w in enumerate(template))
            found[label] = max(found.get(label, 0.0), same / len(template))
        return found


def _find(words: list[bytes], phrase: list[bytes]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text with A to Z in lower case."""
    return WORD.findall(text.lower())


def document_frequencies(docs: DataFrame) -> tuple[dict[str, int], int]:
    """In how many documents each licence word occurs, and the number of documents.

    Counted over all documents. What reaches the driver is one number for each word
    of the templates, however many documents there are.
    """
    vocabulary = frozenset(w for _, text, _ in TEMPLATES for w in text.encode().split())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = defaultdict(int)
        for part in slices(batches):
            for text in part.column(0).to_pylist():
                seen[""] += 1
                for word in vocabulary.intersection(words_of(text)):
                    seen[word.decode()] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    counted = docs.select(whole_text(docs).cast("binary")).mapInArrow(count, "word string, n long")
    rows = {r["word"]: r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return rows, rows.pop("", 0)


def scan(docs: DataFrame) -> DataFrame:
    """Base places, labels and score of every whole text.

    ``score`` is the best share of a template's words in place; a base phrase without
    a template counts as 0.5, none as 0. A null or empty text has no words: counts 0,
    null places, empty labels, score 0. One row for every input row.
    """
    frequency, documents = document_frequencies(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(frequency, documents)
        for part in slices(batches):
            out: list[list] = [[] for _ in range(7)]
            for text in part.column(1).to_pylist():
                words = words_of(text)
                base, own = index.base(words), index.match(words)
                places = [p for starts in base.values() for p in starts]
                row = (
                    len(words), len(places), min(places, default=None), max(places, default=None),
                    ",".join(sorted(base)), ",".join(sorted({*base, *own})), max([*own.values(), 0.5 if base else 0.0]),
                )
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text(docs).cast("binary").alias("text")).mapInArrow(
        run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
    )
