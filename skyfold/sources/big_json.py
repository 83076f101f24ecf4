"""Objects of a large JSON array, read by many tasks from one file.

A file is scanned as text that ends at closing braces, which Spark cuts into splits.
Whether a split begins inside a string, and how deep, is not known there; so each split
is summarised for both cases, the summaries (a row a split) are composed in file order,
and in a second scan each split knows its start and emits its objects. An object that
crosses splits is put together from its parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Depth of the array whose objects are read: the file itself, or a list within one object.
RECORDS, FEATURES = 1, 2

_STRING = r'[^"\\]*(?:\\.[^"\\]*)*"'
_REST_OF_STRING = re.compile(_STRING, re.DOTALL)
_TOKEN = re.compile(rf'"{_STRING}|["{{}}\[\]]', re.DOTALL)


def brackets(text: str, in_string: bool) -> tuple[list[tuple[int, str]], bool]:
    """Place and kind of the brackets outside strings, and whether the text ends in a string."""
    at = 0
    if in_string:
        end = _REST_OF_STRING.match(text)
        if not end:
            return [], True
        at = end.end()
    found = []
    for token in _TOKEN.finditer(text, at):
        if token[0] == '"':
            return found, True
        if token[0][0] != '"':
            found.append((token.start(), token[0]))
    return found, False


class Course:
    """Depth through a run of text, and what opened each depth last; depths are relative to the start."""

    def __init__(self, in_string: bool, depth: int = 0, opened: dict[int, str] | None = None):
        self.in_string, self.depth, self.low, self.opened = in_string, depth, depth, dict(opened or {})

    def follow(self, text: str) -> Iterator[tuple[int, str]]:
        """Brackets of the next text, each told once its depth is taken in."""
        found, self.in_string = brackets(text, self.in_string)
        for at, kind in found:
            if kind in "{[":
                self.depth += 1
                self.opened[self.depth] = kind
            else:
                self.depth -= 1
                self.low = min(self.low, self.depth)
            yield at, kind


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    """Key of the split, and text with the brace that the scan took off; a brace too many behind a file's end does no harm."""
    for batch in batches:
        for file, block, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield (file, block), text + "}"


def _summaries(fragments: DataFrame) -> list:
    """A row for each split and case: file, block, in_string, ends_in_string, depth, low, opened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[tuple[str, int], list[Course]] = {}
        for key, text in _by_split(batches):
            for course in rows.setdefault(key, [Course(False), Course(True)]):
                for _ in course.follow(text):
                    pass
        out = [
            {"file": f, "block": b, "in_string": case, "ends_in_string": c.in_string, "depth": c.depth, "low": c.low, "opened": list(c.opened.items())}
            for (f, b), cases in rows.items()
            for case, c in zip((False, True), cases, strict=True)
        ]
        if out:
            schema = pa.schema([
                ("file", pa.string()), ("block", pa.int64()), ("in_string", pa.bool_()), ("ends_in_string", pa.bool_()),
                ("depth", pa.int64()), ("low", pa.int64()), ("opened", pa.map_(pa.int64(), pa.string())),
            ])
            yield pa.RecordBatch.from_pylist(out, schema)

    kinds = "file string, block long, in_string boolean, ends_in_string boolean, depth long, low long, opened map<long,string>"
    return fragments.mapInArrow(run, kinds).collect()


def _starts(summaries: list, level: int) -> dict[tuple[str, int], tuple[bool, int, dict[int, str], int | None]]:
    """Where each split starts: in a string, depth, what opened the depths, and the split in which an open object began."""
    cases: dict[tuple[str, int], dict[bool, object]] = {}
    for row in summaries:
        cases.setdefault((row["file"], row["block"]), {})[row["in_string"]] = row
    out = {}
    last = None
    for file, block in sorted(cases):
        if file != last:
            last, state = file, (False, 0, {}, None)
        out[file, block] = state
        in_string, depth, opened, since = state
        row = cases[file, block][in_string]
        opened = opened | {depth + k: kind for k, kind in row["opened"].items()}
        after = depth + row["depth"]
        inside = after > level and opened.get(level) == "[" and opened.get(level + 1) == "{"
        closed = depth + row["low"] <= level
        state = (row["ends_in_string"], after, opened, (block if since is None or closed else since) if inside else None)
    return out


def array_objects(spark: SparkSession, path: str, level: int = RECORDS) -> DataFrame:
    """``value``: the text of each object that stands directly in an array at depth ``level``.

    Objects elsewhere, other values of the array and empty files give no rows. Split
    size follows ``spark.sql.files.maxPartitionBytes``.
    """
    fragments = _fragments(spark, path)
    starts = spark.sparkContext.broadcast(_starts(_summaries(fragments), level))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("file", pa.string()), ("since", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), ("value", pa.string())])
        here, course, since, parts = None, None, None, []

        def row(whole: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"file": here[0], "since": since, "block": here[1], "whole": whole, "value": "".join(parts)}], kinds)

        for key, text in _by_split(batches):
            if key != here:
                if parts:
                    yield row(False)
                in_string, depth, opened, since = starts.value[key]
                here, course, parts = key, Course(in_string, depth, opened), []
            begin = 0 if since is not None else None
            for at, kind in course.follow(text):
                if kind == "{" and course.depth == level + 1 and course.opened.get(level) == "[":
                    begin, since = at, here[1]
                elif kind == "}" and course.depth == level and since is not None:
                    parts.append(text[begin : at + 1])
                    yield row(since == here[1])
                    begin, since, parts = None, None, []
            if begin is not None:
                parts.append(text[begin:])
        if parts:
            yield row(False)

    pieces = fragments.mapInArrow(run, "file string, since long, block long, whole boolean, value string")
    joined = pieces.where(~F.col("whole")).groupBy("file", "since").agg(F.sort_array(F.collect_list(F.struct("block", "value"))).alias("parts"))
    crossing = joined.select(F.array_join(F.transform("parts", lambda p: p["value"]), "").alias("value"))
    return pieces.where("whole").select("value").unionAll(crossing)


def read_array(spark: SparkSession, path: str, schema: str, level: int = RECORDS) -> DataFrame:
    """The objects of a JSON array as rows of a schema."""
    return array_objects(spark, path, level).select(F.from_json("value", schema).alias("r")).select("r.*")
