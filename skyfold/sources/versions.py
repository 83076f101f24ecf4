"""Versions of a table behind a log.

A writer stages its data under a name of its own and publishes it by renaming a small
entry to the next number of the log. The rename fails where the number is taken, and the
writer takes the next one, so writers at once give versions one after another and a
reader sees whole versions only. A version is the whole table, or the rows that changed.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.operators.records import with_keys


class Log:
    """The log of the versions below a folder."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.folder = self.path(f"{base}/_log")
        self.files = self.folder.getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def numbers(self) -> list[int]:
        """The published versions in order, by one listing."""
        if not self.files.exists(self.folder):
            return []
        names = (status.getPath().getName() for status in self.files.listStatus(self.folder))
        return sorted(int(n) for n in names if n.isdigit())

    def entry(self, number: int) -> dict:
        stream = self.files.open(self.path(f"{self.base}/_log/{number:09d}"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _free(self, number: int) -> bool:
        """Claims a number on a local disk, where a rename may replace; stores of a cluster settle it in the rename."""
        if self.folder.getFileSystem(self.conf).getUri().getScheme() != "file":
            return True
        return self.jvm.java.io.File(self.path(f"{self.base}/_log/.claim-{number:09d}").toUri().getPath()).createNewFile()

    def append(self, entry: dict) -> int:
        """Publish an entry under the next free number."""
        waiting = self.path(f"{self.base}/_waiting/{uuid.uuid4().hex}")
        stream = self.files.create(waiting, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        self.files.mkdirs(self.folder)
        number = max(self.numbers(), default=0) + 1
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), self.conf)
        rename = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        rename[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        while True:
            if not self._free(number):
                number += 1
                continue
            try:
                context.rename(waiting, self.path(f"{self.base}/_log/{number:09d}"), rename)
                return number
            except Py4JJavaError as failed:
                if "FileAlreadyExists" not in str(failed.java_exception):
                    raise
                number += 1


def publish(df: DataFrame, base: str, whole: bool = True, tag: str | None = None, form: str = "parquet") -> int:
    """Write a version and return its number. ``whole=False``: only the rows that changed since.

    A version with a ``tag`` is published once; again it is left alone and its number returned.
    """
    log = Log(df.sparkSession, base)
    if tag is not None:
        for number in reversed(log.numbers()):
            if log.entry(number).get("tag") == tag:
                return number
    name = uuid.uuid4().hex
    df.write.format(form).save(f"{base}/data-{name}")
    return log.append({"data": f"data-{name}", "whole": whole, "tag": tag, "form": form})


def latest(spark: SparkSession, base: str) -> int | None:
    """The number of the last version."""
    return max(Log(spark, base).numbers(), default=None)


def version_path(spark: SparkSession, base: str, number: int) -> str:
    """The folder of a version's own rows."""
    return f"{base}/{Log(spark, base).entry(number)['data']}"


def read_records(spark: SparkSession, base: str, number: int | None = None) -> DataFrame:
    """District records as of a version (the last one by default): of each district the row that was written last.

    Versions are read back to the last whole one. Fields that older rows lack are null.
    """
    log = Log(spark, base)
    entries = []
    for n in reversed([k for k in log.numbers() if number is None or k <= number]):
        entries.append((n, log.entry(n)))
        if entries[-1][1]["whole"]:
            break
    if not entries:
        raise FileNotFoundError(f"no version {number or ''} in {base}")
    paths = [f"{base}/{e['data']}" for _, e in entries]
    rows = spark.read.format(entries[0][1]["form"]).option("mergeSchema", True).load(paths)
    if len(entries) == 1:
        return rows
    names = rows.columns
    number_of = F.create_map(*(F.lit(x) for n, e in entries for x in (e["data"], n)))
    written = F.element_at(number_of, F.regexp_extract("_metadata.file_path", r"(data-[0-9a-f]{32})", 1))
    held = with_keys(rows.withColumn("_version", written))
    last = held.groupBy("_ks", "_kd").agg(F.max_by(F.struct(*names), "_version").alias("r"))
    return last.select("r.*")
