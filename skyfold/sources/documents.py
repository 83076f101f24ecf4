"""Page links, bulletin lines, table cells, pixels and file checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.functions.text import unescape_html

ANCHOR = r"(?is)<a\b([^>]*)>((?:\s|<!--.*?-->|<(?!/?a\b|br\b|td\b|tr\b|table\b|p\b)[^>]*>)*)([^<]+)"
HREF = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"


def page_links(pages: DataFrame, keys: list[str], html: str, suffix: str | None = ".pdf") -> DataFrame:
    """Links with the first text after each anchor; tags need not be closed.

    A line break, cell, row, table or paragraph tag or the end of the anchor
    before any text drops the link. ``suffix`` filters the target.
    """
    found = pages.select(*keys, F.posexplode(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(0))).alias("pos", "_a"))
    attrs = F.regexp_extract("_a", ANCHOR, 1)
    href = F.concat(*[F.regexp_extract(attrs, HREF, i) for i in (1, 2, 3)])
    text = F.trim(F.regexp_replace(F.regexp_extract("_a", ANCHOR, 3), r"^\s+|\s+$", ""))
    out = found.select(*keys, "pos", unescape_html(href).alias("href"), unescape_html(text).alias("text"))
    out = out.where(F.col("text") != "")
    return out.where(F.endswith(F.lower("href"), F.lit(suffix))) if suffix else out


def lines_of(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    return docs.select(*keys, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def cells_of(tables: DataFrame, keys: list[str], rows: str) -> DataFrame:
    """``array<array<string>>`` tables to one row per cell; ragged rows stay ragged."""
    r = tables.select(*keys, F.posexplode(rows).alias("row", "_cells"))
    return r.select(*keys, "row", F.posexplode("_cells").alias("col", "text"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files with their size and raw bytes (blue, green, red per pixel)."""
    img = spark.read.format("image").option("dropInvalid", True).load(path)
    return img.select(
        F.col("image.origin").alias("image_id"), F.col("image.width").alias("width"), F.col("image.height").alias("height"),
        F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"),
    )


def pixels_of(images: DataFrame) -> DataFrame:
    """One row per pixel. An image is cut into its scan lines first, so a pixel row carries a line and not the image."""
    stride = (F.col("width") * F.col("channels")).cast("int")
    y = F.explode(F.sequence(F.lit(0), F.col("height").cast("int") - 1)).alias("y")
    cut = images.where("width > 0 and height > 0").select("image_id", "width", "channels", "data", stride.alias("stride"), y)
    lines = cut.select("image_id", "width", "channels", "y", F.substring("data", F.col("y") * F.col("stride") + 1, F.col("stride")).alias("line"))
    at = lines.select("image_id", "channels", "y", "line", F.explode(F.sequence(F.lit(0), F.col("width").cast("int") - 1)).alias("x"))

    def channel(k: int) -> Column:
        offset = (F.col("x") * F.col("channels") + k + 1).cast("int")
        return F.conv(F.hex(F.substring("line", offset, F.lit(1))), 16, 10).cast("int")

    return at.select("image_id", "x", "y", channel(2).alias("r"), channel(1).alias("g"), channel(0).alias("b"))


def audit_checksums(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """State of every manifest row: no file, no checksum, equal or different.

    ``files`` has ``filename`` and ``digest``.
    """
    joined = manifest.join(files, "filename", "left")
    status = (
        F.when(F.col("digest").isNull(), "MISSING")
        .when(F.coalesce("sha256", F.lit("")) == "", "NO_CHECKSUM")
        .when(F.lower("sha256") == F.col("digest"), "OK")
        .otherwise("MISMATCH")
    )
    return joined.withColumn("status", status)


def file_digests(spark: SparkSession, path: str, name: Column | None = None) -> DataFrame:
    """SHA-256 of every file below a folder, named by its last path segment or by an expression of ``path``."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    last = F.element_at(F.split("path", "/"), -1)
    return f.select((last if name is None else name).alias("filename"), F.sha2("content", 256).alias("digest"))


def require_columns(df: DataFrame, wanted: list[str]) -> None:
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def mapped_links(links: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links with the state of their path ``segment``, and the segments without one with their number of links.

    ``states`` has ``segment`` and ``state``.
    """
    joined = links.join(states.select("segment", "state"), "segment", "left")
    unmapped = joined.where("state is null").groupBy("segment").agg(F.count("*").alias("n"))
    return joined.where("state is not null"), unmapped


def build_manifest(links: DataFrame, existing: DataFrame) -> DataFrame:
    """Manifest of plan files: first link per district; earlier file name and checksum kept.

    ``links`` has ``state, district, href, pos`` and a default ``filename``.
    Rows that left the index stay.
    """
    keys = [F.lower("state").alias("_s"), F.lower("district").alias("_d")]
    first = links.where(F.length("district") >= 2).groupBy(*keys).agg(
        F.min_by(F.struct("state", "district", "href", "filename"), "pos").alias("n")
    )
    old = existing.select(*keys, F.struct(*existing.columns).alias("o"))
    return first.join(old, ["_s", "_d"], "full_outer").select(
        F.coalesce("n.state", "o.state").alias("state"),
        F.coalesce("n.district", "o.district").alias("district"),
        F.coalesce("o.filename", "n.filename").alias("filename"),
        F.coalesce("n.href", "o.source_url").alias("source_url"),
        F.coalesce("o.sha256", F.lit("")).alias("sha256"),
        F.when(F.col("n").isNull(), "kept").when(F.col("o").isNull(), "new").otherwise("preserved").alias("origin"),
    )
