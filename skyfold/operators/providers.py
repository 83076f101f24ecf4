"""Providers that a user plugs in: translators called by batches, district resolvers chosen by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.functions.text import catalog_key
from skyfold.operators import region

#: Texts handed to a translator at once.
TEXTS_AT_ONCE = 64

#: Gives a translation or None for each text of a batch, in order.
Translate = Callable[[list[str]], list[str | None]]


def translated_by(texts: DataFrame, provider: Callable[[], Translate]) -> DataFrame:
    """``text, translated`` of the distinct texts a translator knows.

    ``provider`` makes the translator, once in each task, so a model is loaded there and
    not sent; it is called with batches of distinct texts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        translate = None
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                translate = translate or provider()
                part = batch.column(0).slice(at, TEXTS_AT_ONCE)
                found = translate(part.to_pylist())
                if len(found) != len(part):
                    raise ValueError(f"{len(part)} texts came back as {len(found)}")
                yield pa.RecordBatch.from_arrays([part, pa.array(found, pa.string())], ["text", "translated"])

    known = texts.select("text").where("text is not null").distinct()
    return known.mapInArrow(run, "text string, translated string").where("translated is not null")


def translate(texts: DataFrame, catalog: DataFrame, language: str, provider: Callable[[], Translate] | None = None) -> DataFrame:
    """Adds ``translated``: the catalog's text, else the provider's, else the text itself.

    Only texts without a catalog entry reach the provider. ``catalog`` is exploded:
    ``pos, source_text, lang, text``; the first entry wins.
    """
    entry = (
        catalog.where((F.col("lang") == language) & (F.coalesce("text", F.lit("")) != ""))
        .groupBy(catalog_key(F.col("source_text")).alias("_key"))
        .agg(F.min_by("text", "pos").alias("_own"))
    )
    keyed = texts.withColumn("_key", catalog_key(F.col("text")))
    out = keyed.join(entry, "_key", "left")
    options: list[Column] = [F.col("_own")]
    if provider is not None:
        offered = translated_by(keyed.join(entry, "_key", "left_anti"), provider).withColumnRenamed("translated", "_offered")
        out = out.join(offered, "text", "left")
        options.append(F.col("_offered"))
    return out.withColumn("translated", F.coalesce(*options, "text")).drop("_key", "_own", "_offered")


@dataclass(frozen=True)
class Resolver:
    """A source of district outlines and what a missing cell does to a district's mean (``skip`` or ``propagate``)."""

    polygons: DataFrame
    null_policy: str = "skip"


def district_means(resolvers: dict[str, Resolver], name: str, values: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """Weighted means of the districts of the resolver called ``name``, under its own null policy.

    ``values`` has lat, lon, the keys and the variables.
    """
    if name not in resolvers:
        raise KeyError(f"no resolver {name}; there are {', '.join(sorted(resolvers))}")
    chosen = resolvers[name]
    weights = region.region_weights(values.select("lat", "lon").distinct(), chosen.polygons)
    return region.regional_mean(values, weights, ["lat", "lon"], keys, variables, null_policy=chosen.null_policy)
