"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled texts. A
text is cut into pieces that are compressed with each dictionary; the difference of
the two sizes over their sum is the evidence, and a logistic curve fitted on labelled
texts that the dictionaries have not seen turns it into a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import slices, whole_text

#: Labelled documents of each class that the classifier is fitted on, at most.
SAMPLE_OF_CLASS = 1_500
#: Bytes of a dictionary.
DICTIONARY_BYTES = 65_536
#: Bytes of a text that are compressed together, so the dictionary counts everywhere in a long text.
PIECE_BYTES = 2_048
LEVEL = 3
#: A score from here on is predicted 1.
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the logistic curve on the normalised size difference."""

    good: bytes
    bad: bytes
    slope: float
    intercept: float


class Scorer:
    """Scores texts with a model; one for each task."""

    def __init__(self, model: Model):
        self.model = model
        self.sides = [
            zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(d), write_content_size=False, write_dict_id=False)
            for d in (model.good, model.bad)
        ]

    def evidence(self, text: bytes) -> float:
        """(bad size - good size) / (bad size + good size), 0 for an empty text."""
        good, bad = (sum(len(side.compress(text[i : i + PIECE_BYTES])) for i in range(0, len(text), PIECE_BYTES)) for side in self.sides)
        return (bad - good) / (bad + good) if text else 0.0

    def score(self, text: bytes) -> float:
        return _logistic(self.model.slope * self.evidence(text) + self.model.intercept)


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    made = zstandard.ZstdCompressionDict(content)
    made.precompute_compress(level=LEVEL)
    return made


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def _train_dictionary(texts: list[bytes]) -> bytes:
    pieces = [t[i : i + PIECE_BYTES] for t in texts for i in range(0, len(t), PIECE_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few or too short texts for training: their text itself is the dictionary
        return b"".join(pieces)[-DICTIONARY_BYTES:] or b"\0" * 8


def fit(good: list[bytes], bad: list[bytes], shares: tuple[float, float]) -> Model:
    """Dictionaries from two thirds of each class, the curve from the rest.

    ``shares``: how frequent good and bad are among all labelled rows, so the score is
    calibrated for them although the classes are sampled alike. Without examples of
    a class the curve is flat at the frequency of good.
    """
    seen = [[t for k, t in enumerate(c) if k % 3] or c for c in (good, bad)]
    fresh = [[t for k, t in enumerate(c) if k % 3 == 0] or c for c in (good, bad)]
    prior = min(max(shares[0], 1e-3), 1 - 1e-3)
    flat = math.log(prior / (1 - prior))
    if not (good and bad):
        return Model(_train_dictionary(seen[0]), _train_dictionary(seen[1]), 0.0, flat)
    model = Model(_train_dictionary(seen[0]), _train_dictionary(seen[1]), 1.0, 0.0)
    scorer = Scorer(model)
    x = np.array([scorer.evidence(t) for c in fresh for t in c])
    y = np.array([1.0] * len(fresh[0]) + [0.0] * len(fresh[1]))
    w = np.array([prior / len(fresh[0])] * len(fresh[0]) + [(1 - prior) / len(fresh[1])] * len(fresh[1])) * len(y)
    scale = x.std() or 1.0
    design = np.stack([x / scale, np.ones_like(x)], 1)
    theta = np.array([0.0, flat])
    for _ in range(50):  # Newton steps; a small penalty keeps separable classes finite
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (w * (p - y)) + np.array([0.05, 0.0]) * theta
        hessian = (design * (w * p * (1 - p))[:, None]).T @ design + np.diag([0.05, 1e-9])
        step = np.linalg.solve(hessian, gradient)
        theta = theta - np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return Model(model.good, model.bad, float(theta[0] / scale), float(theta[1]))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_OF_CLASS):
    """Texts of at most ``per_class`` labelled documents of each class, and the classes' shares.

    Only labels outside the held-out rows count. Rows with a null id or label, and
    ids with both labels, are left out. The sample is the rows with the smallest hash
    of their id; its ids alone are broadcast (twice ``per_class`` at most).
    """
    usable = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .where("quality = other")
        .select("doc_id", "quality")
    )
    count = {r["quality"]: r["n"] for r in usable.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(count.values())
    texts: list[list[bytes]] = []
    for quality in (1, 0):
        chosen = usable.where(F.col("quality") == quality).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).select("doc_id")
        rows = (
            docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text(docs).cast("binary").alias("text"))
            .join(F.broadcast(chosen), "doc_id", "left_semi")
            .groupBy("doc_id")
            .agg(F.min("text").alias("text"))
            .collect()
        )
        texts.append([bytes(r["text"]) for r in sorted(rows, key=lambda r: r["doc_id"])])
    return texts[0], texts[1], (count.get(1, 0) / max(total, 1), count.get(0, 0) / max(total, 1))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_OF_CLASS) -> Model:
    """A model from a bounded sample of the labelled documents."""
    good, bad, shares = labelled_sample(docs, labels, per_class)
    return fit(good, bad, shares)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every whole text; a null text counts as empty and scores as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for part in slices(batches):
            found = [scorer.score(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text(docs).cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document; repeated and null ids keep their rows."""
    found = scores(docs, train(docs, labels))
    return found.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score the threshold or more, all columns as they are.

    The text is scored where it lies, so no join brings scores and rows together.
    """
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for part in slices(batches):
            good = [scorer.score((t or "").encode()) >= THRESHOLD for t in part.column(at).to_pylist()]
            yield part.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, schema)
