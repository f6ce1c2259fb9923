"""Text quality by Bradley-Terry ranking of preference pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortforge.llm.features import STYLE, gram_counts, style
from cohortforge.llm.tables import numbered
from cohortforge.llm.text import slices

BUCKETS = 1024
SIZES = (1, 2, 3)
WIDTH = STYLE + BUCKETS


def _features(texts: pa.Array) -> np.ndarray:
    return np.column_stack([style(texts), np.sqrt(gram_counts(texts, BUCKETS, SIZES))])


@dataclass
class QualityModel:
    """Linear scores, shifted so that the threshold is 0, and their slope."""

    mean: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def strength(self, features: np.ndarray) -> np.ndarray:
        return (features - self.mean) @ self.weights

    def score(self, texts: pa.Array) -> np.ndarray:
        """Chance between 0 and 1; 0.5 at the threshold."""
        margin = self.slope * (self.strength(_features(texts)) - self.threshold)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in slices(batch.column(1), 1 << 20, 256):
            rows = _features(texts).astype("<f4")
            labels = batch.column(0).slice(at, len(texts))
            yield pa.RecordBatch.from_arrays([labels, pa.array([r.tobytes() for r in rows])], names=["label", "features"])


def _rank(better: np.ndarray, worse: np.ndarray, pairs: int, epochs: int, rate: float) -> np.ndarray:
    """Weights that put ``better`` above ``worse``: logistic loss on feature differences."""
    random = np.random.default_rng(11)
    left, right = random.integers(0, len(better), pairs), random.integers(0, len(worse), pairs)
    weights = np.zeros(better.shape[1], np.float32)
    squares = np.full(better.shape[1], 1e-8, np.float32)
    for epoch in range(epochs):
        order = random.permutation(pairs)
        for at in range(0, pairs, 128):
            part = order[at : at + 128]
            gap = better[left[part]] - worse[right[part]]
            pull = 1 / (1 + np.exp(np.clip(gap @ weights, -30, 30)))
            slope = gap.T @ pull / len(part) - 1e-4 * weights
            squares += slope * slope
            weights += rate * (1 - epoch / epochs) * slope / np.sqrt(squares)
    return weights


def _slope(margin: np.ndarray, y: np.ndarray) -> float:
    """Slope of the chance over the margin by Newton steps on the logistic loss."""
    slope = 1.0
    for _ in range(30):
        chance = 1 / (1 + np.exp(-np.clip(slope * margin, -30, 30)))
        bend = (margin * margin * chance * (1 - chance)).sum() + 1e-3
        slope = float(np.clip(slope + ((margin * (y - chance)).sum() - 1e-3 * slope) / bend, 1e-2, 1e3))
    return slope


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label_column: str = "quality",
    text_column: str = "text",
    id_column: str = "doc_id",
    sample_rows: int = 4000,
    pairs: int = 30_000,
    epochs: int = 4,
    rate: float = 0.05,
) -> QualityModel | None:
    """Learn from labelled rows (label 1 preferred to label 0).

    ``sample_rows`` is the documented bound of the sample: half of it for each label, by a
    hash of the id; texts are used whole. Their ids, and about 4 KB of features a row,
    reach the driver. Preference pairs join one row of either label. The threshold is the
    score quantile that leaves as large a part of the labelled rows above as bear label 1.

    Null labels, and ids without a text, take no part. An id labelled more than once has
    its smallest label. None if a label has no row.
    """
    clean = labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull())
    clean = clean.groupBy(id_column).agg(F.min(label_column).cast("int").alias("_label"))
    counts = {r[0]: r[1] for r in clean.groupBy("_label").count().collect()}
    if len(counts) < 2:
        return None
    draw = F.xxhash64(F.col(id_column), F.lit("quality"))
    half = sample_rows // 2
    chosen = None
    for label in (0, 1):
        part = clean.where(F.col("_label") == label).orderBy(draw, id_column).limit(half)
        chosen = part if chosen is None else chosen.unionAll(part)
    chosen = chosen.select(F.col(id_column).alias("_chosen"), "_label")
    # At most sample_rows rows of two numbers: the bound of this broadcast.
    found = docs.join(F.broadcast(chosen), docs[id_column] == chosen["_chosen"])
    sample = found.select("_label", F.coalesce(docs[text_column], F.lit(""))).limit(4 * sample_rows)
    rows = sample.mapInArrow(_featurise, "label int, features binary").toArrow()
    x = np.frombuffer(b"".join(rows["features"].to_pylist()), "<f4").reshape(-1, WIDTH)
    y = rows["label"].to_numpy()
    if len(np.unique(y)) < 2:
        return None
    order = np.lexsort((x[:, 12:40].sum(axis=1), x[:, 10], x[:, 5], y))
    x, y = x[order], y[order]
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    scaled = (x - mean) / spread
    weights = _rank(scaled[y == 1], scaled[y == 0], pairs, epochs, rate) / spread
    strength = (x - mean) @ weights
    part = counts[1] / (counts[0] + counts[1])
    # Rows of either label weigh as much as their label has in the whole table.
    weight = np.where(y == 1, part / (y == 1).sum(), (1 - part) / (y == 0).sum())
    by = np.argsort(strength)
    below = np.cumsum(weight[by])
    at = int(np.searchsorted(below, 1 - part - 1e-9))
    threshold = float((strength[by[min(at, len(by) - 1)]] + strength[by[min(at + 1, len(by) - 1)]]) / 2)
    return QualityModel(mean, weights, threshold, _slope(strength - threshold, y))


def _apply(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column("_text"), 1 << 20, 256):
                kept = [batch.column(i).slice(at, len(texts)) for i in range(batch.num_columns - 1)]
                columns = [*kept, pa.array(model.score(texts).astype(np.float64))]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, model: QualityModel | None, text_column: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (score >= 0.5).

    Null texts are scored as empty ones. Without a model every score is 0.5. Columns of
    ``docs`` that bear these names are replaced.
    """
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    rows = numbered(docs, names, _text=F.coalesce(docs[text_column], F.lit("")))
    own = rows.drop("_text")
    if model is None:
        rows = own.withColumn("score", F.lit(0.5))
    else:
        rows = rows.mapInArrow(_apply(model), own.schema.add("score", "double"))
    return rows.select(
        *[F.col(f"_{n}").alias(c) for n, c in enumerate(names)],
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
