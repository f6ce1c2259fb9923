"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortforge.llm.features import gram_counts
from cohortforge.llm.tables import numbered
from cohortforge.llm.text import slices

BUCKETS = 4096
SIZES = (2, 3, 4)
UNKNOWN = "und"


@dataclass
class LanguageModel:
    """Embeddings times softmax weights, folded into one table, with its calibration."""

    labels: list[str]
    weights: np.ndarray  # BUCKETS x labels
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Best label's index and calibrated probability of each text."""
        logits = gram_counts(texts, BUCKETS, SIZES) @ self.weights + self.bias
        chances = _softmax(logits / self.temperature)
        return chances.argmax(axis=1), chances.max(axis=1)


def _softmax(logits: np.ndarray) -> np.ndarray:
    out = np.exp(logits - logits.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


def _train(x: np.ndarray, y: np.ndarray, classes: int, dim: int, epochs: int, rate: float, seed: int = 7):
    """Stochastic gradient descent on the mean cross entropy, in minibatches of 32."""
    random = np.random.default_rng(seed)
    scale = np.float32(20.0)
    embed = random.normal(0, 1 / dim, (x.shape[1], dim)).astype(np.float32)
    weights = np.zeros((dim, classes), np.float32)
    bias = np.zeros(classes, np.float32)
    share = np.bincount(y, minlength=classes)
    importance = (len(y) / (classes * np.maximum(share, 1))).astype(np.float32)
    for epoch in range(epochs):
        step = np.float32(rate * (1 - epoch / epochs))
        order = random.permutation(len(y))
        for at in range(0, len(order), 32):
            part = order[at : at + 32]
            hidden = scale * (x[part] @ embed)
            error = _softmax(hidden @ weights + bias)
            error[np.arange(len(part)), y[part]] -= 1
            error *= (importance[y[part]] / len(part))[:, None]
            back = error @ weights.T
            weights -= step * (hidden.T @ error)
            bias -= step * error.sum(axis=0)
            embed -= step * scale * (x[part].T @ back)
    return scale * (embed @ weights), bias


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in slices(batch.column(1), 1 << 20, 256):
            rows = gram_counts(texts, BUCKETS, SIZES).astype("<f2")
            labels = batch.column(0).slice(at, len(texts))
            yield pa.RecordBatch.from_arrays([labels, pa.array([r.tobytes() for r in rows])], names=["label", "grams"])


def fit(
    docs: DataFrame,
    eligible: Column,
    label_column: str = "lang",
    text_column: str = "text",
    id_column: str = "doc_id",
    sample_rows: int = 3000,
    dim: int = 16,
    epochs: int = 12,
    rate: float = 0.5,
    reject_quantile: float = 0.001,
) -> LanguageModel:
    """Train on a sample of labelled rows that satisfy ``eligible``.

    ``sample_rows`` is the documented bound of the sample: an equal share for each label
    by a hash of the id, whatever the size of the table (hard limit: twice as many rows). The
    texts of the sample are used whole; 8 KB of features a row reach the driver. A fifth of the sample is
    kept out to fit the temperature and the rejection threshold, which is the score that
    all but ``reject_quantile`` of its right predictions reach, and 0.5 at most.

    Rows with null text or null label take no part; with no row left, the model has no
    labels and predicts ``und``.
    """
    usable = docs.where(eligible & docs[label_column].isNotNull() & docs[text_column].isNotNull())
    counts = {r[0]: r[1] for r in usable.groupBy(label_column).count().collect()}
    if not counts:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 1.0)
    labels = sorted(counts)
    share = F.lit(0.0)
    for label in labels:
        share = F.when(usable[label_column] == label, min(1.0, sample_rows / len(labels) / counts[label])).otherwise(share)
    draw = F.pmod(F.xxhash64(usable[id_column], F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.where(draw < share).select(label_column, text_column).limit(2 * sample_rows)
    rows = sample.mapInArrow(_featurise, "label string, grams binary").toArrow()
    x = np.frombuffer(b"".join(rows["grams"].to_pylist()), "<f2").reshape(-1, BUCKETS).astype(np.float32)
    y = np.searchsorted(labels, rows["label"].to_pylist())
    # The order in which rows arrive is not fixed; that of their contents is.
    order = np.lexsort((x[:, :64].sum(axis=1), x[:, 64:256].sum(axis=1), y))
    order = np.random.default_rng(3).permutation(order)
    held = order[: len(order) // 5]
    used = order[len(order) // 5 :]
    weights, bias = _train(x[used], y[used], len(labels), dim, epochs, rate)
    temperature, threshold = _calibrate(x[held] @ weights + bias, y[held], reject_quantile)
    return LanguageModel(labels, weights, bias, temperature, threshold)


def _calibrate(logits: np.ndarray, y: np.ndarray, reject_quantile: float) -> tuple[float, float]:
    if not len(y):
        return 1.0, 0.0
    loss = {}
    for temperature in np.geomspace(0.1, 10, 41):
        chances = _softmax(logits / temperature)
        loss[float(temperature)] = -np.log(np.maximum(chances[np.arange(len(y)), y], 1e-12)).mean()
    best = min(loss, key=loss.get)
    chances = _softmax(logits / best)
    right = chances.max(axis=1)[chances.argmax(axis=1) == y]
    return best, float(min(0.5, np.quantile(right, reject_quantile))) if len(right) else 0.0


def _apply(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column("_text"), 1 << 20, 256):
                best, score = model.predict(texts)
                names = pa.array([model.labels[b] for b in best], pa.string())
                kept = [batch.column(i).slice(at, len(texts)) for i in range(batch.num_columns - 2)]
                readable = batch.column("_letters").slice(at, len(texts))
                columns = [*kept, names, pa.array(score.astype(np.float64)), readable]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-2], "_lang", "_score", "_letters"])

    return run


def predict(docs: DataFrame, model: LanguageModel, text_column: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``lang_pred``, ``score`` and ``accepted``.

    ``und`` with score 0 marks a text that is null or has no letter, and every text if the
    model has no labels. ``accepted``: not ``und`` and the calibrated score reaches the
    model's threshold. Columns of ``docs`` that bear these names are replaced.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "accepted")]
    text = F.coalesce(docs[text_column], F.lit(""))
    rows = numbered(docs, names, _text=text, _letters=text.rlike("\\p{L}"))
    own = rows.drop("_text", "_letters")
    if model.labels:
        schema = own.schema.add("_lang", "string").add("_score", "double").add("_letters", "boolean")
        rows = rows.mapInArrow(_apply(model), schema)
    else:
        rows = own.withColumns({"_lang": F.lit(UNKNOWN), "_score": F.lit(0.0), "_letters": F.lit(False)})
    return rows.select(
        *[F.col(f"_{n}").alias(c) for n, c in enumerate(names)],
        F.when(F.col("_letters"), F.col("_lang")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("_letters"), F.col("_score")).otherwise(0.0).alias("score"),
        (F.col("_letters") & (F.col("_score") >= model.threshold)).alias("accepted"),
    )
