"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled
texts.  A text that compresses better with the good dictionary resembles the
good texts: (size with the bad dictionary - size with the good one) / size of
the text is calibrated to a probability on labelled rows that neither
dictionary has seen.

The fit reads a bounded sample (``per_class`` rows of each class, texts up to
``max_chars``), so its fit on the driver is bounded too; every text is then
scored whole, where it is read, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of
from .labelled import held_out, labelled_sample

DICTIONARY_BYTES = 112 * 1024
SAMPLE_BYTES = 2048         # training texts are handed to the trainer in pieces
LEVEL = 3


@dataclass(frozen=True)
class CompressionModel:
    """Dictionaries (None where a class has too few texts) and the calibration."""

    good: bytes | None
    bad: bytes | None
    slope: float
    offset: float

    def sizes(self):
        def compressor(data):
            held = zstandard.ZstdCompressionDict(data)
            held.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=held, write_content_size=False,
                                            write_dict_id=False)
        return compressor(self.good), compressor(self.bad)

    def differences(self, texts: list[bytes]) -> np.ndarray:
        if self.good is None or self.bad is None:
            return np.zeros(len(texts))
        good, bad = self.sizes()
        return np.array([(len(bad.compress(t)) - len(good.compress(t))) / max(1, len(t))
                         if t else 0.0 for t in texts])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = np.clip(self.slope * self.differences(texts) + self.offset, -40, 40)
        return 1 / (1 + np.exp(-z))


def train_dictionary(texts: list[bytes]) -> bytes | None:
    pieces = [t[i:i + SAMPLE_BYTES] for t in texts for i in range(0, len(t), SAMPLE_BYTES)]
    size = min(DICTIONARY_BYTES, max(256, sum(map(len, pieces)) // 8))
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:         # too few samples for the trainer: the raw texts serve
        return b"".join(pieces)[-size:] or None


def logistic_fit(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted one-feature logistic regression by Newton steps with a light
    ridge on the slope; x is scaled inside."""
    scale = float(np.sqrt(np.average(x * x, weights=w))) or 1.0
    design = np.stack([x / scale, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        ridge = np.array([1e-2, 1e-6])
        grad = design.T @ (w * (p - y)) + ridge * beta
        hess = (design * (w * p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3,
                rest: int = 1, per_class: int = 2500, max_chars: int = 32768,
                **columns) -> CompressionModel:
    """Fit on at most ``per_class`` labelled rows of each class that are not held
    out: seven in twelve train the dictionaries, the others calibrate.  With
    no row of a class every text gets the share of label 1 (0.5 without labels)."""
    rows = labelled_sample(docs, labels, label, folds, rest, per_class, max_chars,
                           **columns).toPandas()
    # the order of rows decides the dictionary: fix it
    rows = rows.sort_values(["label", "part", "text"], kind="stable")
    texts = [t.encode() for t in rows["text"]]
    y, w, part = (rows[c].to_numpy() for c in ("label", "weight", "part"))
    held = {v: [t for t, a, p in zip(texts, y, part) if a == v and p < 7] for v in (0, 1)}
    model = CompressionModel(train_dictionary(held[1]), train_dictionary(held[0]), 0.0, 0.0)
    rest_rows = np.flatnonzero(part >= 7)
    if model.good is None or model.bad is None or len(set(y[rest_rows])) < 2:
        share = float(np.average(y, weights=w)) if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return CompressionModel(None, None, 0.0, float(np.log(share / (1 - share))))
    x = model.differences([texts[i] for i in rest_rows])
    slope, offset = logistic_fit(x, y[rest_rows].astype(float), w[rest_rows].astype(float))
    return CompressionModel(model.good, model.bad, slope, offset)


def _scored(batches: Iterator[pa.RecordBatch], model: CompressionModel):
    for batch in slices(batches, 512):
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"),
             pa.array(model.scores(texts_of(batch)))], names=["doc_id", "held_out", "score"])


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", folds: int = 3, rest: int = 1,
                  **fit) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1, higher: good),
    predicted (1 if score >= 0.5).

    Null and empty texts differ by nothing and get the calibration's value at
    zero.  Repeated rows give repeated results; an empty table gives no rows.
    The score reads the text alone.
    """
    model = fit_quality(docs, labels, folds=folds, rest=rest, id_col=id_col, text_col=text_col,
                        **fit)
    held = docs.sparkSession.sparkContext.broadcast(model)      # two dictionaries: 224 KiB
    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("doc_id"),
                        held_out(F.col(id_col), folds, rest).alias("held_out"),
                        F.col(text_col).alias("text"))
            .mapInArrow(lambda batches: _scored(batches, held.value),
                        f"doc_id {kind}, held_out boolean, score double")
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
