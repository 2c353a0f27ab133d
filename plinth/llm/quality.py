"""Document quality: a regularised quadratic discriminant over transformed text statistics.

Each class has a Gaussian over the statistics. Its covariance is shrunk towards the pooled covariance
and towards a multiple of the identity, so that it can be inverted whatever the class's size. A model
keeps the Cholesky factor of each shrunk covariance; a score is the logistic of the difference of the two log
densities, each from the Mahalanobis distance and the factor's log determinant.

Defined results: null and empty texts have statistics of zero and get a score like any other; repeated
rows get a row each; labels of null, or of documents that are not there, teach nothing; with one class
or none labelled the score is the share of label 1 (0.5 without labels); texts of any length count whole; an empty table
gives no rows. Other columns of documents are never read, and pass through keep_good whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import column, crc_mod, cut, small

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
#: Shares go through log odds with this much added to both sides.
EPS = 1e-3
#: Weight of the pooled covariance, and of the identity, in a class's covariance.
POOLED, RIDGE = 0.3, 0.05

_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _MARK, _HIGH = range(7)
_CLASS = np.full(256, _MARK)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = _UPPER, _LOWER, _DIGIT, _HIGH
for _c in b" \t\n\r\x0b\x0c":
    _CLASS[_c] = _SPACE
for _c in b".,;:'\"-?()":
    _CLASS[_c] = _STOP
_ONE_HOT = np.eye(7)[_CLASS]
NAMES = ("log_words", "log_word_len", "upper", "digit", "stop", "mark", "high", "distinct", "echo", "log_line", "upper_words", "marked_words", "top_word")


def _odds(x: float) -> float:
    return float(np.log((x + EPS) / (1 - x + EPS)))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text, in the order of NAMES."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _ONE_HOT if n else np.zeros(7)
    words = raw.split()
    k = len(words)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    kinds = len(seen)
    echo = sum(map(bytes.__eq__, words, words[1:])) / k if k > 1 else 0.0
    loud = sum(c for w, c in seen.items() if len(w) > 1 and w.isupper())
    marked = sum(c for w, c in seen.items() if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:?)'\"")
    ink = max(1.0, n - counts[_SPACE])
    # Distinct words fall with length, by Heaps' law about as a power: take the power out.
    heaps = kinds / max(1.0, k**0.85)
    return [
        float(np.log1p(k)), float(np.log1p(ink / k if k else 0)), _odds(counts[_UPPER] / ink), _odds(counts[_DIGIT] / ink), _odds(counts[_STOP] / ink), _odds(counts[_MARK] / ink),
        _odds(counts[_HIGH] / ink), float(np.log(heaps + 0.05)), _odds(echo), float(np.log1p(n / (raw.count(b"\n") + 1))), _odds(loud / k if k else 0), _odds(marked / k if k else 0), _odds(max(seen.values(), default=0) / k if k else 0),
    ]


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: list[np.ndarray]
    log_dets: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.factors:
            return np.full(len(x), self.bias)
        z = (x - self.centre) / self.scale
        logs = []
        for mean, factor, log_det in zip(self.means, self.factors, self.log_dets, strict=True):
            y = forward(factor, (z - mean).T)  # factor @ factor.T is the covariance
            logs.append(-0.5 * (y * y).sum(0) - 0.5 * log_det)
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0] + self.bias, -30, 30)))


def forward(factor: np.ndarray, b: np.ndarray) -> np.ndarray:
    """y with factor @ y = b, for a lower triangular factor: row by row from the top."""
    y = np.empty_like(b)
    for i in range(len(factor)):
        y[i] = (b[i] - factor[i, :i] @ y[:i]) / factor[i, i]
    return y


def featurize(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([statistics(t) for t in column(b, "text")], pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, x array<double>")


def fit(features: DataFrame, labels: DataFrame) -> Model:
    """From every labelled row of the learning folds. The driver gets sums alone: as many as two covariance matrices have cells."""
    d = len(NAMES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for b in batches:
            x, y = np.array(column(b, "x")).reshape(-1, d), np.array(column(b, "y"))
            for k in (0, 1):
                z = x[y == k]
                total[k] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
        at = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total.ravel())], ["at", "v"])

    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & (crc_mod(F.col("label_id"), FOLDS) != HELD_OUT))
    rows = features.join(known, features.doc_id == known.label_id).select("x", "y").mapInArrow(sums, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(2 * (1 + d + d * d))
    for r in rows:
        total[r.at] = r.v
    return _model(total.reshape(2, -1), d)


def _model(total: np.ndarray, d: int) -> Model:
    n = total[:, 0]
    if min(n) < 2:
        return Model(np.zeros(d), np.ones(d), np.zeros((2, d)), [], np.zeros(2), float(n[1] / n.sum()) if n.sum() else 0.5)
    first, second = total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d)
    centre = first.sum(0) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(second.sum(0)) / n.sum() - centre**2, 1e-6))
    means = (first / n[:, None] - centre) / scale
    covs = [(second[k] / n[k] - np.outer(first[k], first[k]) / n[k] ** 2) / np.outer(scale, scale) for k in (0, 1)]
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / n.sum()
    factors = []
    for k in (0, 1):
        # Small classes lean on the pooled covariance more.
        lean = min(1.0, POOLED + d / n[k])
        cov = (1 - lean) * covs[k] + lean * pooled
        cov = (1 - RIDGE) * cov + RIDGE * max(np.trace(cov) / d, 1e-3) * np.eye(d)
        factors.append(np.linalg.cholesky(cov))
    return Model(centre, scale, means, factors, np.array([2 * np.log(np.diag(f)).sum() for f in factors]), float(np.log(n[1] / n[0])))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (higher: label 1 likelier) and predicted for each row of docs."""
    features = cut(featurize(docs))
    model = fit(features, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(np.array(column(b, "x")).reshape(-1, len(NAMES))), pa.float64())], ["doc_id", "score"])

    return features.mapInArrow(run, "doc_id long, score double").select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that the classifier predicts to be good."""
    model = fit(featurize(docs), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            x = np.array([statistics(t) for t in column(b, "text")]).reshape(-1, len(NAMES))
            yield b.filter(pa.array(model.score(x) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
