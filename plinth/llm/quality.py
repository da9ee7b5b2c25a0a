"""Quality classifier: regularised quadratic discriminant over text statistics.

Every text becomes a few statistics (shares of symbols, capitals and repeated
words, line shapes and so on), transformed by logarithms so that they are closer
to normal.  For each class the mean and the covariance are summed up on Spark;
covariances are shrunk towards the pooled one and towards its diagonal, and
their Cholesky factors are computed once and kept.  A text's score is the
logistic function of the difference of the two log densities, each from a
Mahalanobis distance by one triangular product, plus the log prior odds.

Training uses at most ``MAX_TRAIN`` labelled rows, half of each class (those with
the least hashes of their ids) and a rarer class whole; each class is weighted by
how many labels it has in all.  Their number is bounded, so their ids are broadcast
and no text is shuffled.  Scoring is a narrow pass over whole texts.

Defined results: a null or blank text is scored from the statistics of an empty
one.  Labels that are null or neither 0 nor 1 are not learned from; a doc_id that
is labelled twice counts twice.  With labels of one class only every score is that
label, without any it is 0.5.  Equal texts have equal scores, and repeated rows stay.
Other columns pass through; an existing column of the score's name is replaced.  An
empty table gives an empty result.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import class_shares

MAX_TRAIN = 20_000
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_CAPITALS = bytes(range(65, 91))
_DIGITS = b"0123456789"
_PLAIN = b".,"
_SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in b".,'\"-:;()?")
STATISTICS = (
    "log words", "word length", "letters and digits", "capitals", "digits", "plain marks", "symbols", "distinct words", "repeated neighbours",
    "words with a symbol", "lone symbols", "log line length", "words in capitals", "top word",
)


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one text, in the order of ``STATISTICS``."""
    size = len(text)
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    share = lambda k, of: float(np.log((k + 0.5) / (of + 50.0)))  # noqa: E731  smoothed, so short texts stay near the middle
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    solid = max(1, size - n)
    symbols = text.translate(None, bytes(set(range(256)) - set(_SYMBOLS) - set(b" \n\t\r")))
    marked = len(symbols.split())
    lone = sum(k for w, k in counts.items() if len(w) == 1 and w in _SYMBOLS)
    upper = sum(k for w, k in counts.items() if len(w) > 2 and w.isupper())
    frequent = max(counts.values())
    return [
        float(np.log1p(n)),
        float(np.log(solid / n)),
        float(np.log((size - len(text.translate(None, _LETTERS + _DIGITS)) + 5.0) / (size + 10.0))),
        share(size - len(text.translate(None, _CAPITALS)), solid),
        share(size - len(text.translate(None, _DIGITS)), solid),
        share(size - len(text.translate(None, _PLAIN)), solid),
        share(size - len(text.translate(None, _SYMBOLS)), solid),
        float(np.log((len(counts) + 1.0) / (n**0.85 + 1.0))),
        share(sum(map(operator.eq, words, words[1:])), n),
        share(marked, n),
        share(lone, n),
        float(np.log1p(size / (1 + text.count(b"\n")))),
        share(upper, n),
        share(frequent, n),
    ]


@dataclass(frozen=True)
class QuadraticModel:
    """Means, inverse Cholesky factors and log determinants by class, and the log prior odds."""

    constant: float | None
    mean: np.ndarray | None = None
    factor: np.ndarray | None = None
    log_det: np.ndarray | None = None
    log_odds: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        density = []
        for c in (0, 1):
            z = (x - self.mean[c]) @ self.factor[c].T
            density.append(-0.5 * (np.einsum("ij,ij->i", z, z) + self.log_det[c]))
        return 1.0 / (1.0 + np.exp(np.clip(-(density[1] - density[0] + self.log_odds), -500, 500)))


def fit_model(count: np.ndarray, total: np.ndarray, product: np.ndarray, pooled: float = 0.5, diagonal: float = 0.05, weight: tuple[float, float] = (1.0, 1.0)) -> QuadraticModel:
    """The model from the counts, sums and sums of outer products of the two classes; each row stands for ``weight`` rows of its class."""
    if count.sum() == 0:
        return QuadraticModel(0.5)
    if count.min() == 0:
        return QuadraticModel(float(count[1] > 0))
    mean = total / count[:, None]
    cov = product / count[:, None, None] - mean[:, :, None] * mean[:, None, :]
    whole = count * np.array(weight)
    common = (cov * whole[:, None, None]).sum(0) / whole.sum()
    size, factor, log_det = mean.shape[1], [], []
    for c in (0, 1):
        own = min(1.0, pooled + size / (size + count[c]))  # few rows lean on the pooled one
        s = (1 - own) * cov[c] + own * common
        s = (1 - diagonal) * s + diagonal * np.diag(np.diag(s)) + 1e-4 * np.eye(size)
        low = np.linalg.cholesky(s)
        factor.append(np.linalg.inv(low))
        log_det.append(2 * np.log(np.diag(low)).sum())
    return QuadraticModel(None, mean, np.array(factor), np.array(log_det), float(np.log(whole[1] / whole[0])))


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and sums of outer products by class of rows (text, label)."""
    size = len(STATISTICS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, size, size))
        for batch in batches:
            for text, label in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.array([1.0, *statistics(text or b"")])
                sums[label] += np.outer(x, x)
        c, i, j = (a.ravel() for a in np.indices(sums.shape))
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (c, i, j, sums.ravel())], ["c", "i", "j", "v"])

    out = np.zeros((2, size, size))
    summed = rows.mapInArrow(run, "c long, i long, j long, v double").groupBy("c", "i", "j").agg(F.sum("v").alias("v"))
    for c, i, j, v in summed.collect():  # 2 x 15 x 15 numbers
        out[c, i, j] = v
    return out[:, 0, 0], out[:, 0, 1:], out[:, 1:, 1:]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text", max_train: int = MAX_TRAIN) -> QuadraticModel:
    """Learn from the labelled rows of ``docs``, ``max_train`` of them at most."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label).cast("long").alias("_label"))
    counts = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    take = class_shares(counts, max_train)
    few = [known.where(F.col("_label") == c).orderBy(F.xxhash64("_id"), "_id").limit(n) for c, n in take.items()]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).cast("string").alias("_text"))
    moments = _moments(rows.join(F.broadcast(few[0].unionByName(few[1])), "_id").select("_text", "_label"))
    return fit_model(*moments, weight=tuple(counts.get(c, 0) / max(1, n) for c, n in take.items()))


def score_quality(docs: DataFrame, model: QuadraticModel, text: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a column ``score_col``, 0 to 1: higher is likelier label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        rows = [statistics(t.encode("utf-8", "surrogatepass") if t else b"") for t in texts]
        return pd.Series(shared.value.score(np.array(rows).reshape(len(rows), len(STATISTICS))))

    return docs.withColumn(score_col, score.asNondeterministic()(F.col(text).cast("string")))  # else a filter on it runs it twice
