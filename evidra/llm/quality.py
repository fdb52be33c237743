"""Document quality by regularised quadratic discriminant analysis.

Transformed statistics of the whole text are scored by the difference of two
Gaussian log densities.  Class covariances are shrunk to their pooled value,
then to its diagonal; their Cholesky factors are computed once and kept in the
model, so a batch of documents costs two triangular products.

Scale.  The fit needs counts, sums and cross products of each class, which add
up over partitions, so it reads every labelled row, without a sample, and the
driver gets one row of a few hundred numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm import blocks as B

FEATURES = ("word_length", "word_spread", "upper", "digits", "symbols", "stops", "pipes", "bangs", "distinct", "repeats", "top_word", "line_length", "non_ascii", "distinct_lines")
N = len(FEATURES)
#: Statistics of plain prose.  A text's own are mixed with them as if it had
#: ``PRIOR_WORDS`` more words of prose, so a few words decide little.
PROSE = np.array([1.83, 1.28, 0.13, 0.0, 0.0, 0.38, 0.0, 0.0, -0.25, 0.07, 0.23, 5.0, 0.1, 0.0])
PRIOR_WORDS = 15
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[44, 46, 58, 59, 63]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[33:48] = _SYMBOL[58:65] = _SYMBOL[91:97] = _SYMBOL[123:127] = True
_SYMBOL &= ~_STOP
_HIGH = np.zeros(256, bool)
_HIGH[128:] = True
_SPACED = np.ones(256, bool)
_SPACED[[32, 9, 10, 11, 12, 13]] = False
_LINE = np.ones(256, bool)
_LINE[10] = False


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Transformed statistics of each document, one row of ``FEATURES`` each; finite for every text."""
    n = len(offs) - 1
    values = B.byte_values(lower=True)
    sums = B.prefix_sums(data, values)
    size = np.maximum(np.diff(offs), 1)

    def share(table: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(table[data])))
        return np.diff(total[offs])

    start, end, doc = B.segment(data, offs, _SPACED)
    length = (end - start).astype(float)
    words = np.bincount(doc, minlength=n)
    some = np.maximum(words, 1)
    mean = np.bincount(doc, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(doc, length**2, n) / some - mean**2, 0))
    h = B.fingerprints(sums, start, end)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    distinct, top = _distinct(h, doc, n)
    ls, le, ldoc = B.segment(data, offs, _LINE)
    lines = np.bincount(ldoc, minlength=n)
    distinct_lines, _ = _distinct(B.fingerprints(sums, ls, le), ldoc, n)
    letters = np.maximum(share(_UPPER) + share(_LOWER), 1)

    def count(byte: int) -> np.ndarray:
        one = np.zeros(256, bool)
        one[byte] = True
        return share(one)

    cols = [
        np.log1p(mean),
        np.log1p(spread),
        np.sqrt(share(_UPPER) / letters),
        np.sqrt(share(_DIGIT) / size),
        np.sqrt(share(_SYMBOL) / some),
        np.sqrt(share(_STOP) / some),
        np.sqrt(count(124) / some),
        np.sqrt(count(33) / some),
        np.log(np.maximum(distinct, 1) / some),
        np.sqrt(np.bincount(doc, again, n) / some),
        np.sqrt(top / some),
        np.log1p(size / np.maximum(lines, 1)),
        np.sqrt(share(_HIGH) / size),
        np.log(np.maximum(distinct_lines, 1) / np.maximum(lines, 1)),
    ]
    own = (words / (words + PRIOR_WORDS))[:, None]
    return own * np.column_stack([c.astype(float) for c in cols]) + (1 - own) * PROSE


def _distinct(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of different fingerprints of each document, and the largest number of equal ones."""
    distinct, top = np.zeros(n), np.zeros(n)
    bounds = np.searchsorted(doc, np.arange(n + 1))
    for d in np.flatnonzero(np.diff(bounds)):
        own = np.sort(h[bounds[d] : bounds[d + 1]])
        cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
        distinct[d], top[d] = len(cut) - 1, np.diff(cut).max()
    return distinct, top


@dataclass(frozen=True)
class QdaParams:
    """``pooled``: weight of the pooled covariance in each class's; ``diagonal``: of the diagonal in that."""

    pooled: float = 0.2
    diagonal: float = 0.05
    ridge: float = 1e-3
    threshold: float = 0.3


@dataclass(frozen=True)
class Qda:
    """``factors``: inverse Cholesky factor of each class; ``offset``: its log density's constant with the prior."""

    shift: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    offset: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 from the difference of Mahalanobis log densities."""
        x = (x - self.shift) / self.scale
        d = [self.offset[k] - 0.5 * (((x - self.means[k]) @ self.factors[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(d[0] - d[1], -500, 500)))


def _moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros((2, 1 + N + N * N))
    for k in (0, 1):
        own = x[y == k]
        out[k] = np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).reshape(-1)))
    return out


def fit_moments(moments: np.ndarray, p: QdaParams) -> Qda:
    """A model from counts, sums and cross products of both classes; a class without rows takes the other's shape."""
    count = moments[:, 0]
    if not count.sum():
        return Qda(np.zeros(N), np.ones(N), np.zeros((2, N)), np.stack([np.eye(N)] * 2), np.zeros(2))
    total = moments.sum(axis=0)
    shift = total[1 : N + 1] / total[0]
    every = total[N + 1 :].reshape(N, N) / total[0] - np.outer(shift, shift)
    scale = np.sqrt(np.maximum(np.diag(every), 1e-9))
    means, covs = np.zeros((2, N)), np.zeros((2, N, N))
    for k in (0, 1):
        if count[k]:
            m = moments[k, 1 : N + 1] / count[k]
            covs[k] = (moments[k, N + 1 :].reshape(N, N) / count[k] - np.outer(m, m)) / np.outer(scale, scale)
            means[k] = (m - shift) / scale
    pooled = (covs * count[:, None, None]).sum(axis=0) / count.sum()
    factors, offset = np.zeros((2, N, N)), np.zeros(2)
    for k in (0, 1):
        weight = p.pooled if count[k] > N else 1.0
        cov = (1 - weight) * covs[k] + weight * pooled
        cov = (1 - p.diagonal) * cov + p.diagonal * np.diag(np.diag(cov)) + p.ridge * np.eye(N)
        lower = np.linalg.cholesky(cov)
        factors[k] = np.linalg.inv(lower)
        offset[k] = np.log((count[k] + 1) / (count.sum() + 2)) - np.log(np.diag(lower)).sum()
    return Qda(shift, scale, means, factors, offset)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``x, y``: statistics, as bytes, and quality of each labelled row, as :func:`fit_quality` reads them."""

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = B.utf8(batch.column(1))
            for i, j in B.slices(offs):
                x = statistics(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])

    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    # A shuffled join, however few the labels: after a broadcast one, statistics and sums would run in one task, in a Python worker each.
    return rows.mapInArrow(stats, "doc_id long, x binary").join(known.hint("merge"), "doc_id").select("x", "y")


def fit_quality(docs: DataFrame, labels: DataFrame, params: QdaParams = QdaParams()) -> Qda:
    """Fits on every row of ``labels(doc_id, quality)`` whose quality is 0 or 1 and whose document exists.

    Rows with nulls in either column are ignored; repeated label rows count
    once each; without any labelled row every score is one half.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + N + N * N))
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(0).to_pylist())).reshape(-1, N)
                total += _moments(x, batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total.reshape(-1)], names)

    names = [f"m{i}" for i in range(2 * (1 + N + N * N))]
    every = labelled(docs, labels).mapInArrow(sums, ", ".join(f"{c} double" for c in names)).agg(*[F.sum(c) for c in names]).first()
    total = np.array([x or 0.0 for x in every]).reshape(2, -1)
    return fit_moments(total, params)


def score_quality(docs: DataFrame, model: Qda) -> DataFrame:
    """``docs`` with a ``quality_score`` of 0 to 1 for each row; a column of that name, in any case, is replaced.

    Null and empty texts are scored by their statistics, which are those of no
    words.  Other columns pass through; an empty table gives an empty table.
    """
    rest = [c for c in docs.columns if c.lower() != "quality_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = B.utf8(batch.column(0))
            for i, j in B.slices(offs):
                score = model.scores(statistics(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))
                own = [batch.column(c).slice(i, j - i) for c in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(score)], [*rest, "quality_score"])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest] + ["quality_score double"])
    return docs.select(F.col("text").cast("string").alias("scored text"), *[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)
