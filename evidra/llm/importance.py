"""Target-distribution importance resampling over hashed n-grams.

Words are runs of digits, letters a-z (A-Z are lowered) and all characters
past ASCII.  A document's features are its runs of 1 to ``order`` words, joined
by one space, repeats counted; a feature's bucket is the CRC-32 of its UTF-8
bytes modulo ``buckets``.  No feature's string is ever made: each different
word's CRC is computed once a block, and the CRC of a longer run follows from
``crc(a + b) = shift(crc(a), len(b)) ^ crc(b)``, where a shift by n bytes is a
32 x 32 matrix over GF(2), here as four tables of 256 values.

Counts of ``buckets`` numbers a task are summed over all rows of both tables.
A document's weight is the floored mean of its features' gains; weight plus
Gumbel noise, a function of ``doc_id`` alone, is its score, and the highest
scores are drawn, which is sampling without replacement in proportion to
exp(weight / 1000).  Ranks come from a histogram of the whole-numbered scores
and windows of one score each, never from one sorted task.

A null text has no words; a document without features has weight 0.  Rows
that share a ``doc_id`` share their noise, and a null id's noise is that of an
empty one; ties go to the smaller ``doc_id``, null last, and equal rows in any
order.  A text may have any length.  Columns named like a result's are replaced.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidra.llm import blocks as B
from evidra.llm.scratch import stored

POLYNOMIAL = 0xEDB88320
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = B.byte_values(lower=True)


@dataclass(frozen=True)
class ImportanceParams:
    order: int = 2
    buckets: int = 10_000
    #: Documents of fewer words are never drawn.
    min_words: int = 20
    percent: int = 25
    seed: int = 7


def _times(matrix: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """A GF(2) matrix times each of some vectors; a matrix is the images of the 32 single bits."""
    bits = (columns[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
    return np.bitwise_xor.reduce(np.where(bits == 1, matrix[None, :], np.uint32(0)), axis=1)


@lru_cache(maxsize=64)
def _power(k: int) -> np.ndarray:
    """The matrix that shifts a CRC by 2**k zero bytes."""
    if k:
        half = _power(k - 1)
        return _times(half, half)
    one = np.array([POLYNOMIAL, *(1 << i for i in range(31))], np.uint32)  # one zero bit
    for _ in range(3):
        one = _times(one, one)
    return one


@lru_cache(maxsize=4096)
def shift_tables(n: int) -> np.ndarray:
    """Images of the four bytes of a CRC under a shift by ``n`` bytes: ``[4, 256]``."""
    matrix = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for k in range(n.bit_length()):
        if n >> k & 1:
            matrix = _times(_power(k), matrix)
    bytes_ = np.arange(256, dtype=np.uint32)
    return np.stack([_times(matrix, bytes_ << np.uint32(8 * j)) for j in range(4)])


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each CRC as if ``length`` zero bytes followed, before that part's own CRC is added."""
    sizes, which = np.unique(length, return_inverse=True)
    tables = np.stack([shift_tables(int(n)) for n in sizes]) if len(sizes) else np.zeros((0, 4, 256), np.uint32)
    out = np.zeros(len(crc), np.uint32)
    for j in range(4):
        out ^= tables[which, j, (crc >> np.uint32(8 * j)) & np.uint32(255)]
    return out


def word_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each lowered word, computed once for each different one."""
    prints = B.fingerprints(B.prefix_sums(data, _VALUES), start, end)
    _, first, which = np.unique(prints, return_index=True, return_inverse=True)
    raw = memoryview(_LOWER[data]).cast("B")
    crcs = [zlib.crc32(raw[a:b]) for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
    return np.array(crcs, np.uint32)[which]


def feature_crcs(data: np.ndarray, offs: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of run: the CRC of each feature, and its document."""
    start, end, doc = B.segment(data, offs, _INSIDE)
    if not len(start):
        return
    word = word_crcs(data, start, end)
    size = end - start
    spaced = shifted(np.full(len(size), zlib.crc32(b" "), np.uint32), size) ^ word
    run, at = word, np.arange(len(word))
    yield run, doc
    for k in range(1, order):
        keep = at + k < len(doc)
        run, at = run[keep], at[keep]
        keep = doc[at] == doc[at + k]
        run, at = run[keep], at[keep]
        run = shifted(run, size[at + k] + 1) ^ spaced[at + k]
        yield run, doc[at]


def _counts(docs: DataFrame, p: ImportanceParams, text: str) -> np.ndarray:
    """How often each bucket comes up in all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p.buckets, np.int64)
        for batch in batches:
            data, offs = B.utf8(batch.column(0))
            for i, j in B.slices(offs):
                for crc, _ in feature_crcs(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], p.order):
                    total += np.bincount(crc % np.uint32(p.buckets), minlength=p.buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["bucket", "n"])

    summed = docs.select(F.col(text).cast("string")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(p.buckets, np.int64)
    for bucket, n in summed.collect():  # at most ``buckets`` rows
        out[bucket] = n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousand times the log ratio of smoothed target and source shares, floored."""
    m = len(source)
    s_all, t_all = float(source.sum()) + m, float(target.sum()) + m
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gains: np.ndarray, params: ImportanceParams, text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of each row."""
    p = params

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = B.utf8(batch.column(1))
            n = len(offs) - 1
            words, features, total = (np.zeros(n, np.int64) for _ in range(3))
            for i, j in B.slices(offs):
                for k, (crc, doc) in enumerate(feature_crcs(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], p.order)):
                    sums = np.concatenate(([0], np.cumsum(gains[crc % np.uint32(p.buckets)])))
                    bounds = np.searchsorted(doc, np.arange(j - i + 1))
                    total[i:j] += np.diff(sums[bounds])
                    features[i:j] += np.diff(bounds)
                    if not k:
                        words[i:j] = np.diff(bounds)
            mean = total // np.maximum(features, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(features), pa.array(mean)], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", F.col(text).cast("string")).mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, params: ImportanceParams | None = None, text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of each row of ``docs``; ``rank`` is null where it isn't drawn."""
    p = params or ImportanceParams()
    gains = bucket_gains(_counts(docs, p, text), _counts(target, p, text))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{p.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = stored(weights(docs, gains, p, text).withColumn("score", F.col("weight") + noise), "importance")
    may = F.col("n_words") >= p.min_words
    # Scores are whole numbers of a narrow range: some ten thousand rows, whatever the input.
    histogram = sorted(scored.where(may).groupBy("score").count().collect(), reverse=True)
    n = sum(c for _, c in histogram) * p.percent // 100
    above, first = 0, []
    for score, count in histogram:
        if above >= n:
            break
        first.append((score, above))
        above += count
    spark = docs.sparkSession
    places = spark.createDataFrame(first, "score long, above long")
    row = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    place = F.col("above") + row
    drawn = scored.where(may).join(F.broadcast(places), "score").withColumn("rank", F.when(place <= n, place)).select(*scored.columns, "rank")
    least = first[-1][0] if first else None
    rest = ~may if least is None else ~may | (F.col("score") < least)
    return drawn.unionByName(scored.where(rest if first else F.lit(True)).withColumn("rank", F.lit(None).cast("long")))
