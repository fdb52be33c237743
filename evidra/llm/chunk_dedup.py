"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text; a byte whose hash has zeros in the
masked bits ends a chunk, unless another such byte lies less than ``least``
before it.  Both rules look at nearby bytes only, so boundaries inside a
passage are the same wherever it stands, and an insertion moves no boundary
beyond its neighbourhood.  Chunks of whole documents are counted by digest;
neighbouring chunks of a document that stand at another place too join to a
passage, and passages of enough words are repeats.  The first place of each
repeated chunk, by document and position, is kept; a passage whose chunks have
their first places in different documents is reported in parts.

Scale.  The count of digests aggregates before its shuffle.  Chunk rows meet
only the digests that repeat, in a join whose hot keys Spark can split, and a
document's repeated chunks are gathered by document, never by digest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidra.llm import blocks as B
from evidra.llm.scratch import stored

WINDOW = 16
#: Bytes before the size limit in which an overlong chunk is cut.
WINDOW_LONG = 64


@dataclass(frozen=True)
class ChunkParams:
    """``mask_bits`` and ``least``: a chunk has ``least + 2**mask_bits`` bytes on average; ``most`` at most.

    A passage loses about 70 bytes at its ends, where chunks reach beyond it,
    so ``min_words`` of 20 finds passages of more than 50 words.  One that
    only its own document repeats needs ``inside_words``.
    """

    mask_bits: int = 4
    least: int = 16
    most: int = 256
    min_words: int = 20
    inside_words: int = 50
    seed: int = 23


def gear(data: np.ndarray, seed: int) -> np.ndarray:
    """Rolling hash over the last ``WINDOW`` bytes at every byte."""
    h = np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)[data]
    span = 1
    while span < WINDOW:
        h[span:] = h[span:] + (h[:-span] << np.uint32(span))
        span *= 2
    return h


def boundaries(data: np.ndarray, offs: np.ndarray, p: ChunkParams) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each chunk; chunks tile every document that isn't empty."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none
    h = gear(data, p.seed)
    # The highest of these bits has seen every byte of the window.
    low = np.uint32(WINDOW - p.mask_bits)
    raw = np.flatnonzero(((h >> low) & np.uint32((1 << p.mask_bits) - 1)) == 0) + 1
    doc = np.searchsorted(offs, raw - 1, "right") - 1
    inside = raw - offs[doc]
    ok = (inside >= WINDOW) & (raw < offs[doc + 1])
    raw, doc = raw[ok], doc[ok]
    far = np.concatenate(([True], (np.diff(raw) >= p.least) | (np.diff(doc) > 0)))[: len(raw)]
    cuts = np.union1d(raw[far], offs)
    more: list[int] = []
    for k in np.flatnonzero(np.diff(cuts) > p.most).tolist():
        at, end = int(cuts[k]), int(cuts[k + 1])
        while end - at > p.most:
            # The least hash near the limit is at the same place of a text that repeats itself, whatever stands before.
            look = at + p.most - WINDOW_LONG
            at = look + int(h[look : at + p.most].argmin()) + 1
            more.append(at)
    cuts = np.union1d(cuts, np.array(more, np.int64)) if more else cuts
    return cuts[:-1], cuts[1:]


_CHUNKS = "doc_id long, row long, n int, digest long, start int, end int, words int"


def chunk_rows(docs: DataFrame, p: ChunkParams) -> DataFrame:
    """One row for each chunk: its document, number, digest, and place in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = B.byte_values(lower=False, seed=p.seed)
        space = np.zeros(256, bool)
        space[[32, 9, 10, 11, 12, 13]] = True
        for batch in batches:
            data, offs = B.utf8(batch.column(2))
            ids, rows = batch.column(0), batch.column(1)
            for i, j in B.slices(offs):
                own, bounds = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                start, end = boundaries(own, bounds, p)
                doc = np.searchsorted(bounds, start, "right") - 1
                digest = B.fingerprints(B.prefix_sums(own, values), start, end).view(np.int64)
                points = np.concatenate(([0], np.cumsum((own & 0xC0) != 0x80)))
                begins = ~space[own]
                begins[1:] &= space[own[:-1]]
                heads = bounds[:-1][bounds[:-1] < bounds[1:]]
                begins[heads] = ~space[own[heads]]
                words = np.concatenate(([0], np.cumsum(begins)))
                at = pa.array(doc + i)
                number = np.arange(len(doc)) - np.searchsorted(doc, doc)
                base = points[bounds[doc]]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(at),
                        rows.take(at),
                        pa.array(number.astype(np.int32)),
                        pa.array(digest),
                        pa.array((points[start] - base).astype(np.int32)),
                        pa.array((points[end] - base).astype(np.int32)),
                        pa.array((words[end] - words[start]).astype(np.int32)),
                    ],
                    ["doc_id", "row", "n", "digest", "start", "end", "words"],
                )

    return docs.select("doc_id", "row", "text").mapInArrow(run, _CHUNKS)


def repeated_passages(docs: DataFrame, params: ChunkParams = ChunkParams()) -> DataFrame:
    """Repeats of ``docs(doc_id, text)``: ``doc_id, start, end, n_words, kept, first_doc_id``.

    A run of neighbouring repeated chunks has ``n_words`` words.  It counts if
    ``params.min_words`` of them are in chunks that other documents hold too,
    or if it has ``params.inside_words`` in all; it gives a row for each part
    of it along which ``kept`` and ``first_doc_id`` stay the same.  A chunk is
    repeated if it stands at two places, of two documents or of one.  Offsets are code points, end exclusive.  ``first_doc_id`` is the
    smallest id of a document that holds the part's chunks; ``kept`` tells
    that the part stands in its first place, and a deduplicated text leaves
    out the other parts, so no chunk loses its first place.  Rows without
    ``doc_id`` and null and empty texts have no repeats; rows that share a
    ``doc_id`` are one document, and equal ones among them are one row; an
    empty table gives none.  Other columns are not read.
    """
    p = params
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    rows = rows.withColumn("row", F.xxhash64("text"))
    chunks = stored(chunk_rows(rows, p), "chunks", compression="zstd")
    # Numbers only, so the aggregate is by hash; a chunk stands at two places of a document if their hashes differ.
    place = F.xxhash64("row", "n")
    seen = chunks.groupBy("digest").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("high"), F.min(place).alias("a"), F.max(place).alias("b"))
    seen = seen.where("first_doc_id < high or a < b").select("digest", "first_doc_id", (F.col("first_doc_id") < F.col("high")).alias("across"))
    hit = chunks.join(seen, "digest").select("doc_id", "row", "n", "digest", "start", "end", "words", "first_doc_id", "across")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hit = hit.repartition(n, "doc_id").dropDuplicates(["doc_id", "row", "n"])
    # A run is a maximal sequence of neighbouring numbers, so number less rank is the same along it.
    text = Window.partitionBy("doc_id", "row").orderBy("n")
    runs = hit.withColumn("run", F.col("n") - F.row_number().over(text))
    first = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy("row", "n")) == 1
    runs = runs.withColumn("first", (F.col("doc_id") == F.col("first_doc_id")) & first)
    along = Window.partitionBy("doc_id", "row", "run")
    part = F.struct("first", "first_doc_id")
    shared = F.sum(F.when(F.col("across"), F.col("words")).otherwise(0)).over(along)
    runs = runs.withColumns({"n_words": F.sum("words").over(along), "shared": shared, "new": (part != F.lag(part).over(along.orderBy("n"))).cast("int")})
    runs = runs.where((F.col("shared") >= p.min_words) | (F.col("n_words") >= p.inside_words))
    runs = runs.withColumn("part", F.sum(F.coalesce("new", F.lit(0))).over(along.orderBy("n")))
    out = runs.groupBy("doc_id", "row", "run", "part").agg(F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"), F.max("n_words").alias("n_words"), F.bool_and("first").alias("kept"), F.min("first_doc_id").alias("first_doc_id"))
    return out.select("doc_id", "start", "end", "n_words", "kept", "first_doc_id")
