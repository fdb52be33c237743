"""Benchmark decontamination over a distributed positional inverted index.

The index is document-partitioned: a shard holds the postings of one run of
documents, so building it and searching it need no shuffle and the work of a
search is spread like the documents.  A shard's row stores its sorted term
fingerprints, the start of each term's list, and the positions, ascending
inside each list.  Positions count words through the shard with a gap between
documents, so a phrase never crosses two of them.

A phrase is searched from its rarest term in the shard: that term's positions,
less its offset in the phrase, are the candidates, and the other terms' lists,
adjusted by their own offsets, are intersected with them in order of rarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm import blocks as B
from evidra.llm.scratch import stored

#: Bytes of a word: ASCII digits and letters, and every byte of a non-ASCII character.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = True
WORD[128:] = True

SHARD_BYTES = 2 << 20
GAP = 1 << 10
INDEX_SCHEMA = "row long, doc_ids binary, doc_starts binary, doc_words binary, terms binary, lists binary, positions binary"


@dataclass(frozen=True)
class PhraseParams:
    """``window``: words of a phrase.  ``slop``: extra words that a proximity match may hold.
    ``block``: phrases of one pass over the index; more items take more passes."""

    window: int = 10
    slop: int = 0
    block: int = 200_000


def _words(data: np.ndarray, offs: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, doc = B.segment(data, offs, WORD)
    return B.fingerprints(B.prefix_sums(data, values), start, end), doc


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES, gap: int = GAP) -> DataFrame:
    """Positional postings of every word of ``docs(doc_id, text)``, one row for each shard.

    Words are lower-cased A-Z.  Null and empty texts are documents without
    words.  A null ``doc_id`` keeps its place and is returned as null.  ``row``
    numbers the shard's first document; ``gap`` positions lie between two
    documents, more than a match may span.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        values, number = B.byte_values(lower=True), TaskContext.get().partitionId() << 36
        for batch in batches:
            data, offs = B.utf8(batch.column(1))
            ids = batch.column(0)
            for i, j in B.slices(offs, shard_bytes):
                h, doc = _words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], values)
                count = np.bincount(doc, minlength=j - i)
                begin = np.concatenate(([0], np.cumsum(count + gap)[:-1]))
                first = np.concatenate(([0], np.cumsum(count)[:-1]))
                pos = np.arange(len(h)) - first[doc] + begin[doc]
                order = np.argsort(h, kind="stable")
                sorted_ = h[order]
                new = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(h) else np.zeros(0, np.int64)
                part = ids.slice(i, j - i)
                known = part.is_valid().to_numpy(zero_copy_only=False)
                id_bytes = known.astype(np.uint8).tobytes() + part.fill_null(0).to_numpy().astype("<i8").tobytes()
                row = [id_bytes, begin.astype("<i8").tobytes(), count.astype("<i8").tobytes(), sorted_[new].tobytes(), new.astype("<i8").tobytes(), pos[order].astype("<u4").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in row)], ["row", "doc_ids", "doc_starts", "doc_words", "terms", "lists", "positions"])
                number += j - i

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, INDEX_SCHEMA)


class Shard:
    """One row of the index, opened for searching."""

    def __init__(self, row: list[bytes]) -> None:
        n = len(row[0]) // 9
        self.known = np.frombuffer(row[0][:n], np.uint8).astype(bool)
        self.doc_ids = np.frombuffer(row[0][n:], "<i8")
        self.doc_starts, self.doc_words = (np.frombuffer(x, "<i8") for x in row[1:3])
        self.terms, self.positions = np.frombuffer(row[3], np.uint64), np.frombuffer(row[5], "<u4").astype(np.int64)
        self.lists = np.append(np.frombuffer(row[4], "<i8"), len(self.positions))
        of = np.repeat(np.arange(len(self.terms)), np.diff(self.lists))
        self.keys = (of << 33) + self.positions

    def ranks(self, terms: np.ndarray) -> np.ndarray:
        """Place of each term in the shard's lexicon, or -1."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def holds(self, rank: np.ndarray, pos: np.ndarray) -> np.ndarray:
        key = (rank << 33) + pos
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (self.keys[at] == key) & (pos >= 0)

    def nearest(self, rank: np.ndarray, low: np.ndarray) -> np.ndarray:
        """First position of a term at or after ``low``; a huge number where there is none."""
        at = np.searchsorted(self.keys, (rank << 33) + np.maximum(low, 0))
        ok = at < self.lists[rank + 1]
        return np.where(ok, self.positions[np.minimum(at, len(self.positions) - 1)], 1 << 40)

    def phrases(self, terms: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrase number and start position of every exact occurrence."""
        rank, live, step, phrase, start = self._candidates(terms, size)
        for k in range(1, terms.shape[1]):
            off = step[phrase, k]
            r = rank[live[phrase], off]
            used = k < size[live[phrase]]
            keep = ~used
            keep[used] = self.holds(r[used], start[used] + off[used])
            phrase, start = phrase[keep], start[keep]
        return live[phrase], start

    def proximities(self, terms: np.ndarray, size: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrase number, first and last position of ordered matches with at most ``slop`` extra words.

        Each position of the first term gives its shortest ordered match.
        """
        rank = self.ranks(terms)
        live = np.flatnonzero((rank >= 0).sum(axis=1, where=np.arange(terms.shape[1]) < size[:, None]) == size)
        if not len(live):
            none = np.zeros(0, np.int64)
            return none, none, none
        lo, hi = self.lists[rank[live, 0]], self.lists[rank[live, 0] + 1]
        phrase = np.repeat(np.arange(len(live)), hi - lo)
        at = np.arange(len(phrase)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        first = self.positions[at]
        last = first.copy()
        for k in range(1, terms.shape[1]):
            used = k < size[live[phrase]]
            last[used] = self.nearest(rank[live[phrase[used]], k], last[used] + 1)
            keep = last - first < size[live[phrase]] + slop
            phrase, first, last = phrase[keep], first[keep], last[keep]
        return live[phrase], first, last

    def _candidates(self, terms: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        width = np.arange(terms.shape[1])
        rank = self.ranks(terms)
        live = np.flatnonzero((rank >= 0).sum(axis=1, where=width < size[:, None]) == size)
        df = np.where(width < size[live][:, None], np.diff(self.lists)[np.maximum(rank[live], 0)] if len(self.terms) else 0, 1 << 60)
        step = np.argsort(df, axis=1, kind="stable")
        rarest = rank[live, step[:, 0]] if len(live) else np.zeros(0, np.int64)
        lo, hi = self.lists[rarest], self.lists[rarest + 1] if len(live) else rarest
        phrase = np.repeat(np.arange(len(live)), hi - lo)
        at = np.arange(len(phrase)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        return rank, live, step, phrase, self.positions[at] - step[phrase, 0]


def phrase_table(texts: list[str | None], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term fingerprints, lengths and text number of the windows of all texts, each different window of a text once."""
    data, offs = B.utf8(pa.array(texts, pa.string()))
    h, doc = _words(data, offs, B.byte_values(lower=True))
    count = np.bincount(doc, minlength=len(texts))
    begin = np.concatenate(([0], np.cumsum(count)[:-1])).astype(np.int64)
    n = np.where(count == 0, 0, np.maximum(count - window + 1, 1))
    text = np.repeat(np.arange(len(texts)), n)
    start = begin[text] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    size = np.minimum(count[text], window)
    at = start[:, None] + np.arange(window)[None, :]
    terms = np.where(np.arange(window) < size[:, None], h[np.minimum(at, max(len(h) - 1, 0))] if len(h) else 0, 0).astype(np.uint64)
    if not len(terms):
        return terms.reshape(0, window), size, text
    rows = np.column_stack([text.astype(np.uint64), terms])
    _, once = np.unique(rows, axis=0, return_index=True)
    return terms[once], size[once], text[once]


def _items(benchmark: DataFrame, block: int, window: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of at most about ``block`` windows; one block is on the driver at a time."""
    held: list[tuple[str, str]] = []
    size = 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("i is not null and t is not null")
    for row in rows.toLocalIterator():
        held.append((row.i, row.t))
        size += row.t.count(" ") + 1
        if size >= block:
            yield held
            held, size = [], 0
    if held:
        yield held


def search(index: DataFrame, items: list[tuple[str, str]], p: PhraseParams) -> DataFrame:
    """Per document of the index: ``row, doc_id, n_words, hits, items``.

    ``hits`` holds the word ranges, first and last position interleaved, of
    all matches; ``items`` the ids of the matched items.
    """
    names = [i for i, _ in items]
    terms, size, of = phrase_table([t for _, t in items], p.window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard = Shard([batch.column(c)[k].as_py() for c in range(1, 7)])
                n = len(shard.doc_ids)
                if p.slop:
                    phrase, lo, hi = shard.proximities(terms, size, p.slop)
                    hi = hi + 1
                else:
                    phrase, lo = shard.phrases(terms, size)
                    hi = lo + size[phrase]
                doc = np.searchsorted(shard.doc_starts, lo, "right") - 1
                order = np.lexsort((hi, lo, doc))
                phrase, lo, hi, doc = phrase[order], lo[order], hi[order], doc[order]
                cut = np.searchsorted(doc, np.arange(n + 1))
                hits, found = [[] for _ in range(n)], [[] for _ in range(n)]
                for d in np.unique(doc):
                    a, b = cut[d], cut[d + 1]
                    hits[d] = _merged(lo[a:b] - shard.doc_starts[d], hi[a:b] - shard.doc_starts[d])
                    found[d] = sorted({names[x] for x in of[phrase[a:b]]})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(batch.column(0)[k].as_py() + np.arange(n)), pa.array(shard.doc_ids, mask=~shard.known), pa.array(shard.doc_words), pa.array(hits, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))],
                    ["row", "doc_id", "n_words", "hits", "items"],
                )

    return index.mapInArrow(run, "row long, doc_id long, n_words long, hits array<long>, items array<string>")


def _merged(lo: np.ndarray, hi: np.ndarray) -> list[int]:
    """Ranges sorted by start, joined where they overlap or touch, ends interleaved."""
    top = np.maximum.accumulate(hi)
    new = np.concatenate(([True], lo[1:] > top[:-1]))
    ends = top[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(lo) - 1]))]
    return np.column_stack((lo[new], ends)).reshape(-1).tolist()


def contamination(docs: DataFrame, benchmark: DataFrame, params: PhraseParams = PhraseParams()) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items, contaminated``.

    A word is hit if it lies inside an occurrence of a window of
    ``params.window`` consecutive words of an item; an item of fewer words is
    one window.  ``items`` are the ids of such items as sorted strings.  Null
    and empty texts have no words; items with a null id or text are ignored;
    repeated rows are reported once each; an empty benchmark hits nothing; an
    empty table gives an empty table.  Other columns are not read.
    """
    index = stored(build_index(docs, gap=max(GAP, params.window + params.slop + 1)), "index", compression="zstd")
    blocks = _items(benchmark, params.block, params.window)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return _summary(search(index, first, params), merge=False)
    # Each pass is written before the next block comes to the driver; only documents that it hits are.
    passes = None
    for items in chain((first, second), blocks):
        hit = stored(search(index, items, params).where(F.size("items") > 0).select("row", "hits", "items"), "hits")
        passes = hit if passes is None else passes.unionByName(hit)
    merged = passes.groupBy("row").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    every = search(index, [], params).select("row", "doc_id", "n_words").join(merged, "row", "left")
    none = F.array()
    return _summary(every.withColumns({"hits": F.coalesce("hits", none.cast("array<long>")), "items": F.coalesce("items", none.cast("array<string>"))}), merge=True)


def _summary(found: DataFrame, merge: bool) -> DataFrame:
    if merge:
        covered = F.expr("size(array_distinct(flatten(transform(filter(sequence(0, size(hits) - 1), i -> size(hits) > 0 and i % 2 = 0), i -> sequence(hits[i], hits[i + 1] - 1)))))")
    else:
        covered = F.expr("aggregate(hits, named_struct('s', 0L, 'sign', -1L), (a, x) -> named_struct('s', a.s + a.sign * x, 'sign', -a.sign), a -> a.s)")
    hit = F.when(F.size("hits") > 0, covered).otherwise(0).cast("long")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items").withColumn("contaminated", F.col("n_hit") > 0)
