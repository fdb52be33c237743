"""Token-id files: grammar-compressed shards with random access.

Documents are range-partitioned by id, so a shard holds a run of documents in
ascending order.  Re-Pair works shard by shard: adjacent id pairs that are
frequent in the shard are replaced by nonterminals, again and again, while a
pair occurs often enough.  A round counts all pairs at once and takes the most
frequent ones together; where two of them overlap, the left one is replaced.
Pairs never cross documents.

A shard's payload, little-endian: the magic ``RPG1``; uint32 counts of
documents, rules, symbols, and the first nonterminal; uint64 expanded length;
rules as uint32 pairs; uint32 expansion length of each rule; uint32 first
symbol of each document and one more; uint64 first id of each document and
one more; uint32 symbols.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm import blocks as B
from evidra.llm.bpe import encode_with_end
from evidra.llm.scratch import stored

MAGIC = b"RPG1"
BUCKET_BITS = 18
_HEAD = struct.Struct("<4sIIIIQ")


@dataclass(frozen=True)
class TokenFileParams:
    """``end_id`` follows each document; a pair is replaced while it occurs ``min_count`` times,
    at most ``per_round`` rules a round; ``shard_bytes`` of text make a shard."""

    tokenizer: str
    end_id: int = 2
    min_count: int = 8
    per_round: int = 8192
    shard_bytes: int = 1 << 20


def _buckets(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def _frequent(keys: np.ndarray, bucket: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Different keys that occur ``least`` times, and how often."""
    # Keys whose hash bucket is rarer than they must be need no exact count.
    ordered = np.sort(keys[(np.bincount(bucket, minlength=1 << BUCKET_BITS) >= least)[bucket]])
    cut = np.flatnonzero(np.concatenate((np.ones(min(len(ordered), 1), bool), ordered[1:] != ordered[:-1])))
    times = np.diff(np.append(cut, len(ordered)))
    often = times >= least
    return ordered[cut[often]], times[often]


def _occurrences(keys: np.ndarray, bucket: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``keys`` that hold one of ``pairs``, ascending, and the number of that pair."""
    of = _buckets(pairs)
    order = np.argsort(of, kind="stable")
    of, by = of[order], pairs[order]
    first = np.full(1 << BUCKET_BITS, len(pairs), np.int32)
    first[of[::-1]] = np.arange(len(pairs), dtype=np.int32)[::-1]
    by, of = np.append(by, np.iinfo(np.uint64).max), np.append(of, -1)
    at = first[bucket]
    same = by[at] == keys
    # A bucket's other pairs follow its first one.
    near = np.flatnonzero(~same & (at < len(pairs)))
    while len(near):
        at[near] += 1
        near = near[of[at[near]] == bucket[near]]
        equal = by[at[near]] == keys[near]
        same[near[equal]] = True
        near = near[~equal]
    hit = np.flatnonzero(same)
    return hit, order[at[hit]]


def compress(ids: np.ndarray, bounds: np.ndarray, p: TokenFileParams) -> bytes:
    """Payload of documents whose ids lie end to end.

    A replaced pair is gone from the sequence, and no other pair becomes more
    frequent unless it holds a new nonterminal.  So once a round has taken all
    frequent pairs, the next one looks only at the last round's nonterminals
    and their neighbours.
    """
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), bool)
    last[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = True
    first_rule = int(ids.max()) + 1 if len(ids) else 0
    rules: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    size_of = np.ones(first_rule, np.uint32)
    newest = 0  # pairs of older symbols are known to be rare
    while len(seq) > 1:
        fresh = seq >= newest
        spot = np.flatnonzero((fresh[:-1] | fresh[1:]) & ~last[:-1])
        keys = (seq[spot].astype(np.uint64) << np.uint64(32)) | seq[spot + 1]
        bucket = _buckets(keys)
        pairs, times = _frequent(keys, bucket, p.min_count)
        if not len(pairs):
            break
        newest = len(size_of)
        if len(pairs) > p.per_round:
            pairs, newest = pairs[np.sort(np.argsort(-times, kind="stable")[: p.per_round])], 0
        hit, at = _occurrences(keys, bucket, pairs)
        hit = spot[hit]
        # In a run of overlapping pairs every second one is replaced, from the left.
        index = np.arange(len(hit))
        begin = index.copy()
        begin[1:][hit[1:] == hit[:-1] + 1] = 0
        take = np.flatnonzero((index - np.maximum.accumulate(begin)) & 1 == 0)
        hit, at = hit[take], at[take]
        used = np.flatnonzero(np.bincount(at, minlength=len(pairs)))
        left, right = (pairs[used] >> np.uint64(32)).astype(np.uint32), (pairs[used] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        number = np.zeros(len(pairs), np.uint32)
        number[used] = len(size_of) + np.arange(len(used), dtype=np.uint32)
        rules.append(np.column_stack((left, right)))
        sizes.append(size_of[left] + size_of[right])
        size_of = np.concatenate((size_of, sizes[-1]))
        seq[hit] = number[at]
        last[hit] = last[hit + 1]
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        seq, last = seq[keep], last[keep]
    ends = np.flatnonzero(last) + 1
    doc_symbols = np.zeros(len(bounds), np.uint32)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    doc_symbols[full + 1] = ends
    doc_symbols = np.maximum.accumulate(doc_symbols)
    n_rules = sum(map(len, rules))
    parts = [
        _HEAD.pack(MAGIC, len(bounds) - 1, n_rules, len(seq), first_rule, len(ids)),
        *(r.astype("<u4").tobytes() for r in rules),
        *(s.astype("<u4").tobytes() for s in sizes),
        doc_symbols.astype("<u4").tobytes(),
        bounds.astype("<u8").tobytes(),
        seq.astype("<u4").tobytes(),
    ]
    return b"".join(parts)


class TokenShard:
    """A payload opened for reading."""

    def __init__(self, payload: bytes) -> None:
        magic, self.n_docs, n_rules, n_symbols, self.first_rule, self.n_ids = _HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(payload, kind, n, at)
            at += got.nbytes
            return got

        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.sizes = take("<u4", n_rules)
        self.doc_symbols = take("<u4", self.n_docs + 1).astype(np.int64)
        self.doc_ids = take("<u8", self.n_docs + 1).astype(np.int64)
        self.symbols = take("<u4", n_symbols)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids that a run of symbols stands for: each symbol's place follows from expansion lengths, level by level."""
        size_of = np.concatenate((np.ones(1, np.int64), self.sizes))

        def size(of: np.ndarray) -> np.ndarray:
            return size_of[np.maximum(of.astype(np.int64) - (self.first_rule - 1), 0)]

        ends = np.cumsum(size(symbols))
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        at = np.concatenate((np.zeros(1, np.int64), ends[:-1]))[: len(symbols)]
        while len(symbols):
            rule = symbols >= self.first_rule
            plain = ~rule
            out[at[plain]] = symbols[plain]
            pair, at = self.rules[symbols[rule] - self.first_rule], at[rule]
            symbols, at = pair.T.reshape(-1), np.concatenate((at, at + size(pair[:, 0])))
        return out

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[self.doc_symbols[k] : self.doc_symbols[k + 1]])

    def id_at(self, k: int, i: int) -> int:
        """Id number ``i`` of document ``k``, found through expansion lengths without expanding the rest."""
        own = self.symbols[self.doc_symbols[k] : self.doc_symbols[k + 1]].astype(np.int64)
        size = np.where(own >= self.first_rule, self.sizes[np.maximum(own - self.first_rule, 0)] if len(self.sizes) else 1, 1)
        ends = np.cumsum(size)
        at = int(np.searchsorted(ends, i, "right"))
        symbol, i = int(own[at]), i - int(ends[at] - size[at])
        while symbol >= self.first_rule:
            left, right = (int(x) for x in self.rules[symbol - self.first_rule])
            n = int(self.sizes[left - self.first_rule]) if left >= self.first_rule else 1
            symbol, i = (left, i) if i < n else (right, i - n)
        return symbol


_SHARDS = "part long, seq long, start long, n_ids long, doc_ids array<long>, payload binary"


def write_token_files(docs: DataFrame, params: TokenFileParams) -> DataFrame:
    """Writes the shards of ``docs(doc_id, text)`` and returns the written table.

    Documents go in ascending ``doc_id`` order, nulls first, equal ids by
    text.  A null text is an empty one: its end id alone.  Other columns are
    not read; an empty table gives no shards.  ``start`` counts the ids before
    the shard inside ``part``; parts ascend with the ids they hold.
    """
    p = params

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, start = TaskContext.get().partitionId(), 0, 0
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.binary()]
        for batch in batches:
            data, offs = B.utf8(batch.column(1))
            for i, j in B.slices(offs, 4 * p.shard_bytes):
                own = offs[i : j + 1] - offs[i]
                all_ids, cut = encode_with_end(p.tokenizer, data[offs[i] : offs[j]], own, p.end_id)
                for a, b in B.slices(own, p.shard_bytes):
                    ids, bounds = all_ids[cut[a] : cut[b]], cut[a : b + 1] - cut[a]
                    row = [[part], [seq], [start], [len(ids)], [batch.column(0).slice(i + a, b - a).to_pylist()], [compress(ids, bounds, p)]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], ["part", "seq", "start", "n_ids", "doc_ids", "payload"])
                    seq, start = seq + 1, start + len(ids)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The beginning of the text deals rows that share an id, or have none, to several ranges.
    rows = rows.repartitionByRange(n, "doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    return stored(rows.mapInArrow(run, _SHARDS), "tokens", compression="zstd")


def read_token_files(shards: DataFrame) -> DataFrame:
    """Every document of written shards: ``doc_id, start, n_tokens, ids`` (little-endian uint32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, start, doc_ids, payload = (batch.column(c)[k].as_py() for c in range(4))
                shard = TokenShard(payload)
                flat, cut = shard.expand(shard.symbols).astype("<u4").tobytes(), (4 * shard.doc_ids).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * shard.n_docs, pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(start + shard.doc_ids[:-1]), pa.array(np.diff(shard.doc_ids)), pa.array([flat[a:b] for a, b in zip(cut, cut[1:], strict=False)], pa.binary())],
                    ["part", "doc_id", "at", "n_tokens", "ids"],
                )

    # One row for each partition of the writer, so their number is bounded by the partition count.
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    before, base = 0, []
    for part, n in sorted((r.part, r.n) for r in totals):
        base.append((part, before))
        before += n
    bases = shards.sparkSession.createDataFrame(base, "part long, base long")
    rows = shards.select("part", "start", "doc_ids", "payload").mapInArrow(run, "part long, doc_id long, at long, n_tokens long, ids binary")
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")
