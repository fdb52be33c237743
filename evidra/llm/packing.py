"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class ``k`` holds pieces of at
most ``capacity // k`` ids, and each of its bins takes exactly ``k`` of them.
A document's remainder that fills its class's share up to ``slack`` stays
whole; otherwise the largest full share is cut off and the rest classed again.
Every worker fills bins from its own documents, with at most ``k - 1`` waiting
pieces a class, so workers need no exchange.  What waits at the end of a
worker's input is laid end to end into full sequences, and the last of them
into ones whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm import blocks as B
from evidra.llm.bpe import encode_with_end


@dataclass(frozen=True)
class PackParams:
    tokenizer: str
    end_id: int = 1
    capacity: int = 2048
    slack: float = 1 / 128


def cuts(n: int, capacity: int, slack: float) -> list[tuple[int, int]]:
    """Pieces of a document of ``n`` ids as ``(class, length)``, in order."""
    out = [(1, capacity)] * (n // capacity)
    n %= capacity
    while n:
        k = capacity // n
        share = capacity // k
        if share - n <= slack * share:
            out.append((k, n))
            break
        k = capacity // (n + 1) + 1
        share = capacity // k
        out.append((k, share))
        n -= share
    return out


_PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class _Packer:
    """Bins of one worker.  A piece is (doc_id, start, length, doc_tokens, ids)."""

    def __init__(self, p: PackParams, first: int) -> None:
        self.p, self.next = p, first
        self.waiting: dict[int, list[tuple]] = {}
        self.plans: dict[int, list[tuple[int, int]]] = {}
        self.out: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n = len(ids)
        full, rest = divmod(n, self.p.capacity)
        if rest not in self.plans:
            self.plans[rest] = cuts(rest, self.p.capacity, self.p.slack)
        start = 0
        for k, size in [(1, self.p.capacity)] * full + self.plans[rest]:
            bin_ = self.waiting.setdefault(k, [])
            bin_.append((doc_id, start, size, n, ids[start : start + size]))
            if len(bin_) == k:
                self._close(bin_)
                self.waiting[k] = []
            start += size

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, size, n, ids in pieces:
            self.out.append((doc_id, start, size, n, self.next, offset, ids.astype("<u4").tobytes()))
            offset += size
        self.next += 1

    def finish(self) -> None:
        """Lays the waiting pieces end to end, cutting them at the ends of sequences."""
        pieces = [x for k in sorted(self.waiting) for x in self.waiting[k]]
        left = sum(x[2] for x in pieces)
        room = self._room(left)
        held: list[tuple] = []
        for doc_id, start, size, n, ids in pieces:
            done = 0
            while done < size:
                take = min(size - done, room)
                held.append((doc_id, start + done, take, n, ids[done : done + take]))
                done, room, left = done + take, room - take, left - take
                if not room:
                    self._close(held)
                    held, room = [], self._room(left)
        self.waiting = {}

    def _room(self, left: int) -> int:
        return self.p.capacity if left >= self.p.capacity else 1 << (left.bit_length() - 1) if left else 0

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.out, strict=True)) or [[]] * 7
        self.out = []
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if x == "ids" else pa.int64()) for c, x in zip(cols, names, strict=True)], names)


def pack(docs: DataFrame, params: PackParams) -> DataFrame:
    """One row for each piece: its document, place in it, sequence and place there, and its ids.

    Every id of every document, the end id included, lies in exactly one
    piece.  A null text is an empty one, so its end id alone; a null
    ``doc_id`` is returned as null; repeated rows are packed once each; an
    empty table gives no pieces.  Other columns are not read.  Sequence
    numbers hold the worker's number in their high bits.
    """
    p = params

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = _Packer(p, TaskContext.get().partitionId() << 36)
        for batch in batches:
            data, offs = B.utf8(batch.column(1))
            doc_ids = batch.column(0).to_pylist()
            for i, j in B.slices(offs):
                ids, bounds = encode_with_end(p.tokenizer, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], p.end_id)
                for k in range(j - i):
                    packer.add(doc_ids[i + k], ids[bounds[k] : bounds[k + 1]])
                yield packer.batch()
        packer.finish()
        yield packer.batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _PIECES)
