"""Vectorised word segmentation and 64-bit fingerprints over UTF-8 text.

Texts of an Arrow batch lie end to end in one byte buffer.  Words, rolling
sums and fingerprints are computed for the whole buffer with numpy, so no
Python statement runs per word.  A fingerprint is a polynomial over byte
values with an odd base modulo 2**64, then mixed with its length; equal words
always get equal fingerprints, and two different words collide with a
probability of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 4096)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(lower: bool, seed: int = 7) -> np.ndarray:
    """A random 64-bit value for each byte; A-Z share those of a-z if ``lower``."""
    table = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)
    if lower:
        table[65:91] = table[97:123]
    return table


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and the offsets of each; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` bytes together, one document at least."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def segment(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes) and document of each maximal run of ``inside`` bytes; runs end with their document."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    mask = inside[data]
    first = offs[:-1][offs[:-1] < offs[1:]]
    before = np.empty_like(mask)
    before[0], before[1:] = False, mask[:-1]
    before[first] = False
    after = np.empty_like(mask)
    after[-1], after[:-1] = False, mask[1:]
    after[first[1:] - 1] = False
    start = np.flatnonzero(mask & ~before)
    end = np.flatnonzero(mask & ~after) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def prefix_sums(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    return sums


def fingerprints(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One fingerprint for each byte range, from :func:`prefix_sums`."""
    _, down = powers(len(sums))
    h = (sums[end] - sums[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(words: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all runs of ``k`` words and their documents, in order.

    A document with words, but fewer than ``k``, gives one: its whole sequence.
    """
    step = np.uint64(0xA0761D6478BD642F)

    def run(at: np.ndarray, size: int) -> np.ndarray:
        acc = np.full(len(at), size, np.uint64)
        for j in range(size):
            acc = acc * step + words[at + j]
        return mix(acc)

    counts = np.bincount(doc, minlength=n_docs)
    begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
    at = np.flatnonzero(doc[k - 1 :] == doc[: len(doc) - k + 1]) if len(doc) >= k else np.zeros(0, np.int64)
    hashes, docs = [run(at, k)], [doc[at]]
    for size in range(1, k):
        short = np.flatnonzero(counts == size)
        if len(short):
            hashes.append(run(begin[short], size))
            docs.append(short)
    h, d = np.concatenate(hashes), np.concatenate(docs)
    if len(docs) > 1:
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
    return h, d


def bytes_column(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())
