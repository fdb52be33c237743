"""Byte-pair token ids of whole texts, by the tokenizers library behind a cache.

Texts are cut where the vocabulary's splitting pattern always cuts: in front
of a space between two characters that aren't white space, between a letter
and a mark, and around a single newline in front of a letter.  Each different
unit is encoded once by the library and kept in a bounded cache of the worker.
Units of at most 16 bytes are found there by their bytes, many at a time, in
a hash table of numpy arrays; a Python string is made only for longer ones.
Many new units of letters, each one word of the pattern, are encoded by one
call of the library's model.

A text that holds the literal of an added token, and every text where the
tokenizer isn't a byte-level chain without a normalizer, goes to the library
as a whole, so ids are always those of ``encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa

from evidra.llm import blocks as B

MAX_UNITS = 450_000
#: Bytes of a unit that the hash table compares: its first eight and its last eight.
SHORT = 16
#: Units of one text that is given to the library's model.
GROUP = 64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_PLAIN = ~_SPACE
_PLAIN[128:] = False
#: First bytes of characters that aren't white space; those that begin some white space are left out.
_FIRST = ~_SPACE
_FIRST[[0xC2, 0xE1, 0xE2, 0xE3]] = False
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = True
#: ASCII marks but the apostrophe, which can begin a contraction.
_MARK = np.zeros(256, bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_MARK[39] = False
#: Bytes at which, or behind which, a unit can begin.
_CUT = _MARK.copy()
_CUT[[10, 32]] = True
#: Keeps the first 0 to 8 bytes of a little-endian word.
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def unit_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte offsets at which units begin."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    begins = offs[:-1][offs[:-1] < offs[1:]]
    at = np.flatnonzero(_CUT[data])
    own = data[at]
    # At a text's first or last byte the neighbour is another text's; a space stands for it.
    edge = np.zeros(n + 1, bool)
    edge[begins], edge[n] = True, True
    before = np.where(edge[at], 32, data[at - 1])
    after = np.where(edge[at + 1], 32, data[np.minimum(at + 1, n - 1)])
    high = before >= 128
    two, three = data[at - 2], data[at - 3]
    solid = _PLAIN[before] | (high & (two != 0xC2) & ((three < 0xE1) | (three > 0xE3)))
    letter = _ALPHA[before] | (high & (two == 0xC3) & (before != 0x97) & (before != 0xB7))
    line = (own == 10) & solid & _ALPHA[after]
    start = np.zeros(n, bool)
    start[at[((own == 32) & solid & _FIRST[after]) | (_MARK[own] & letter) | line]] = True
    start[at[line] + 1] = True
    start[begins] = True
    return np.flatnonzero(start)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each offset on as a little-endian number, with zeros behind the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded.data, 0, (1,))


def _byte_characters() -> str:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return "".join(chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256))


def _gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Elements of ranges end to end, and the bounds of each."""
    total = np.concatenate(([0], np.cumsum(size)))
    at = np.repeat((start - total[:-1]).astype(np.int32), size)
    at += np.arange(total[-1], dtype=np.int32)
    return data[at], total


class UnitTable:
    """Numbers of short units, found by their bytes: open addressing, at most half full."""

    def __init__(self, bits: int = 12) -> None:
        self.bits, self.n = bits, 0
        self.number = np.full(1 << bits, -1, np.int32)
        self.head, self.tail = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.size = np.zeros(1 << bits, np.uint8)

    def _place(self, head: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
        h = B.mix(head * np.uint64(0x9E3779B97F4A7C15) + tail * np.uint64(0xC2B2AE3D27D4EB4F) + size.astype(np.uint64))
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, head: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each unit, or -1."""
        place = self._place(head, tail, size)
        found = self.number[place]
        off = np.flatnonzero((found >= 0) & ~((self.head[place] == head) & (self.tail[place] == tail) & (self.size[place] == size)))
        while len(off):
            place[off] = (place[off] + 1) & ((1 << self.bits) - 1)
            p = place[off]
            found[off] = self.number[p]
            off = off[(found[off] >= 0) & ~((self.head[p] == head[off]) & (self.tail[p] == tail[off]) & (self.size[p] == size[off]))]
        return found

    def add(self, head: np.ndarray, tail: np.ndarray, size: np.ndarray, number: np.ndarray) -> None:
        """Enters units that are different from each other and not there yet."""
        if 2 * (self.n + len(head)) > len(self.number):
            old = np.flatnonzero(self.number >= 0)
            rows = [x[old] for x in (self.head, self.tail, self.size, self.number)]
            self.__init__((2 * (len(old) + len(head))).bit_length())
            self.add(*rows)
        self.n += len(head)
        place, left = self._place(head, tail, size), np.arange(len(head))
        while len(left):
            p = place[left]
            _, first = np.unique(p, return_index=True)
            first = first[self.number[p[first]] < 0]
            own, at = left[first], p[first]
            self.number[at], self.head[at], self.tail[at], self.size[at] = number[own], head[own], tail[own], size[own]
            left = np.delete(left, first)
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        # Cutting holds for the byte-level chain without a normalizer; a test compares it with the library.
        kind = json.loads(self.tokenizer.to_str())
        pre = kind.get("pre_tokenizer") or {}
        self.direct = kind.get("normalizer") is None and kind.get("truncation") is None and kind.get("padding") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.literals = [t["content"].encode() for t in kind.get("added_tokens") or []]
        self.characters = _byte_characters()
        # The same model, shared, without the pattern, for words whose bytes are already the vocabulary's characters.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = CharDelimiterSplit("\n")
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.clear()

    def clear(self) -> None:
        self.table, self.long = UnitTable(), {}
        self.n, self.used = 0, 0
        self.starts, self.ids = np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        self.hits = np.zeros(1024, np.int32)

    def _shrink(self) -> None:
        """Keeps the units that came up in more than one block, half of the bound at most."""
        keep = np.flatnonzero(self.hits[: self.n] > 1)[-MAX_UNITS // 2 :]
        ids, bounds = _gathered(self.ids, self.starts[keep], np.diff(self.starts[: self.n + 1])[keep])
        new = np.full(self.n, -1, np.int32)
        new[keep] = np.arange(len(keep))
        table, long = self.table, self.long
        at = np.flatnonzero(table.number >= 0)
        at = at[new[table.number[at]] >= 0]
        self.clear()
        self._add(ids, np.diff(bounds))
        self.table.add(table.head[at], table.tail[at], table.size[at], new[table.number[at]])
        self.long = {u: int(new[k]) for u, k in long.items() if new[k] >= 0}

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of new units with these ids."""
        number = np.arange(self.n, self.n + len(sizes))
        while self.n + len(sizes) + 1 > len(self.starts):
            self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
            self.hits = np.concatenate((self.hits, np.zeros_like(self.hits)))
        self.starts[self.n + 1 : self.n + len(sizes) + 1] = self.used + np.cumsum(sizes)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.n, self.used = self.n + len(sizes), self.used + len(ids)
        return number

    def _by_library(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts end to end, and the number of each one's."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _new(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Encodes units that the cache lacks and returns their numbers."""
        number = np.empty(len(start), np.int64)
        flat, bounds = _gathered(data, start, size)
        # Letters of ASCII and from U+00C0 to U+024F, but the two signs among these.
        last = np.concatenate((np.zeros(1, np.uint8), flat[:-1]))
        lead = (flat >= 0xC3) & (flat <= 0xC9)
        follow = (flat >= 0x80) & (flat < 0xC0) & (last >= 0xC3) & (last <= 0xC9) & ~((last == 0xC3) & ((flat == 0x97) | (flat == 0xB7))) & ~((last == 0xC9) & (flat > 0x8F))
        good = _ALPHA[flat] | lead | follow
        good[bounds[:-1]] |= (flat[bounds[:-1]] == 32) & (size > 1)
        bad = np.concatenate(([0], np.cumsum(~good)))
        word = bad[bounds[1:]] == bad[bounds[:-1]]
        plain, rest = np.flatnonzero(word), np.flatnonzero(~word)
        if len(plain):
            ids, sizes = self._plain(data, start[plain], size[plain])
            if sizes is None:
                rest = np.arange(len(start))
            else:
                number[plain] = self._add(ids, sizes)
        if len(rest):
            raw = flat.tobytes()
            ids, sizes = self._by_library([raw[a:b].decode() for a, b in zip(bounds[rest].tolist(), bounds[rest + 1].tolist(), strict=True)])
            number[rest] = self._add(ids, sizes)
        return number

    def _plain(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Ids of words end to end and their numbers, by the model; no numbers if it loses bytes."""
        lines = np.full(int((size + 1).sum()), 10, np.uint8)
        flat, _ = _gathered(data, start, size)
        ends = np.cumsum(size + 1)
        letters = np.ones(len(lines), bool)
        letters[ends - 1] = False
        lines[letters] = flat
        table = list(self.characters)
        table[10] = "\n"
        text = lines.tobytes().decode("latin-1").translate("".join(table))
        cuts = [0, *ends[GROUP - 1 : -1 : GROUP].tolist(), len(text)]
        found = [e.ids for e in self.plain.encode_batch_fast([text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(found), np.uint32)
        done = np.concatenate(([0], np.cumsum(self.bytes_of[ids])))
        at = np.searchsorted(done, np.concatenate(([0], np.cumsum(size))))
        if done[-1] != size.sum() or (done[at[1:]] != np.cumsum(size)).any():
            return ids, None
        return ids, np.diff(at)

    def _numbers(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The cache's number of each unit."""
        if self.n > MAX_UNITS:
            self._shrink()
        start, size = bounds[:-1], np.diff(bounds)
        number = np.empty(len(start), np.int64)
        short = np.flatnonzero(size <= SHORT)
        words, length = _words(data), size[short]
        head = words[start[short]] & _KEEP[np.minimum(length, 8)]
        tail = np.where(length > 8, words[np.maximum(start[short] + length - 8, 0)], 0).astype(np.uint64)
        number[short] = self.table.find(head, tail, length)
        miss = np.flatnonzero(number[short] < 0)
        if len(miss):
            rows = np.stack((head[miss], tail[miss], length[miss].astype(np.uint64)))
            order = np.lexsort(rows)
            new = np.concatenate(([True], (rows[:, order[1:]] != rows[:, order[:-1]]).any(axis=0)))
            once = miss[order[new]]
            found = self._new(data, start[short[once]], length[once])
            self.table.add(head[once], tail[once], length[once].astype(np.uint8), found.astype(np.int32))
            number[short[miss[order]]] = found[np.cumsum(new) - 1]
        far = np.flatnonzero(size > SHORT)
        if len(far):
            flat, cut = _gathered(data, start[far], size[far])
            coded = pa.LargeStringArray.from_buffers(len(far), pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(flat))).dictionary_encode()
            units = coded.dictionary.to_pylist()
            lacking = [u for u in units if u not in self.long]
            if lacking:
                self.long.update(zip(lacking, self._add(*self._by_library(lacking)).tolist(), strict=True))
            number[far] = np.array([self.long[u] for u in units])[coded.indices.to_numpy()]
        seen = np.zeros(self.n, bool)
        seen[number] = True
        self.hits[: self.n] += seen
        return number

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents end to end, and the bounds of each."""
        whole = self._whole(data, offs)
        if len(whole):
            return self._mixed(data, offs, whole)
        starts = unit_starts(data, offs)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        number = self._numbers(data, np.append(starts, len(data)))
        ids, total = _gathered(self.ids, self.starts[number], self.starts[number + 1] - self.starts[number])
        return ids, total[np.searchsorted(starts, offs, "left")]

    def _whole(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Documents that the library must see as a whole."""
        if not self.direct:
            return np.flatnonzero(np.diff(offs))
        raw, found = data.tobytes(), set()
        for literal in self.literals:
            at = raw.find(literal)
            while at >= 0:
                d = int(np.searchsorted(offs, at, "right")) - 1
                if at + len(literal) <= offs[d + 1]:
                    found.add(d)
                    at = int(offs[d + 1]) - 1
                at = raw.find(literal, at + 1)
        return np.array(sorted(found), np.int64)

    def _mixed(self, data: np.ndarray, offs: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of ``whole`` by the library, the others by units."""
        ids, sizes = self._by_library([data[offs[d] : offs[d + 1]].tobytes().decode() for d in whole.tolist()])
        size = np.diff(offs)
        rest = np.setdiff1d(np.arange(len(size)), whole)
        flat, cut = _gathered(data, offs[rest], size[rest])
        own = self.encode(flat, cut) if self.direct else (np.zeros(0, np.uint32), np.zeros(len(cut), np.int64))
        count = np.zeros(len(size), np.int64)
        count[whole], count[rest] = sizes, np.diff(own[1])
        bounds = np.concatenate(([0], np.cumsum(count)))
        out = np.empty(bounds[-1], np.uint32)
        of_whole = np.zeros(len(size), bool)
        of_whole[whole] = True
        mask = np.repeat(of_whole, count)
        out[mask], out[~mask] = ids, own[0]
        return out, bounds


def encode_with_end(path: str, data: np.ndarray, offs: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents with ``end`` after each, and their bounds."""
    ids, bounds = encoder(path).encode(data, offs)
    out = np.full(len(ids) + len(offs) - 1, end, np.uint32)
    marks = bounds[1:] + np.arange(len(offs) - 1)
    keep = np.ones(len(out), bool)
    keep[marks] = False
    out[keep] = ids
    return out, bounds + np.arange(len(offs))
