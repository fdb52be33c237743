"""Collocations: phrases of 2 to ``longest`` words whose every cut is far from chance.

Texts are lowered (A-Z) and cut into pieces at ``. , ; : ! ?`` and line ends,
pieces into words at spaces and tabs; all counts are per language.  A phrase's
count is that of all its places within pieces, overlaps included.

Word-id suffix arrays count phrases, a shard of some million words at a time:
prefix doubling ranks all places by their first word, two words, four words
and so on, equal ranks of neighbours in the order give the longest common
prefixes, and each interval of places that share a prefix of k words is one
phrase with its count.  A phrase can be frequent though it is rare in each
shard, so every interval, of one place too, is merged by key.

What can't be part of a candidate is left out before the shards are sorted, in
the manner of frequent item sets, and without changing a count.  Pieces are cut
at words that are rarer than ``least`` in their language.  Lengths come one
after the other: a phrase is counted only where both phrases that are a word
shorter are frequent.  These filters are Bloom bitmaps of ``filter_bits`` bits,
however many frequent phrases there are; a false hit costs a key that the count
by key drops again.

Frequent pairs make many more rare triples, so triples are first counted by
bucket of their fingerprint, ``filter_bits`` buckets in all, and only those of a
bucket with ``least`` places go on as rows.  A bucket's count is never under
that of a phrase in it.  With far over ``least * filter_bits`` places most
buckets pass, and what bounds the rows is that a place makes one of each length.

Words and phrases are compared by 64-bit fingerprints, two different ones
collide with a probability of about 2^-64.  Scores are exact decimals of 38
digits.  Null and empty texts have no words; a null language is ``und``;
repeated rows count each; a text may have any length; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.llm import blocks as B
from evidra.llm.scratch import stored

_VALUES = B.byte_values(lower=True, seed=11)
_BREAK = np.zeros(256, bool)
_BREAK[[10, 11, 12, 13, 33, 44, 46, 58, 59, 63]] = True
_INSIDE = ~_BREAK
_INSIDE[[9, 32]] = False
#: Tasks that make a bitmap, each of which sends it to the driver.
_FILTER_TASKS = 8
#: Buckets whose counts are a row on their way to be summed; offsets in it are 16 bits.
_SLICE = 1 << 14
#: Parts of a language whose first phrases are found apart.
_PARTS = 64
_STEP = np.uint64(0xA0761D6478BD642F)


@dataclass(frozen=True)
class CollocationParams:
    least: int = 100
    longest: int = 5
    top: int = 2000
    #: Words of a shard, which a task sorts at a time.
    shard_words: int = 1 << 19
    #: Bits of a bitmap, and buckets of triples; a power of two.
    filter_bits: int = 1 << 25


def with_lang(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))


def prints_of(langs: list[str]) -> np.ndarray:
    """A 64-bit number for each language, which its words' fingerprints start from."""
    raw = [x.encode() for x in langs]
    offs = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    return B.fingerprints(B.prefix_sums(data, B.byte_values(lower=False, seed=3)), offs[:-1], offs[1:])


def words_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """Blocks of a batch: fingerprint (with its language), piece and language of each word, then bytes, starts, ends and language names."""
    coded = batch.column(0).dictionary_encode()
    langs = coded.dictionary.to_pylist()
    salt, own = prints_of(langs), coded.indices.to_numpy()
    data, offs = B.utf8(batch.column(1))
    for i, j in B.slices(offs):
        part, cut = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        start, end, doc = B.segment(part, cut, _INSIDE)
        if not len(start):
            continue
        breaks = np.concatenate(([0], np.cumsum(_BREAK[part])))
        # A piece ends at a break and at its document's end; both only grow along the block.
        piece = breaks[start] + doc
        lang = own[i + doc]
        yield B.mix(B.fingerprints(B.prefix_sums(part, _VALUES), start, end) ^ salt[lang]), piece, lang, part, start, end, langs


def bitmap(keys: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits >> 3, np.uint8)
    for shift in (0, 32):
        at = (keys >> np.uint64(shift)) & np.uint64(bits - 1)
        np.bitwise_or.at(out, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    return out


def hits(keys: np.ndarray, bits: np.ndarray, shifts: tuple[int, ...] = (0, 32)) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for shift in shifts:
        at = (keys >> np.uint64(shift)) & np.uint64(len(bits) * 8 - 1)
        found &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
    return found


def _filter_of(words: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of a table of words or pairs, made in tasks and united: its size is fixed, the number of rows isn't."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(bits >> 3, np.uint8)
        for batch in batches:
            parts = np.stack([c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns], axis=1)
            n, size = parts.shape
            total |= bitmap(parts[:, 0] if size == 1 else phrase_key(parts.reshape(-1), np.arange(n) * size, size), bits)
        # Slices of 4 KiB, those with a bit only, united by place.
        rows = total.reshape(-1, min(4096, len(total)))
        at = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([rows[k].tobytes() for k in at.tolist()], pa.binary())], ["at", "bits"])

    out = np.zeros(bits >> 3, np.uint8)
    rows = out.reshape(-1, min(4096, len(out)))
    for at, own_bits in words.coalesce(_FILTER_TASKS).mapInArrow(own, "at long, bits binary").collect():
        rows[at] |= np.frombuffer(bytes(own_bits), np.uint8)
    return out


def phrase_key(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the runs of ``size`` words that begin at ``at``."""
    acc = np.full(len(at), size, np.uint64)
    for j in range(size):
        acc = acc * _STEP + words[at + j]
    return B.mix(acc)


def suffix_array(ids: np.ndarray, room: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places in the order of their next ``depth`` words, and each place's rank by its first 1, 2, 4, ... words.

    ``ids`` are dense word ids; ``room`` is the number of words left in a
    place's own run, past which nothing is compared: a run's end sorts first.
    Prefix doubling: the rank by 2k words is that of the pair of ranks by k
    words, here and k places on.
    """
    n = len(ids)
    order, ranks, k = np.zeros(0, np.int64), [ids], 1
    while k < depth:
        on = np.minimum(np.arange(n) + k, n - 1)
        follow = np.where(room > k, ranks[-1][on] + 1, 0)
        pair = ranks[-1] * np.int64(n + 1) + follow
        order = np.argsort(pair)
        step = np.concatenate(([0], np.cumsum(pair[order][1:] != pair[order][:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = step
        ranks.append(rank)
        k *= 2
    return order, ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray], room: np.ndarray, depth: int) -> np.ndarray:
    """Words that each place of the order shares with the one before it, ``depth`` at most: ranks are compared from the longest down."""
    n = len(order)
    shared = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    left = np.minimum(np.minimum(room[a], room[b]), depth)
    got = np.zeros(n - 1, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        size = 1 << level
        can = np.flatnonzero(left - got >= size)
        x, y = a[can] + got[can], b[can] + got[can]
        got[can[ranks[level][x] == ranks[level][y]]] += size
    shared[1:] = got
    return shared


def shard_counts(words: np.ndarray, run: np.ndarray, least: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: a place and the count of each different phrase of a shard, from the intervals of its suffix array."""
    n = len(words)
    if not n:
        return
    last = np.flatnonzero(np.concatenate((run[1:] != run[:-1], [True])))
    room = last[np.searchsorted(last, np.arange(n))] - np.arange(n) + 1
    _, ids = np.unique(words, return_inverse=True)
    order, ranks = suffix_array(ids.astype(np.int64), room, longest)
    shared = common_prefixes(order, ranks, room, longest)
    for size in range(least, longest + 1):
        fits = room[order] >= size
        # Places that share ``size`` words are an interval, and none between them is too short.
        at = np.flatnonzero(fits & (shared < size))
        total = np.concatenate(([0], np.cumsum(fits)))
        yield size, order[at], total[np.concatenate((at[1:], [n]))] - total[at]


def _word_counts(docs: DataFrame) -> DataFrame:
    """``lang, key, word, f`` of each different word; a word's row keeps one of its spellings, all of which lower to the same."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, _, lang, part, start, end, langs in words_of(batch):
                keys, first, n = np.unique(words, return_index=True, return_counts=True)
                raw = memoryview(np.ascontiguousarray(part))
                spelled = [bytes(raw[a:b]).lower().decode() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
                names = pa.DictionaryArray.from_arrays(pa.array(lang[first].astype(np.int32)), pa.array(langs, pa.string())).dictionary_decode()
                yield pa.RecordBatch.from_arrays([names, pa.array(keys.view(np.int64)), pa.array(spelled, pa.string()), pa.array(n)], ["lang", "key", "word", "n"])

    counted = docs.mapInArrow(count, "lang string, key long, word string, n long")
    return counted.groupBy("lang", "key", "word").agg(F.sum("n").alias("f"))


@dataclass(frozen=True)
class _Filters:
    """Bitmaps of what a phrase of ``size`` words may hold: its words, both phrases a word shorter, and its own bucket."""

    size: int
    words: np.ndarray
    shorter: np.ndarray | None = None
    buckets: np.ndarray | None = None

    def places(self, words: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Where a phrase may begin."""
        n = len(words) - self.size + 1
        if n < 1:
            return np.zeros(0, np.int64)
        good = hits(words, self.words)
        fits = piece[:n] == piece[self.size - 1 :]
        for j in range(self.size):
            fits &= good[j : j + n]
        at = np.flatnonzero(fits)
        if self.shorter is not None:
            for j in (0, 1):
                at = at[hits(phrase_key(words, at + j, self.size - 1), self.shorter)]
        return self.own(words, at)

    def own(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the phrases at ``at``, those whose bucket is full enough."""
        return at if self.buckets is None else at[hits(phrase_key(words, at, self.size), self.buckets, (0,))]


def _full_buckets(docs: DataFrame, p: CollocationParams, filters: _Filters) -> np.ndarray:
    """The bitmap of buckets that ``least`` places or more fall in; slices of counts are summed in tasks."""
    shared, width = docs.sparkSession.sparkContext.broadcast(filters), min(_SLICE, p.filter_bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may, n = shared.value, 0
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            bucket, f = np.unique(np.concatenate(held), return_counts=True)
            at, begin = np.unique(bucket // width, return_index=True)
            cuts = [*begin.tolist(), len(bucket)]
            offset, f = (bucket % width).astype("<u2"), np.minimum(f, p.least).astype("<u4")
            parts = [pa.array([x[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)], pa.binary()) for x in (offset, f)]
            return pa.RecordBatch.from_arrays([pa.array(at), *parts], ["at", "offsets", "counts"])

        for batch in batches:
            for words, piece, *_ in words_of(batch):
                at = may.places(words, piece)
                held.append((phrase_key(words, at, may.size) & np.uint64(p.filter_bits - 1)).astype(np.int64))
                n += len(at)
                if n >= p.shard_words:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros(width, np.int64)
        full = lambda: pa.RecordBatch.from_arrays([pa.array([now]), pa.array([np.packbits(sums >= p.least, bitorder="little").tobytes()], pa.binary())], ["at", "bits"])
        for batch in batches:
            for at, offsets, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != now:
                    if now is not None:
                        yield full()
                    now, sums = at, np.zeros(width, np.int64)
                sums[np.frombuffer(offsets, "<u2")] += np.frombuffer(f, "<u4")
        if now is not None:
            yield full()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = docs.mapInArrow(count, "at long, offsets binary, counts binary")
    summed = counted.repartition(n, "at").sortWithinPartitions("at").mapInArrow(total, "at long, bits binary")
    out = np.zeros(p.filter_bits >> 3, np.uint8)
    rows = out.reshape(-1, width >> 3)
    for at, own_bits in summed.where(F.col("bits") != F.lit(bytes(width >> 3))).collect():
        rows[at] = np.frombuffer(bytes(own_bits), np.uint8)
    return out


def _shard_rows(docs: DataFrame, p: CollocationParams, filters: _Filters) -> DataFrame:
    """``w0, w1, ..., n``: each shard's different phrases of ``filters.size`` words that may be frequent, with their count in it."""
    # Of fixed size: ``filter_bits`` / 8 bytes each.
    shared, size = docs.sparkSession.sparkContext.broadcast(filters), filters.size
    names = [f"w{j}" for j in range(size)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n, runs = 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            words, run = (np.concatenate(x) for x in zip(*held, strict=True))
            for _, at, f in shard_counts(words, run, size, size):
                for a in range(0, len(at), 1 << 16):
                    own, first = at[a : a + (1 << 16)], f[a : a + (1 << 16)]
                    if may.buckets is not None:
                        full = hits(phrase_key(words, own, size), may.buckets, (0,))
                        own, first = own[full], first[full]
                    yield pa.RecordBatch.from_arrays([*(pa.array(words[own + j].view(np.int64)) for j in range(size)), pa.array(first)], [*names, "n"])

        for batch in batches:
            for words, piece, *_ in words_of(batch):
                at = may.places(words, piece)
                # Words that no such place covers are left out; a run ends where no place holds a word and the next.
                joined, keep = np.zeros(len(words), bool), np.zeros(len(words), bool)
                for j in range(size):
                    keep[at + j] = True
                    joined[at + j] |= j > 0
                run = np.cumsum(~joined)
                held.append((words[keep], run[keep] + runs))
                runs += int(run[-1]) + 1
                n += int(keep.sum())
                if n >= p.shard_words:
                    yield from flush()
                    held, n, runs = [], 0, 0
        if n:
            yield from flush()

    return docs.mapInArrow(count, ", ".join(f"{c} long" for c in [*names, "n"]))


def _phrases(docs: DataFrame, p: CollocationParams, filters: _Filters) -> DataFrame:
    """``words``, their keys in order, and ``f`` of all phrases of ``filters.size`` words with a count of ``p.least``."""
    names = [f"w{j}" for j in range(filters.size)]
    often = _shard_rows(docs, p, filters).groupBy(*names).agg(F.sum("n").alias("f")).where(F.col("f") >= p.least)
    return often.select(F.array(*names).alias("words"), "f")


def exact_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """``floor(1000 * a * n / (left * right))`` in decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", (wide(a) * wide(n)).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)"), wide(left) * wide(right))


def collocations(docs: DataFrame, params: CollocationParams | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """Each language's first ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``.

    Of a candidate's cuts the lowest-scoring one counts, of equal ones the
    first.  A candidate that a longer one holds as often as it comes up itself
    is dropped.
    """
    p = params or CollocationParams()
    docs = with_lang(docs, text, lang)
    words = stored(_word_counts(docs), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.where(F.col("f") >= p.least)
    kept = _filter_of(frequent.select("key"), p.filter_bits)
    found = level = stored(_phrases(docs, p, _Filters(2, kept)), "pairs")
    for size in range(3, p.longest + 1):
        filters = _Filters(size, kept, _filter_of(level.select(*[F.col("words")[j] for j in range(size - 1)]), p.filter_bits))
        if not filters.shorter.any():
            break
        if size == 3:
            filters = replace(filters, buckets=_full_buckets(docs, p, filters))
        level = stored(_phrases(docs, p, filters), "phrases")
        found = found.unionByName(level)
    known = found.unionByName(frequent.select(F.array("key").alias("words"), "f")).select(F.col("words").alias("part"), F.col("f").alias("part_f"))
    # Both sides of every cut; those that are a word shorter may be made superfluous by this phrase.
    cut = found.select("words", "f", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    sides = F.array(F.struct(F.lit(True).alias("left"), F.slice("words", F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("left"), F.slice("words", F.col("k") + 1, F.size("words")).alias("part")))
    parts = cut.withColumn("side", F.explode(sides)).select("words", "f", "k", "side.left", "side.part")
    parts = stored(parts.join(known, "part"), "parts")
    shorter = (F.size("part") > 1) & (F.size("part") == F.size("words") - 1) & (F.col("f") >= F.col("part_f"))
    dropped = parts.where(shorter).select(F.col("part").alias("words")).distinct()
    of = lambda left: F.max(F.when(F.col("left") == F.lit(left), F.col("part_f")))
    cuts = parts.groupBy("words", "f", "k").agg(of(True).alias("l"), of(False).alias("r")).join(dropped, "words", "left_anti")
    first = frequent.select(F.col("key").alias("first"), "lang")
    own = cuts.withColumn("first", F.col("words")[0]).join(first, "first").join(totals, "lang").withColumnRenamed("f", "a")
    scored = own.withColumn("score", exact_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    best = scored.groupBy("words", "lang", "n", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "words", "a", "n", "cut.l", "cut.r", "cut.score", F.pmod(F.hash("words"), F.lit(_PARTS)).alias("bin"))
    # Only phrases that can be among the first are written out; ties at the end stay in.  Parts of a language come first, so no task has all of it.
    place = lambda *by: F.rank().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a")))
    top = best.withColumn("place", place("lang", "bin")).where(F.col("place") <= p.top).withColumn("place", place("lang")).where(F.col("place") <= p.top)
    letters = top.select("words", F.posexplode("words").alias("at", "word_key")).join(frequent.select(F.col("key").alias("word_key"), "word"), "word_key")
    phrase = letters.groupBy("words").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    return top.join(phrase, "words").withColumn("rank", rank).where(F.col("rank") <= p.top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
