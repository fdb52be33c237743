"""Byte-level BPE in Spark's own expressions: higher-order functions fold ranked merges.

A word, one match of the splitting pattern, becomes an array of the ids of its
bytes, each with the rank that a literal map gives to it and the next one.  Each
step of a fold joins the pair of lowest rank, the leftmost first, and looks up
the ranks of the two new pairs only, until no pair has a rank.  Words of over
``LONG`` pieces join all such pairs in one step, so their work is linear for
each different merge.

The map holds one pair for each token: the two pieces that the token's own
bytes come down to.  That is the pair by which ranked merges reach the token
in any context, as long as every token's bytes encode to the token itself;
:func:`load` refuses a vocabulary in which one doesn't.

The distinct words of all texts are counted, and the ``words`` most frequent
ones, of ``word_bytes`` bytes at most, are folded once; their ids are a second
literal map, whose lists begin with their most frequent words.  All other words are folded where they stand, so no text, word
position or id is shuffled, and a row's ids don't depend on what the map holds.
Both maps have a fixed bound and are part of the plan.

Null and empty texts have no ids.  Repeated rows are encoded row by row.  A
text may have any length.  Columns named like a result's are replaced.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Callable
from dataclasses import dataclass

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm.scratch import stored

#: Pieces from which on a step joins all pairs of the lowest rank.
LONG = 64
#: Characters that are white space to the splitting pattern, as Java writes them.
WHITE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
MARKS = r"!-/:-@\[-`{-~"
_LOW = 0xFFFFFFFF
#: The rank of a pair that isn't in the map, above all ranks, in the upper half of a piece.
_NONE = 0x7FFFFFFF << 32
#: What stands in front of a word's first piece, and makes a pair with none.
_BEGIN = 0x7FFFFFFF
_PLAN_KEY, PLAN_CHARS = "spark.sql.maxPlanStringLength", 200_000


@dataclass(frozen=True)
class BpeParams:
    path: str
    #: Frequent words whose ids are kept in the plan, and the bytes of the longest of them.
    words: int = 1 << 18
    word_bytes: int = 48
    #: Lists of either literal map; a power of two.
    buckets: int = 1 << 14

    def __post_init__(self) -> None:
        if self.buckets & (self.buckets - 1) or self.buckets < 1:
            raise ValueError("buckets must be a power of two")
        if self.word_bytes >= 64:
            raise ValueError("word_bytes must be under 64")


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[int, int]:
    """The two pieces from which ranked merges make a token."""
    pieces = [token[i : i + 1] for i in range(len(token))]
    while len(pieces) > 2:
        found = [ranks.get(a + b, len(ranks)) for a, b in zip(pieces, pieces[1:], strict=False)]
        at = found.index(min(found))
        if found[at] >= ranks[token]:
            raise ValueError(f"token {token!r} isn't made by merges of lower rank")
        pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
    return ranks[pieces[0]], ranks[pieces[1]]


def _class_of(kind: str) -> str:
    """All characters of a category, by the tables of the library whose pattern it is."""
    import tiktoken

    every = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x110000)]))
    only = tiktoken.Encoding(f"only {kind}", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return bytes(only.encode_ordinary(every)).decode()


def _ranges(text: str) -> str:
    """Sorted characters as ranges of a class."""
    out: list[list[int]] = []
    for c in map(ord, text):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in out)


def java_pattern(spark: SparkSession) -> str:
    """``public_tokenizers.PATTERN`` for Java, whose tables may lack the newest letters and numbers: these are listed."""
    letter, number = (
        rf"\p{{{k}}}" + _ranges(spark.range(1).select(F.regexp_replace(F.lit(_class_of(rf"\p{{{k}}}")), rf"\p{{{k}}}+", "")).first()[0]) for k in ("L", "N")
    )
    # Runs that an ASCII character or the end closes come first: the long classes are looked through for the others only.
    plain = rf" ?\p{{L}}++(?=[\x00-\x7F]|\z)| ?\p{{N}}++(?=[\x00-\x7F]|\z)| ?[{MARKS}]++(?=[\t-\r 0-9A-Za-z]|\z)"
    return rf"'(?:[stmd]|re|ve|ll)|{plain}| ?[{letter}]+| ?[{number}]+| ?[^{WHITE}{letter}{number}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


class Bpe:
    """The literal maps of a vocabulary, and columns made with them."""

    def __init__(self, spark: SparkSession, params: BpeParams) -> None:
        self.params = params
        # Literal maps would fill the descriptions that a session keeps of its plans.
        if int(spark.conf.get(_PLAN_KEY).rstrip("b")) > PLAN_CHARS:
            spark.conf.set(_PLAN_KEY, PLAN_CHARS)
        ranks = read_ranks(params.path)
        if sorted(ranks.values()) != list(range(len(ranks))) or any(bytes([i]) not in ranks for i in range(256)):
            raise ValueError("ranks must run from 0 without a gap and hold every byte")
        if os.path.basename(params.path).startswith("byte_bpe_multi"):
            raise ValueError("only the vocabulary of public_tokenizers.PATTERN is known")
        tokens = sorted(ranks, key=ranks.__getitem__)
        lists: list[dict[str, int]] = [{} for _ in range(params.buckets)]
        for token in tokens:
            if len(token) > 1:
                a, b = last_pair(token, ranks)
                lists[(a << 5 ^ b) & (params.buckets - 1)][str(a << 32 | b)] = ranks[token] << 32
        self.merges = F.from_json(F.lit(json.dumps(lists)), "array<map<string,bigint>>").cast("array<map<bigint,bigint>>")
        self.bytes = self._array([*(str(ranks[bytes([i])]) for i in range(256)), str(_BEGIN)]).cast("array<bigint>")
        self.pieces = self._array([t.hex() for t in tokens])
        self.unsigned = self._array([i.to_bytes(4, "little").hex() for i in range(len(tokens))])
        self.pattern = java_pattern(spark)
        self.known: Column | None = None

    @staticmethod
    def _array(values: list[str]) -> Column:
        return F.split(F.lit(",".join(values)), ",")

    def split(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def _ranked(self, merges: Column, a: Column, b: Column) -> Column:
        """A piece, with the rank of the pair that it makes with the next one in its upper half."""
        bucket = F.get(merges, F.shiftleft(a, 5).bitwiseXOR(b).bitwiseAND(F.lit(self.params.buckets - 1)))
        return a.bitwiseOR(F.coalesce(F.element_at(bucket, F.shiftleft(a, 32).bitwiseOR(b)), F.lit(_NONE)))

    def _all_ranked(self, merges: Column, pieces: Column) -> Column:
        return F.transform(pieces, lambda a, i: self._ranked(merges, a, F.get(pieces, i + 1)))

    def _joined(self, merges: Column, ranked: Column, at: Column) -> Column:
        """Ranked pieces after the join of the pair behind a place, or of all pairs like it."""
        token = F.shiftright(F.get(ranked, at + 1), 32)
        piece = lambda k: F.get(ranked, k).bitwiseAND(F.lit(_LOW))
        before, own, gone = self._ranked(merges, piece(at), token), self._ranked(merges, token, piece(at + 3)), F.lit(-1).cast("bigint")
        one = F.transform(ranked, lambda x, i: F.when(i < at, x).when(i > at + 2, x).when(i == at, before).when(i == at + 1, own).otherwise(gone))
        # Of pairs that overlap, as in a run of one letter, every second one is joined: "111" becomes "101".
        same = F.transform(ranked, lambda x: F.when(F.shiftright(x, 32) == token, F.lit("1")).otherwise(F.lit("0")))
        marks = F.split(F.replace(F.array_join(same, ""), F.lit("11"), F.lit("10")), "")

        def every(m: Column) -> Column:
            left = F.filter(F.sequence(F.lit(0), F.size(ranked) - 1), lambda k: (k == 0) | (F.get(m, k - 1) != "1"))
            return F.transform(left, lambda k: F.when(F.get(m, k) == "1", token).otherwise(piece(k)))

        return F.when(F.size(ranked) <= LONG, F.array_remove(one, gone)).otherwise(_let(_let(marks, every), lambda p: self._all_ranked(merges, p)))

    def _fold(self, merges: Column, word: Column) -> Column:
        # One character for each byte, and one for what stands in front.
        each = F.split(F.concat(F.lit("\u0100"), F.decode(word.cast("binary"), "ISO-8859-1")), "")
        begin = F.transform(each, lambda c: F.get(self.bytes, F.ascii(c)))
        # The place before the leftmost pair of the lowest rank: pairs of one rank begin with the same piece.
        first = lambda ranked: F.array((F.array_position(ranked, F.array_min(ranked)) - 2).cast("int"))
        # The inner fold has one element, that place; unlike a transformation's, its result isn't copied.
        join = lambda ranked: F.aggregate(first(ranked), ranked, lambda same, at: self._joined(merges, same, at))
        # A mark in front says that no pair is left, so that the steps behind it don't look at all pieces.
        done = lambda ranked: F.flatten(F.array(F.array(F.lit(-1).cast("bigint")), ranked))
        step = lambda ranked, _: F.when(F.get(ranked, F.lit(0)) < 0, ranked).when(F.array_min(ranked) < _NONE, join(ranked)).otherwise(done(ranked))
        ids = lambda ranked: F.transform(F.filter(ranked, lambda x: x.bitwiseAND(F.lit(_LOW)) < _BEGIN), lambda x: x.bitwiseAND(F.lit(_LOW)).cast("int"))
        return _let(begin, lambda pieces: F.aggregate(pieces, self._all_ranked(merges, pieces), step, ids))

    def fold(self, word: Column) -> Column:
        """Ids of one word by ranked merges over its bytes."""
        # Bound to a variable, the map stands in the plan once.
        return _let(self.merges, lambda merges: self._fold(merges, word))

    def learn(self, docs: DataFrame, text: str = "text") -> Bpe:
        """Keeps the ids of the most frequent distinct words of all texts: at most ``words`` of ``word_bytes`` bytes."""
        p = self.params
        if not p.words:
            return self
        words = docs.select(F.explode(self.split(F.col(text))).alias("word")).where(F.octet_length("word") <= p.word_bytes)
        top = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(p.words).repartition(docs.sparkSession.sparkContext.defaultParallelism)
        folded = stored(top.select("word", self.fold(F.col("word")).alias("ids"), self._bucket(F.col("word")).alias("bucket"), "count"), "words")
        # A list is looked through from its begin on.  Each comes to the driver as one text.
        entry = F.to_json(F.create_map("word", "ids"))
        kept = folded.select("bucket", F.struct(-F.col("count"), "word", F.substring(entry, F.lit(2), F.length(entry) - 2).alias("entry")).alias("kept"))
        texts = kept.groupBy("bucket").agg(F.array_join(F.sort_array(F.collect_list("kept"))["entry"], ",").alias("text"))
        maps = ["{}"] * p.buckets
        for bucket, found in texts.toLocalIterator():  # at most ``words`` entries of ``word_bytes`` bytes
            maps[bucket] = "{" + found + "}"
        self.known = F.from_json(F.lit("[" + ",".join(maps) + "]"), "array<map<string,array<int>>>")
        return self

    def _bucket(self, word: Column) -> Column:
        return F.hash(word).bitwiseAND(F.lit(self.params.buckets - 1))

    def _word_ids(self, merges: Column, word: Column) -> Column:
        if self.known is None:
            return self._fold(merges, word)
        return F.coalesce(F.element_at(F.get(self.known, self._bucket(word)), word), self._fold(merges, word))

    def word_ids(self, word: Column) -> Column:
        return _let(self.merges, lambda merges: self._word_ids(merges, word))

    def encode(self, text: Column) -> Column:
        """Ids of a whole text: each match of the pattern by itself."""
        return _let(self.merges, lambda merges: F.flatten(F.transform(self.split(text), lambda word: self._word_ids(merges, word))))

    def decode(self, ids: Column) -> Column:
        """The bytes of ids: their pieces one after the other; an unknown id is null."""
        # No byte is written "x", so one makes the whole null.
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(self.pieces, i)), "", "x"))

    def little_endian(self, ids: Column) -> Column:
        """Ids as little-endian unsigned 32-bit integers."""
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(self.unsigned, i)), ""))


def encode_texts(docs: DataFrame, params: BpeParams, text: str = "text") -> tuple[DataFrame, Bpe]:
    """``docs`` with ``ids``, and the maps they were made with."""
    bpe = Bpe(docs.sparkSession, params).learn(docs, text)
    return docs.withColumn("ids", bpe.encode(F.col(text))), bpe
