"""Byte-level BPE by higher-order functions, against the tiktoken library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from evidra.llm.byte_bpe import Bpe, BpeParams, default_path, encode_texts, last_pair, read_ranks
from tests.llm.test_operators import AWKWARD, DOC, prose


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(default_path()), special_tokens={})


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    signs = "ab'sldmrtve 019 \t\n\r 　.,;-=éß中文ǅ²Ⅷ٣🌧️́‍𐐀Ƛ\U00010d4a\U000105c0\x85\x00\x01"
    mixed = ["".join(r.choice(signs) for _ in range(r.randint(1, 80))) for _ in range(300)]
    long = ["".join(r.choice("abcdeé中") for _ in range(700)), "=" * 999, " " * 501 + "x", "ab" * 3000, "\n" * 70 + " ", "don't we'll <|endoftext|>"]
    return AWKWARD + [(1000 + i, t) for i, t in enumerate(mixed + long + mixed[:40] + [prose(200, i) for i in range(20)])]


@pytest.mark.parametrize("words", [50, 1 << 18])
def test_like_the_library(spark, library, texts, words):
    docs = spark.createDataFrame(texts, DOC).repartition(3).withColumns({"ids": F.lit("mine"), "word": F.lit(1)})
    coded, bpe = encode_texts(docs, BpeParams(default_path(), words=words))
    got = coded.select("doc_id", "text", "ids", bpe.decode(F.col("ids")).alias("bytes"), bpe.little_endian(F.col("ids")).alias("raw")).collect()
    assert len(got) == len(texts)
    for r in got:
        want = library.encode_ordinary(r.text or "")
        assert r.ids == want and bytes(r.bytes) == (r.text or "").encode() and bytes(r.raw) == np.array(want, "<u4").tobytes(), r.text


def test_every_character_is_split_like_the_library(spark, library):
    """One text for each block of code points, letters and numbers of the newest tables included."""
    codes = [c for c in range(1, 0x32000) if not 0xD800 <= c < 0xE000] + list(range(0xE0000, 0xE0200))
    rows = [(i, " a".join(map(chr, codes[i : i + 64])) + "".join(map(chr, codes[i : i + 64]))) for i in range(0, len(codes), 64)]
    bpe = Bpe(spark, BpeParams(default_path()))
    got = spark.createDataFrame(rows, DOC).select("text", bpe.split(F.col("text")).alias("words")).collect()
    import regex  # noqa: F401
    import tiktoken

    cut = tiktoken.Encoding("cut", pat_str=public_tokenizers.PATTERN, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    for r in got:
        assert "".join(r.words) == r.text
        assert [w.encode() for w in r.words] == [bytes(cut.decode_bytes(ids)) for ids in _pieces(cut, r.text, r.words)]


def _pieces(cut, text, words):
    """Ids of each word by itself; equal to the whole text's only if the library cuts at the same places."""
    found = [cut.encode_ordinary(w) for w in words]
    assert [i for f in found for i in f] == cut.encode_ordinary(text)
    return found


def test_same_cuts(spark, texts):
    """The library's own cuts: a vocabulary that joins each match to one token shows them."""
    import regex

    bpe = Bpe(spark, BpeParams(default_path()))
    got = spark.createDataFrame(texts, DOC).select("text", bpe.split(F.col("text")).alias("words")).collect()
    for r in got:
        if not any(c in (r.text or "") for c in "Ƛ\U00010d4a\U000105c0"):  # younger than this library's tables
            assert r.words == regex.findall(public_tokenizers.PATTERN, r.text or "")


def test_lists_begin_with_their_most_frequent_words(spark):
    """A list of the known words is looked through from its begin on, so frequent words cost one comparison."""
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = [(i, " ".join(words[: 300 - i])) for i in range(300)]
    bpe = Bpe(spark, BpeParams(default_path(), words=1000, buckets=64)).learn(spark.createDataFrame(rows, DOC).repartition(3))
    lists = spark.range(1).select(F.transform(bpe.known, lambda m: F.map_keys(m)).alias("lists")).first().lists
    found = [[words.index(w.strip()) for w in found if w != words[0]] for found in lists]
    assert max(map(len, found)) > 2 and all(found == sorted(found) for found in found)


def test_empty_table(spark):
    coded, _ = encode_texts(spark.createDataFrame([], DOC), BpeParams(default_path(), words=10))
    assert coded.collect() == []


def test_a_vocabulary_with_an_unreachable_token_is_refused():
    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 256, b"bc": 257}
    with pytest.raises(ValueError, match="isn't made"):
        last_pair(b"abc", ranks)


def test_query(spark, library, tmp_path):
    from evidra.llm.queries import QUERIES

    rows = [(i, prose(40, i) if i % 5 else None) for i in range(40)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op12_byte_bpe"](spark, f"file://{tmp_path}").collect()}
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
