"""Collocations against plain counts of every phrase."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.llm import blocks as B
from evidra.llm import collocations as K
from evidra.llm.collocations import CollocationParams, collocations, exact_score, shard_counts
from tests.llm.test_operators import AWKWARD, lower

DOC = "doc_id long, text string, lang string"


def plain(rows, p):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, p.longest + 1) for i in range(len(w) - k + 1))
    often = {g: a for g, a in f.items() if len(g) > 2 and a >= p.least}
    superfluous = {(g[0], *g[i : i + k]) for g, a in often.items() for k in range(2, len(g) - 1) for i in range(1, len(g) - k + 1) if 100 * a >= 100 * f[(g[0], *g[i : i + k])]}
    out = {}
    for g, a in often.items():
        if g not in superfluous:
            lang, w = g[0], g[1:]
            score, k = min((1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return sorted((lang, i + 1, g.decode(), -a, left, right, n[lang], -s) for lang, own in out.items() for i, (s, a, g, left, right) in enumerate(sorted(own)[: p.top]))


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["É", "中文", "Of", "of", "THE"]
    phrases = [[r.choice(words) for _ in range(r.randint(2, 7))] for _ in range(25)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(r.randint(0, 30)):
            w += r.choice(phrases) if r.random() < 0.6 else [r.choice(words)]
        text = "".join(x + r.choice([" "] * 12 + ["  ", "\t", ". ", ",", "\n", " ; ", "?!"]) for x in w)
        rows.append((i, text, r.choice(["en", "en", "en", "de", None, ""])))
    return rows + [(i, t, "en") for i, t in AWKWARD[:4]] + [(9000, "a " * 700, "xx"), (9001, "a b " * 400, "xx"), (9002, "x" * 100_000, "xx")]


@pytest.mark.parametrize("p", [CollocationParams(least=5), CollocationParams(least=12, longest=3, top=7), CollocationParams(least=20, longest=2), CollocationParams(least=3, longest=6, shard_words=500, filter_bits=1 << 15)])
def test_like_plain(spark, p):
    rows = corpus(p.least, 150)
    df = spark.createDataFrame(rows, DOC).repartition(5).withColumns({"key": F.lit("k"), "words": F.lit(1), "rank": F.lit("r"), "n": F.lit(0)})
    got = sorted(map(tuple, collocations(df, p).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
    assert got == plain([(t, g) for _, t, g in rows], p) and len(got) > 10


def test_small_blocks(spark, monkeypatch):
    rows = corpus(1, 60)
    monkeypatch.setattr(B, "BLOCK_BYTES", 200)
    got = sorted(map(tuple, collocations(spark.createDataFrame(rows, DOC), CollocationParams(least=5)).collect()))
    assert got == plain([(t, g) for _, t, g in rows], CollocationParams(least=5))


def test_empty(spark):
    assert collocations(spark.createDataFrame([], DOC)).collect() == []
    assert collocations(spark.createDataFrame([(1, None, None), (2, "a b", "en")], DOC)).collect() == []


def test_rare_triples_of_frequent_pairs_are_no_rows(spark):
    """All pairs of eight words are frequent and few of their triples are; triples once were a row for each shard they come up in."""
    r, p = random.Random(4), CollocationParams(least=100, shard_words=1000)
    rows = [(i, " ".join([*(r.choice("abcdefgh") for _ in range(60)), *"cab", f"u{i}"]), "en") for i in range(400)]
    docs = K.with_lang(spark.createDataFrame(rows, DOC).repartition(4), "text", "lang")
    kept = K._filter_of(K._word_counts(docs).where(F.col("f") >= p.least).select("key"), p.filter_bits)
    pairs = K._phrases(docs, p, K._Filters(2, kept))
    assert pairs.count() == 64
    some = K._Filters(3, kept, K._filter_of(pairs.select(F.col("words")[0], F.col("words")[1]), p.filter_bits))
    own = K.replace(some, buckets=K._full_buckets(docs, p, some))
    found = {tuple(x.words): x.f for x in K._phrases(docs, p, own).collect()}
    assert found == {tuple(x.words): x.f for x in K._phrases(docs, p, some).collect()} and 0 < len(found) < 20
    assert K._shard_rows(docs, p, own).count() <= 30 * len(found) < K._shard_rows(docs, p, some).count() / 10
    assert sorted(map(tuple, collocations(docs, p).collect())) == plain([(t, g) for _, t, g in rows], p)


@pytest.mark.parametrize("depth", [2, 3, 5, 9])
def test_suffix_array_counts(depth):
    r = np.random.default_rng(depth)
    for n in (1, 2, 50, 2000):
        words, run = r.integers(0, 4, n).astype(np.uint64), np.cumsum(r.random(n) < 0.1)
        for size, at, f in shard_counts(words, run, 1, depth):
            want = Counter(tuple(words[i : i + size]) for i in range(n - size + 1) if run[i] == run[i + size - 1])
            assert {tuple(words[i : i + size]): c for i, c in zip(at.tolist(), f.tolist(), strict=True)} == want and len(at) == len(want)


def test_scores_past_64_bits(spark):
    rows = [(10**12 + 7, 3 * 10**14 + 1, 10**13 + 9, 10**12 + 8), (123, 10**18, 124, 125), (7, 9, 8, 9)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = [x[0] for x in df.select(exact_score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))).collect()]
    assert got == [1000 * a * n // (left * right) for a, n, left, right in rows]
