"""Importance resampling against plain strings, zlib and sorting."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.llm import blocks as B
from evidra.llm.importance import ImportanceParams, feature_crcs, resample, shifted
from tests.llm.test_operators import AWKWARD, DOC, lower, prose


def test_shift_is_what_zlib_computes():
    r = random.Random(3)
    for n in (0, 1, 2, 7, 63, 64, 1000, 65_537):
        a, b = r.randbytes(20), r.randbytes(n)
        own = int(shifted(np.array([zlib.crc32(a)], np.uint32), np.array([n]))[0]) ^ zlib.crc32(b)
        assert own == zlib.crc32(a + b)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def features(text, order):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("order", [1, 2, 4])
def test_features(order):
    texts = ["One two, TWO  three é中é", "", "x" * 5000 + " y", "!!", "a b", "Z"]
    raw = [t.encode() for t in texts]
    offs = np.cumsum([0, *map(len, raw)])
    got = [Counter() for _ in texts]
    for crc, doc in feature_crcs(np.frombuffer(b"".join(raw), np.uint8), offs, order):
        for c, d in zip(crc.tolist(), doc.tolist(), strict=True):
            got[d][c] += 1
    assert got == [Counter(zlib.crc32(f.encode()) for f in features(t, order)) for t in texts]


def plain(docs, target, p):
    s, t = (Counter(zlib.crc32(f.encode()) % p.buckets for text in rows for f in features(text, p.order)) for rows in ([x for _, x in docs], target))
    sa, ta = sum(s.values()) + p.buckets, sum(t.values()) + p.buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * sa / ((s[b] + 1) * ta)))
    out = []
    for i, text in docs:
        f = features(text, p.order)
        weight = sum(gain(zlib.crc32(x.encode()) % p.buckets) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{p.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    may = sorted((r for r, (_, text) in zip(out, docs, strict=True) if len(words(text)) >= p.min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(may[: len(may) * p.percent // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("p", [ImportanceParams(), ImportanceParams(order=3, buckets=64, min_words=1, percent=60, seed=1), ImportanceParams(percent=100, min_words=0), ImportanceParams(percent=0)])
def test_like_plain(spark, p):
    docs = AWKWARD + [(100 + i, prose(10 + i % 40, i % 50)) for i in range(200)]
    target = [prose(30, 5), prose(20, 6), None, ""]
    df = spark.createDataFrame(docs, DOC).repartition(3).withColumns({"rank": F.lit("r"), "weight": F.lit("w"), "bucket": F.lit(1), "above": F.lit(2)})
    got = resample(df, spark.createDataFrame([(t,) for t in target], "text string"), p).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == plain(docs, target, p)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOC)
    assert resample(none, none).collect() == []
    one = spark.createDataFrame([(1, prose(30, 1)), (2, None)], DOC)
    assert sorted((r.doc_id, r.n_features, r.rank) for r in resample(one, none, ImportanceParams(percent=100)).collect()) == [(1, 59, 1), (2, 0, None)]


def test_blocks_do_not_matter(monkeypatch, spark):
    docs = spark.createDataFrame([(i, prose(50, i)) for i in range(40)], DOC)
    want = sorted(map(tuple, resample(docs, docs).collect()))
    monkeypatch.setattr(B, "BLOCK_BYTES", 100)
    assert sorted(map(tuple, resample(docs, docs).collect())) == want
