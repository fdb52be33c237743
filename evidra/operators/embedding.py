"""Embedding cache and incremental embedding."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH = 16
#: Bits of the bitmap of keys that several chunks or the cache may have.
KEY_BITS = 1 << 25


def cache_key(model: str, dims: int, text: Column) -> Column:
    """Digest of model, size and text; a change of any misses the cache."""
    return F.sha2(F.concat_ws("|", F.lit(model), F.lit(str(dims)), text), 256)


def plan(chunks: DataFrame, cache: DataFrame, model: str, dims: int) -> DataFrame:
    """``chunks(chunk_id, seq, text)`` with ``cache_key`` and ``source``: hit, embed, or reuse.

    The first miss of a key in ``seq`` order is embedded, its equals reuse it.
    The first place comes from an aggregate that is joined back, so a key
    shared by many chunks isn't sorted in one task.
    """
    keyed = chunks.withColumn("cache_key", cache_key(model, dims, F.col("text")))
    first = keyed.groupBy("cache_key").agg(F.min(F.struct("seq", "chunk_id")).alias("f")).select("cache_key", F.col("f.chunk_id").alias("first_id"))
    known = cache.select("cache_key").distinct().withColumn("known", F.lit(True))
    joined = keyed.join(first.join(known, "cache_key", "left"), "cache_key")
    return joined.withColumn("source", F.when(F.col("known"), "hit").when(F.col("chunk_id") == F.col("first_id"), "embed").otherwise("reuse")).drop("known", "first_id")


def receipts(planned: DataFrame, made: DataFrame | None = None, batch: int = BATCH) -> DataFrame:
    """One row: cache hits, reuses, embedded texts and requests.

    ``made``: the rows of :func:`embed_misses`, whose requests are counted;
    without it the least number of requests that the plan needs.
    """
    n = lambda s: F.count_if(F.col("source") == s)
    counts = planned.agg(n("hit").alias("cache_hits"), n("reuse").alias("deduplicated"), n("embed").alias("embedded"))
    if made is None:
        return counts.withColumn("requests", F.ceil(F.col("embedded") / F.lit(batch)))
    return counts.crossJoin(F.broadcast(made.agg(F.count_distinct("request").alias("requests"))))


def hashed_embedder(dims: int) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a model: unit vectors from digests."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), dims))
        for i, t in enumerate(texts):
            seed = int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "little")
            v = np.random.default_rng(seed).standard_normal(dims)
            out[i] = v / np.linalg.norm(v)
        return out

    return embed


def embed_misses(planned: DataFrame, embedder: Callable[[list[str]], np.ndarray], batch: int = BATCH, whole: bool = False) -> DataFrame:
    """``cache_key, vector, request`` of the rows to embed, in requests of ``batch`` texts of a partition; a wrong number of vectors is an error.

    ``whole`` rows keep all their columns, so a plan that is also read for all
    of them is dealt out once.
    """
    asks = planned.where("source = 'embed'")
    rows = asks if whole else asks.select("cache_key", "text")
    kept = rows.columns if whole else ["cache_key"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept) + ", vector array<double>, request long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        request = TaskContext.get().partitionId() << 33
        held = None

        def asked(rows: pd.DataFrame) -> pd.DataFrame:
            nonlocal request
            got = embedder(rows["text"].tolist())
            if len(got) != len(rows):
                raise ValueError("embedder returned a wrong number of vectors")
            request += 1
            return rows[kept].assign(vector=[list(map(float, v)) for v in got], request=request)

        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf])
            full = len(held) - len(held) % batch
            for i in range(0, full, batch):
                yield asked(held.iloc[i : i + batch])
            held = held.iloc[full:]
        if held is not None and len(held):
            yield asked(held)

    return rows.mapInPandas(run, schema)


def maybe_shared(keyed: DataFrame, again: DataFrame, bits: int | None = None) -> DataFrame:
    """``keyed(cache_key)`` with ``shared``: false only for keys none of ``again(h)`` is the hash of.

    The hashes' places are a bitmap of ``bits`` bits, ``KEY_BITS`` by default,
    in rows of 4 KB that are broadcast.
    """
    at = lambda h: F.pmod(h, F.lit(bits or KEY_BITS))
    bitmap = again.groupBy(F.bitmap_bucket_number(at(F.col("h"))).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at(F.col("h")))).alias("_bits"))
    own = at(F.xxhash64("cache_key"))
    joined = keyed.withColumn("_own", own).withColumn("_bucket", F.bitmap_bucket_number("_own")).join(F.broadcast(bitmap), "_bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(bitmap_bit_position(_own) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return joined.withColumn("shared", F.coalesce(F.getbit(byte, F.expr("cast(bitmap_bit_position(_own) % 8 as int)")) == 1, F.lit(False))).drop("_own", "_bucket", "_bits")


def with_vectors(planned: DataFrame, cache: DataFrame, legacy: DataFrame | None = None) -> DataFrame:
    """Chunks with their vector from the cache, or from the legacy cache by ``legacy_key``."""
    out = planned.join(cache.select("cache_key", "vector"), "cache_key", "left")
    if legacy is None:
        return out
    old = legacy.select(F.col("cache_key").alias("legacy_key"), F.col("vector").alias("old"))
    return out.join(old, "legacy_key", "left").withColumn("vector", F.coalesce("vector", "old")).drop("old")


def response_in_order(response: Column) -> Column:
    """Vectors of a response ``array<struct<index,embedding>>`` by index; null unless the indices are 0 to n-1."""
    ordered = F.array_sort(response, lambda a, b: (a["index"] - b["index"]).cast("int"))
    whole = F.transform(ordered, lambda x: x["index"].cast("int")) == F.sequence(F.lit(0), F.size(response) - 1)
    return F.when((F.size(response) > 0) & whole, F.transform(ordered, lambda x: x["embedding"]))
