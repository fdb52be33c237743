"""Index build, retrieval and review search end to end."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidra.functions import text as T
from evidra.functions import vectors as V
from evidra.functions.contracts import check_question
from evidra.operators import embedding as E
from evidra.operators import search as S
from evidra.operators.merkle import Sealed, TornError, seal
from evidra.operators.review import eligible
from evidra.sources import sinks
from evidra.sources.folders import folder, removed, short_shuffles, stored

Embedder = Callable[[list[str]], np.ndarray]
READY = "ready_partial"
#: Ranges of terms that are dealt out one after the other.
PASSES = 3


class StaleIndexError(RuntimeError):
    """An index that isn't ready, is changed, or is of another model."""


@dataclass(frozen=True)
class Index:
    """Folder of a published index: ``chunks`` with vectors, sealed postings, and a one-row ``manifest``.

    Postings name a chunk by its number ``ord`` in the published table, which
    is far shorter than its id, and are lists of a term in a block of chunks.

    The digest of the chunks, all of which a dense search reads, is checked
    once, by the first question; that of the postings by each question, for
    the ranges of its own terms.
    """

    spark: SparkSession
    path: str
    chunks: DataFrame = field(init=False)
    manifest: dict = field(init=False)
    seen: list = field(init=False, default_factory=list)

    def __post_init__(self) -> None:
        manifest = self.spark.read.json(f"{self.path}/manifest").first()
        object.__setattr__(self, "manifest", manifest.asDict() if manifest else {})
        if self.manifest.get("status") == READY:
            object.__setattr__(self, "chunks", self.spark.read.parquet(f"{self.path}/chunks"))

    def check(self, model: str, dims: int) -> None:
        """ready, of this model and size, and unchanged since it was published."""
        m = self.manifest
        if m.get("status") != READY or m.get("model") != model or m.get("dims") != dims:
            raise StaleIndexError("the index isn't ready or is of another model")
        if not self.seen and sinks.manifest(self.chunks, ["chunk_id", "text", "vector"]).first().digest != m.get("digest"):
            raise StaleIndexError("the index has changed since it was published")
        self.seen.append(True)

    def postings(self, terms: list[str]) -> DataFrame:
        """Postings of these terms, proven and written to a narrow table, so they are read once."""
        try:
            found = Sealed(self.spark, f"{self.path}/{self.manifest['postings']}", self.manifest["postings_root"]).read(terms)
        except TornError as error:
            raise StaleIndexError("postings have changed since the index was published") from error
        return stored(S.unlisted(found), "terms")


def _write_manifest(spark: SparkSession, path: str, **fields: object) -> None:
    names = ["status", "model", "dims", "chunk_count", "digest", "postings", "postings_root", "avgdl"]
    row = [tuple(fields.get(n) for n in names)]
    spark.createDataFrame(row, "status string, model string, dims int, chunk_count long, digest string, postings string, postings_root string, avgdl double").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def build(chunks: DataFrame, cache: DataFrame, path: str, model: str, dims: int, embedder: Embedder, max_chunks: int = 10_000_000_000) -> dict:
    """Embeds what the cache lacks and publishes chunks with vectors; the manifest goes first to building, last to ready.

    ``chunks(chunk_id, seq, section, char_start, char_end, text)``.  More than
    ``max_chunks`` is an error, never a cut.  On an error the manifest says
    failed, so an old ready one never serves new chunks.

    Disk is kept low.  Only chunks whose key another chunk or the cache may
    have are dealt out by their key; all others are embedded where they are.
    Shuffle files go with their step, and the copy of the postings from which
    the sealed table is made with the build.
    """
    spark = chunks.sparkSession
    _write_manifest(spark, path, status="building", model=model, dims=dims)
    scratch = folder(spark, "build")
    try:
        with short_shuffles(spark):
            return _built(chunks, cache, path, model, dims, embedder, max_chunks, scratch)
    except Exception:
        _write_manifest(spark, path, status="failed", model=model, dims=dims)
        raise
    finally:
        removed(spark, scratch)


def _built(chunks: DataFrame, cache: DataFrame, path: str, model: str, dims: int, embedder: Embedder, max_chunks: int, scratch: str) -> dict:
    spark, packed = chunks.sparkSession, {"compression": "zstd"}
    keyed, seen = chunks.withColumn("cache_key", E.cache_key(model, dims, F.col("text"))), Observation()
    # Hashes of keys: two keys with one hash only take the longer way.
    counts = keyed.groupBy(F.xxhash64("cache_key").alias("h")).count()
    counts.observe(seen, F.sum("count").alias("n")).where("count > 1").select("h").write.parquet(f"{scratch}/again")
    n = seen.get["n"] or 0
    if n > max_chunks:
        raise ValueError(f"{n} chunks exceed the limit of {max_chunks}")
    again = spark.read.schema("h long").parquet(f"{scratch}/again").unionByName(cache.select(F.xxhash64("cache_key").alias("h")))
    marked = E.maybe_shared(keyed, again)
    alone = E.embed_misses(marked.where("not shared").drop("shared").withColumn("source", F.lit("embed")), embedder, whole=True).drop("source", "request")
    planned = E.plan(marked.where("shared").select(*chunks.columns), cache, model, dims)
    known = cache.select("cache_key", "vector").unionByName(E.embed_misses(planned, embedder, whole=True).select("cache_key", "vector"))
    rows = E.with_vectors(planned, known.dropDuplicates(["cache_key"])).drop("source", "legacy_key")
    sinks.publish(alone.unionByName(rows).withColumn("ord", F.monotonically_increasing_id()), f"{path}/chunks", {"vector": V.valid_vector(F.col("vector"), dims)}, **packed)
    written = spark.read.parquet(f"{path}/chunks")
    digest = sinks.manifest(written, ["chunk_id", "text", "vector"]).first()
    name = f"postings-{uuid.uuid4().hex}"
    lists = S.posting_lists(written, "ord", "text", steps=True)
    lists.write.options(**packed).parquet(f"{scratch}/postings")
    posted = spark.read.schema(lists.schema).parquet(f"{scratch}/postings")
    root = seal(posted, f"{path}/{name}", ["term", "first"], passes=PASSES, **packed)
    words = posted.agg(F.coalesce(F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0)).alias("words")).first().words
    state = {"status": READY if n else "no_evidence", "model": model, "dims": dims, "chunk_count": digest["rows"], "digest": digest.digest, "postings": name, "postings_root": root, "avgdl": words / digest["rows"] if digest["rows"] else 0.0}
    _write_manifest(spark, path, **state)
    return state


def retrieve(index: Index, question: str, model: str, dims: int, embedder: Embedder, budget: int = 6000, top_k: int = 6, ratings: DataFrame | None = None, in_scope: Callable[[str], bool] = lambda q: True, cost: Column | None = None) -> DataFrame:
    """One row: ``status, evidence, omitted, used, matched``.

    Dense and sparse lists of 20 are fused; ``ratings(id, rating)`` keeps
    those of 2 or more; the best ``top_k`` and then the chunks beside them
    fill the budget, each whole or not at all.  A question out of scope gives
    an empty bundle before anything is embedded.  ``cost`` defaults to the
    number of word pieces and marks of a chunk.
    """
    check_question(question, budget, top_k)
    spark = index.spark
    empty = "array<struct<position:int,chunk_id:string,section:string,char_start:long,char_end:long,text:string>>"

    def nothing(status: str) -> DataFrame:
        return spark.range(1).select(F.lit(status).alias("status"), F.array().cast(empty).alias("evidence"), F.lit(0).alias("omitted"), F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("matched"))

    if not in_scope(question):
        return nothing("outside_scope")
    index.check(model, dims)
    chunks = index.chunks
    vector = [float(x) for x in embedder([question])[0]]
    query = spark.createDataFrame([(vector,)], "q array<double>")
    dense = S.dense_topk(chunks, "chunk_id", "vector", query).withColumnRenamed("vec_id", "id")
    folded = spark.range(1).select(T.query_terms(T.fold(F.lit(question))).alias("t")).first().t
    scored = S.bm25_index(index.postings(folded), index.manifest["chunk_count"], index.manifest["avgdl"], folded).select(F.col("doc_id").alias("ord"), F.round("score", 6).alias("score"))
    named = scored.join(chunks.select("ord", F.col("chunk_id").alias("id")), "ord").select("id", "score")
    sparse = S.ranked(named, "score", [F.asc("id")], S.DEPTH)
    fused = S.fuse(dense, sparse)
    if ratings is not None:
        fused = S.rerank(fused, ratings).withColumn("rank", F.col("position"))
    # Both are lists of at most three times top_k rows, read more than once below.
    anchors = stored(fused.where(F.col("rank") <= top_k).select(F.col("id").alias("chunk_id"), F.row_number().over(Window.orderBy("rank")).cast("int").alias("rank")), "anchors")
    placed = stored(S.neighbours(chunks, anchors).select("chunk_id", "position"), "placed")
    near = chunks.join(placed, "chunk_id").select("chunk_id", "section", "char_start", "char_end", "text", "position")
    tokens = cost if cost is not None else F.size(F.regexp_extract_all("text", F.lit(r"(?U)(\w+|[^\w\s])"), 1))
    # A result list of at most three times top_k chunks.
    items = near.withColumn("g", F.lit(1)).withColumn("i", F.col("position").cast("long")).withColumn("c", tokens.cast("long"))
    kept = S.budget_skip(items, ["g"], "position", "i", "c", budget - 150)
    rows = near.groupBy().agg(F.array_sort(F.collect_list(F.struct("position", "chunk_id", "section", "char_start", "char_end", "text"))).alias("r"))
    bundle = rows.crossJoin(kept).select(F.lit("evidence").alias("status"), F.filter("r", lambda x: F.array_contains("kept", x["position"].cast("long"))).alias("evidence"), "omitted", "used", F.size("r").cast("long").alias("matched"))
    return bundle if anchors.limit(1).count() else nothing("no_relevant_evidence")


def review_search(evidence: DataFrame, docs: DataFrame, question: str, as_of: str, collection: str, k: int = 6, budget: int = 24_000) -> DataFrame:
    """``doc_id, chunk_id, score, rank`` of the best passages that are in effect, within a budget of characters.

    Statistics are those of all evidence; documents are filtered before the
    limit, and the list ends at the first passage over the budget.
    """
    if not 1 <= k <= 20:
        raise ValueError("between 1 and 20 results")
    spark = docs.sparkSession
    terms = spark.range(1).select(T.query_terms(T.fold(F.lit(question)), 24, distinct=True).alias("t")).first().t
    now = eligible(docs, F.lit(as_of).cast("date"), collection).select("doc_id")
    scored = S.bm25(evidence, "chunk_id", "text", terms).withColumnRenamed("doc_id", "chunk_id")
    own = evidence.select("chunk_id", "doc_id", F.length("text").alias("n")).join(now, "doc_id", "left_semi")
    best = S.ranked(scored.join(own, "chunk_id").withColumn("score", F.round("score", 6)), "score", [F.asc("chunk_id")], k)
    return S.budget_prefix(best.withColumn("g", F.lit(1)), ["g"], [F.asc("rank")], "n", budget).select("doc_id", "chunk_id", "score", "rank")


def pilot(rows: DataFrame, twin: DataFrame, benchmark: DataFrame, start: int, end: int) -> DataFrame:
    """``series_id, status, reason`` of a two-format import: accepted only if gate, twin, benchmark and control all agree."""
    from evidra.operators import series as D

    gate = D.first_errors(D.check_series(rows, start, end, "population")).select("series_id", F.col("code").alias("gate"))
    year = lambda d: d.select("series_id", F.col("date").try_cast("int").alias("year"), "value")
    flag = lambda d, name: d.select("series_id").distinct().withColumn(name, F.lit(True))
    twins = flag(D.cross_check(year(rows), year(twin), ["series_id", "year"], "value"), "twin")
    pinned = benchmark.select("series_id").distinct()
    revised = flag(D.cross_check(year(rows).join(pinned, "series_id", "left_semi"), benchmark.select("series_id", "year", "value"), ["series_id", "year"], "value"), "revised")
    control = flag(D.negative_control(rows, start, end, "population").where(~F.col("rejected")), "uncontrolled")
    out = rows.select("series_id").distinct()
    for part in (gate, twins, revised, control):
        out = out.join(part, "series_id", "left")
    reason = F.coalesce("gate", F.when(F.col("twin"), "CROSSCHECK_MISMATCH"), F.when(F.col("revised"), "SOURCE_REVISION"), F.when(F.col("uncontrolled"), "CONTROL_PASSED"))
    return out.select("series_id", F.when(reason.isNull(), "accepted").otherwise("quarantined").alias("status"), reason.alias("reason"))
