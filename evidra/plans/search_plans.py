"""Retrieval, chunking and embedding queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import text as T
from evidra.functions import vectors as V
from evidra.operators import chunks as C
from evidra.operators import embedding as E
from evidra.operators import search as S
from evidra.operators.merkle import Sealed, TornError, seal
from evidra.operators.review import eligible
from evidra.operators.segments import SegmentedIndex
from evidra.plans.registry import query, sql_words
from evidra.session import table, texts
from evidra.sources.folders import folder, stored

#: One term twice: it counts twice.
TERMS = ["thea", "ontion", "der", "thea", "leaux"]
LIMIT = 400


def _bm25(source: str, terms: list[str] = TERMS) -> str:
    weights = ", ".join(f"('{t}', {terms.count(t)})" for t in sorted(set(terms)))
    return f"""
  w AS MATERIALIZED (SELECT doc_id, coalesce({sql_words("text")}, []) AS w FROM {source}),
  stats AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w),
  q(term, weight) AS (VALUES {weights}),
  tf AS (SELECT doc_id, len(w) AS dl, term, weight, len(list_filter(w, lambda x: x = term)) AS tf FROM w, q),
  df AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY term),
  scored AS (
    SELECT doc_id, round(sum(weight * greatest(CASE WHEN (n - df + 0.5) / (df + 0.5) > 1 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END, 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
    FROM tf JOIN df USING (term), stats WHERE tf > 0 GROUP BY doc_id
  )"""


@query(f"WITH {_bm25('documents')} SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored ORDER BY score DESC, doc_id LIMIT 20")
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.lexical_topk(texts(spark, sf_dir), "doc_id", "text", TERMS)


def lifecycle(docs: DataFrame) -> DataFrame:
    """Documents with a review state that is a function of their columns."""
    start = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("doc_id") % 60).cast("int"))
    status = F.when(F.col("doc_id") % 4 == 1, "pending").when(F.col("doc_id") % 4 == 2, F.when(F.col("doc_id") % 8 == 2, "withdrawn").otherwise("approved")).otherwise("approved")
    return docs.withColumns({"status": status, "collection": F.col("lang"), "effective_from": start, "effective_to": F.when(F.col("doc_id") % 3 != 0, F.date_add(start, 30))})


LIFECYCLE = """SELECT *, lang AS collection,
  CASE WHEN doc_id % 4 = 1 THEN 'pending' WHEN doc_id % 8 = 2 THEN 'withdrawn' ELSE 'approved' END AS status,
  DATE '2026-01-01' + CAST(doc_id % 60 AS INTEGER) AS effective_from,
  CASE WHEN doc_id % 3 <> 0 THEN DATE '2026-01-01' + CAST(doc_id % 60 + 30 AS INTEGER) END AS effective_to FROM documents"""


@query(
    f"""WITH life AS ({LIFECYCLE}), approved AS (SELECT * FROM life WHERE status = 'approved'), {_bm25('approved')}
SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored
WHERE doc_id IN (SELECT doc_id FROM approved WHERE collection = 'en' AND effective_from <= DATE '2026-02-10' AND (effective_to IS NULL OR DATE '2026-02-10' < effective_to))
ORDER BY score DESC, doc_id LIMIT 6"""
)
def lexical_scoped_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics over all approved evidence, filters before the limit."""
    docs = lifecycle(texts(spark, sf_dir))
    approved = docs.where("status = 'approved'")
    now = eligible(approved, F.lit("2026-02-10").cast("date"), "en").select("doc_id")
    scored = S.bm25(approved, "doc_id", "text", TERMS).withColumn("score", F.round("score", 6)).join(now, "doc_id", "left_semi")
    return S.ranked(scored, "score", [F.asc("doc_id")], 6)


_COSINE = "list_sum(list_transform(list_zip(embedding, q), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(q, lambda x: CAST(x AS DOUBLE) * x))))"
_DENSE = f"SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id DESC) AS INTEGER) AS rank FROM (SELECT vec_id, round({_COSINE}, 6) AS score FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)) ORDER BY score DESC, vec_id DESC LIMIT 20"


def _query_vector(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id = 0").select(F.col("embedding").alias("q"))


@query(_DENSE)
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return S.dense_topk(vectors, "vec_id", "embedding", _query_vector(vectors))


_AFTER = """final AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || ' amended thea' ELSE text END AS text FROM documents
  WHERE doc_id % 7 = 0 OR (doc_id % 11 <> 0 AND (doc_id % 3 = 0 OR doc_id % 5 <> 0)))"""


@query(f"WITH {_AFTER}, {_bm25('final')} SELECT doc_id, score FROM scored")
def evidence_index_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents go through an index by three batches of approvals, withdrawals and edits, two at a time merged; every match is returned."""
    docs, i = texts(spark, sf_dir).select("doc_id", "text"), F.col("doc_id")
    index = SegmentedIndex(spark, folder(spark, "evidence"), fan=2)
    index.apply(docs.where(i % 3 != 0))
    index.apply(docs.where(i % 3 == 0), docs.where(i % 5 == 0))
    index.compact()
    index.apply(docs.where(i % 7 == 0).withColumn("text", F.concat("text", F.lit(" amended thea"))), docs.where(i % 11 == 0))
    return index.scores(TERMS).withColumn("score", F.round("score", 6))


@query(
    """SELECT vec_id, CASE WHEN vec_id % 7 IN (0, 1, 2) THEN false ELSE len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) > 0 END AS valid FROM embeddings"""
)
def vector_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some vectors are made too short, zero, or not a number, and must be told."""
    e = F.col("embedding")
    spoilt = F.when(F.col("vec_id") % 7 == 0, F.slice(e, 1, 63)).when(F.col("vec_id") % 7 == 1, F.transform(e, lambda x: F.lit(0.0).cast("float"))).when(F.col("vec_id") % 7 == 2, F.concat(F.slice(e, 1, 63), F.array(F.lit(float("nan")).cast("float")))).otherwise(e)
    return table(spark, sf_dir, "embeddings").select("vec_id", V.valid_vector(spoilt, 64).alias("valid"))


_FUSED = f"""d AS ({_DENSE}), s AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored ORDER BY score DESC, doc_id LIMIT 20),
  both_ AS (SELECT coalesce(vec_id, doc_id) AS id, d.rank AS dense_rank, s.rank AS sparse_rank, round(coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + s.rank), 0), 9) AS fused FROM d FULL JOIN s ON vec_id = doc_id),
  f AS (SELECT *, CAST(row_number() OVER (ORDER BY fused DESC, dense_rank NULLS LAST, sparse_rank) AS INTEGER) AS rank FROM both_ QUALIFY rank <= 20)"""


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = dense_topk(spark, sf_dir).withColumnRenamed("vec_id", "id")
    sparse = lexical_topk(spark, sf_dir).withColumnRenamed("doc_id", "id")
    return S.fuse(dense, sparse)


@query(f"WITH {_bm25('documents')}, {_FUSED} SELECT id, coalesce(dense_rank, 0) AS dense_rank, coalesce(sparse_rank, 0) AS sparse_rank, fused, rank FROM f")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).na.fill(0, ["dense_rank", "sparse_rank"])


@query(f"""WITH {_bm25('documents')}, {_FUSED} SELECT id, rating, fused, rank, CAST(row_number() OVER (ORDER BY rating DESC, fused DESC, rank) AS INTEGER) AS position
FROM f JOIN (SELECT doc_id, CAST(doc_id % 4 AS INTEGER) AS rating FROM documents) ON doc_id = id WHERE rating >= 2""")
def rerank_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings = texts(spark, sf_dir).select(F.col("doc_id").alias("id"), (F.col("doc_id") % 4).cast("int").alias("rating"))
    return S.rerank(_fused(spark, sf_dir), ratings).select("id", "rating", "fused", "rank", "position")


_CHUNKS = f"""cut(doc_id, text, ordinal, char_start, char_end) AS (
  SELECT doc_id, text, -1, 0, 0 FROM documents WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, text, ordinal + 1, char_end, CASE
    WHEN char_end + {LIMIT} >= length(text) THEN length(text)
    WHEN strpos(reverse(substr(text, char_end + 1, {LIMIT})), chr(10)) > 0 AND {LIMIT} - strpos(reverse(substr(text, char_end + 1, {LIMIT})), chr(10)) > {LIMIT // 2}
      THEN char_end + {LIMIT} - strpos(reverse(substr(text, char_end + 1, {LIMIT})), chr(10)) + 1
    ELSE char_end + {LIMIT} END
  FROM cut WHERE char_end < length(text)
), chunks AS (
  SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, CAST(char_start AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end, substr(text, char_start + 1, char_end - char_start) AS part,
    'c' || substr(sha256(concat_ws('|', CAST(doc_id AS VARCHAR), CAST(char_start AS VARCHAR), substr(text, char_start + 1, char_end - char_start))), 1, 24) AS chunk_id
  FROM cut WHERE ordinal >= 0
)"""


def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk(texts(spark, sf_dir), LIMIT)


@query(f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, ordinal, char_start, char_end, chunk_id FROM chunks")
def chunk_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunked(spark, sf_dir).select("doc_id", "ordinal", "char_start", "char_end", "chunk_id")


@query("SELECT true AS covered, count(*) AS n_docs FROM documents WHERE length(text) > 0")
def span_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's chunks cover it exactly."""
    return C.coverage(_chunked(spark, sf_dir), texts(spark, sf_dir)).groupBy("covered").agg(F.count("*").alias("n_docs"))


@query(
    f"""WITH RECURSIVE {_CHUNKS}, n AS (SELECT count(*) AS n FROM chunks), u AS (SELECT count(DISTINCT chunk_id) AS u FROM chunks)
SELECT c AS "check", CASE WHEN c = 'unique_id' THEN u ELSE n END AS checked, 0 AS failed FROM n, u, (VALUES ('document_found'), ('span_equal'), ('within_limit'), ('id_recomputed'), ('unique_id')) t(c)"""
)
def audit_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.audit(_chunked(spark, sf_dir), texts(spark, sf_dir), LIMIT)


@query(
    f"""WITH RECURSIVE {_CHUNKS}, anchors AS (SELECT chunk_id, CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER) AS rank FROM chunks WHERE ordinal = 1 ORDER BY doc_id LIMIT 6),
a AS (SELECT chunks.*, rank FROM chunks JOIN anchors USING (chunk_id)),
near AS (SELECT c.chunk_id, c.doc_id, c.char_start, c.char_end, min(a.rank) AS anchor_rank FROM chunks c JOIN a ON c.doc_id = a.doc_id AND (c.char_start = a.char_end OR c.char_end = a.char_start) WHERE c.chunk_id NOT IN (SELECT chunk_id FROM anchors) GROUP BY ALL),
every AS (SELECT chunk_id, doc_id AS section, char_start, char_end, rank AS anchor_rank, 0 AS is_neighbour FROM a UNION ALL SELECT chunk_id, doc_id, char_start, char_end, anchor_rank, 1 FROM near)
SELECT *, CAST(row_number() OVER (ORDER BY is_neighbour, anchor_rank, section, char_start) AS INTEGER) AS position FROM every"""
)
def neighbour_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _chunked(spark, sf_dir)
    chunks = cut.select("chunk_id", F.col("doc_id").alias("section"), "char_start", "char_end")
    anchors = S.ranked(cut.where("ordinal = 1").select("chunk_id", "doc_id", F.lit(0).alias("s")), "s", [F.asc("doc_id")], 6)
    return S.neighbours(chunks, anchors.select("chunk_id", "rank"))


@query(
    """WITH RECURSIVE r AS (SELECT doc_id // 50 AS list, doc_id, n_chars, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) AS k FROM documents),
fold(list, k, used, kept, omitted) AS (
  SELECT DISTINCT list, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS BIGINT[]), 0 FROM r
  UNION ALL
  SELECT f.list, f.k + 1, CASE WHEN used + n_chars <= 9980 THEN used + n_chars ELSE used END, CASE WHEN used + n_chars <= 9980 THEN list_append(kept, doc_id) ELSE kept END, omitted + CASE WHEN used + n_chars <= 9980 THEN 0 ELSE 1 END
  FROM fold f JOIN r ON r.list = f.list AND r.k = f.k + 1
)
SELECT list, used, array_to_string(kept, ',') AS kept, omitted FROM fold QUALIFY k = max(k) OVER (PARTITION BY list)"""
)
def context_budget_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents are a question's result list."""
    items = texts(spark, sf_dir).select(F.floor(F.col("doc_id") / 50).alias("list"), "doc_id", "n_chars")
    kept = S.budget_skip(items, ["list"], "doc_id", "doc_id", "n_chars", 10_000)
    return kept.select("list", "used", F.array_join(F.transform("kept", lambda x: x.cast("string")), ",").alias("kept"), "omitted")


@query("SELECT list, doc_id, CAST(running AS BIGINT) AS running FROM (SELECT doc_id // 50 AS list, doc_id, sum(n_chars) OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) AS running FROM documents) WHERE running <= 24000")
def context_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = texts(spark, sf_dir).select(F.floor(F.col("doc_id") / 50).alias("list"), "doc_id", "n_chars")
    return S.budget_prefix(items, ["list"], [F.asc("doc_id")], "n_chars", 24_000).select("list", "doc_id", F.col("running").cast("long").alias("running"))


_PLANNED = """k AS (SELECT doc_id, doc_id AS seq, sha256('stub|8|' || text) AS cache_key FROM documents),
p AS (SELECT doc_id, cache_key, CASE WHEN cache_key IN (SELECT cache_key FROM k WHERE doc_id % 5 = 0) THEN 'hit' WHEN row_number() OVER (PARTITION BY cache_key ORDER BY seq, doc_id) = 1 THEN 'embed' ELSE 'reuse' END AS source FROM k)"""


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = texts(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("seq"), "text")
    cache = chunks.where("chunk_id % 5 = 0").select(E.cache_key("stub", 8, F.col("text")).alias("cache_key"))
    return E.plan(chunks, cache, "stub", 8)


@query(f"WITH {_PLANNED} SELECT doc_id AS chunk_id, cache_key, source FROM p")
def embedding_cache_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir).select("chunk_id", "cache_key", "source")


@query(
    f"""WITH {_PLANNED} SELECT count(*) FILTER (WHERE source = 'hit') AS cache_hits, count(*) FILTER (WHERE source = 'reuse') AS deduplicated, count(*) FILTER (WHERE source = 'embed') AS embedded,
CAST(ceil(count(*) FILTER (WHERE source = 'embed') / 16.0) AS BIGINT) AS requests FROM p"""
)
def embedding_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.receipts(_planned(spark, sf_dir))


@query(f"WITH {_PLANNED} SELECT cache_key, CAST(8 AS INTEGER) AS dims, true AS valid FROM p WHERE source = 'embed'")
def embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the texts to embed, one for each key that the cache lacks; a stand-in embedder."""
    return E.embed_misses(_planned(spark, sf_dir), E.hashed_embedder(8)).select("cache_key", F.size("vector").alias("dims"), V.valid_vector(F.col("vector"), 8).alias("valid"))


@query(f"WITH w AS (SELECT doc_id, unnest({sql_words('text')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM w GROUP BY term")
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings folded to document and collection frequencies (A10)."""
    return S.postings(texts(spark, sf_dir), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"SELECT doc_id, sha256({sql_words('text')}[1]) AS first_word FROM documents WHERE len({sql_words('text')}) > 0")
def first_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir).select("doc_id", T.words(T.fold(F.col("text"))).alias("w"))
    return d.where(F.size("w") > 0).select("doc_id", F.sha2(F.col("w")[0], 256).alias("first_word"))


@query(
    f"""WITH w AS (SELECT doc_id, unnest({sql_words('text')}) AS term FROM documents), t AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM w GROUP BY term),
n AS (SELECT *, row_number() OVER (ORDER BY term) AS up, row_number() OVER (ORDER BY term DESC) AS down FROM t)
SELECT term, CASE WHEN down = 1 THEN 'torn' ELSE 'intact' END AS state, CASE WHEN down = 1 THEN 0 ELSE df END AS df, CASE WHEN down = 1 THEN 0 ELSE tf END AS tf FROM n WHERE up <= 50 OR down = 1"""
)
def verified_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed postings of all texts: after one leaf was damaged, its terms are refused and others are still read."""
    path = folder(spark, "sealed")
    posted = stored(S.posting_lists(texts(spark, sf_dir), "doc_id", "text"), "postings")
    root = seal(posted, path, ["term", "first"], leaves=64, fan=8)
    terms = posted.select("term").distinct()
    # Report: the first 50 terms, and the last one, whose leaf is damaged.
    first, last = [r.term for r in terms.orderBy("term").limit(50).collect()], posted.agg(F.max("term")).first()[0]
    leaf = f"{path}/rows/leaf={max(Sealed(spark, path, root).proven_leaves([last]))}"
    spark.read.parquet(leaf).limit(1).write.mode("append").parquet(leaf)
    table = Sealed(spark, path, root)
    counts = F.sum(F.size("doc_ids")).alias("df"), F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda s, n: s + n)).alias("tf")
    read = table.read(first).groupBy("term").agg(*counts).select("term", F.lit("intact").alias("state"), "df", "tf")
    try:
        table.read([last])
        state = "intact"
    except TornError:
        state = "torn"
    return read.unionByName(spark.range(1).select(F.lit(last).alias("term"), F.lit(state).alias("state"), F.lit(0).cast("long").alias("df"), F.lit(0).cast("long").alias("tf")))
