"""Document, response and end-to-end queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import contracts as J
from evidra.operators import chunks as C
from evidra.operators import documents as D
from evidra.operators import embedding as E
from evidra.operators import responses as R
from evidra.operators import retrieval as X
from evidra.plans.registry import query, sql_words
from evidra.plans.search_plans import LIFECYCLE, lifecycle
from evidra.session import table, texts
from evidra.sources.folders import folder


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
p AS (SELECT doc_id, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM l),
s AS (SELECT doc_id, pos + o AS start, substr(line, o + 1, 1500) AS text FROM (SELECT doc_id, pos, line, unnest(range(0, length(line), 1500)) AS o FROM p WHERE line <> ''))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS id, CAST(start AS INTEGER) AS start, CAST(start + length(text) AS INTEGER) AS "end", sha256(text) AS digest FROM s WHERE regexp_matches(text, '\\S')"""
)
def check_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text is one window."""
    s = D.segments(texts(spark, sf_dir).select("doc_id", F.lit(0).alias("start"), "text"))
    return s.select("doc_id", "id", "start", "end", F.sha2("text", 256).alias("digest"))


@query(
    """WITH i AS (SELECT doc_id // 40 AS doc_id, CASE WHEN doc_id % 9 <> 0 THEN doc_id % 4 END AS page, doc_id AS seq, text FROM documents WHERE trim(text) <> '')
SELECT doc_id, coalesce(page, -1) AS page, sha256(string_agg(text, chr(10) || chr(10) ORDER BY seq)) AS digest, CAST(sum(length(text) + 2) - max_by(length(text) + 2, seq) AS INTEGER) AS last_start FROM i GROUP BY doc_id, page"""
)
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty documents stand for the items of a paper's pages; some have no page."""
    i = F.col("doc_id")
    items = texts(spark, sf_dir).select(F.floor(i / 40).alias("doc_id"), F.when(i % 9 != 0, i % 4).alias("page"), i.alias("seq"), i.cast("string").alias("ref"), F.lit("text").alias("label"), "text")
    r = D.reading_order(items)
    return r.select("doc_id", F.coalesce("page", F.lit(-1)).alias("page"), F.sha2("text", 256).alias("digest"), F.element_at("items", -1)["char_start"].alias("last_start"))


@query(
    """SELECT doc_id, CASE WHEN regexp_matches(rest, '\\S') AND (doc_id % 3 > 0 OR NOT regexp_matches(head, '\\S')) OR doc_id % 3 > 0 AND regexp_matches(head, '\\S') THEN 'aligned' ELSE 'error' END AS state,
CASE WHEN state = 'error' THEN 0 WHEN doc_id % 3 = 0 THEN length(rest) ELSE length(head) + length(rest) END AS n_chars
FROM (SELECT doc_id, coalesce(substr(text, 1, length(text) // 2), '') AS head, coalesce(substr(text, length(text) // 2 + 1), '') AS rest FROM documents)"""
)
def segment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves cover each text; of each third text the first half is left out, an error unless that is blank."""
    d = texts(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    head, rest = F.expr("substring(text, 1, cast(floor(length(text) / 2) as int))"), F.expr("substring(text, cast(floor(length(text) / 2) as int) + 1)")
    parts = F.when(F.col("doc_id") % 3 == 0, F.array(rest)).otherwise(F.array(head, rest))
    a = d.select("doc_id", D.aligned("text", parts, F.lit(400)).alias("a"))
    size = F.aggregate("a.chunks", F.lit(0), lambda s, c: s + F.length(c["text"]))
    return a.select("doc_id", F.when(F.col("a.error").isNull(), "aligned").otherwise("error").alias("state"), F.coalesce(size, F.lit(0)).cast("long").alias("n_chars"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '$.k: string' WHEN event_id % 4 = 1 THEN '$: keys' WHEN event_id % 4 = 2 THEN '$: not JSON' ELSE '' END AS errors, CASE WHEN event_id % 4 = 2 THEN 'none' WHEN event_id % 4 = 0 THEN '\"x\"' ELSE CAST(json_extract(props, '$.k') AS VARCHAR) END AS at FROM events")
def json_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    body = F.when(k == 0, '{"k": "x"}').when(k == 1, F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "more": 1}'))).when(k == 2, "{torn").otherwise(F.col("props"))
    e = table(spark, sf_dir, "events").select("event_id", body.alias("b"))
    errors = J.validated(F.col("b"), {"type": "object", "properties": {"k": {"type": ["integer", "null"]}}})
    return e.select("event_id", F.array_join(errors, ",").alias("errors"), F.coalesce(J.pointer("b", F.lit("#/k")), F.lit("none")).alias("at"))


@query("SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'invalid_key' WHEN 1 THEN 'invalid_key' WHEN 2 THEN 'quota_exceeded' WHEN 3 THEN 'rate_limited' WHEN 4 THEN 'unsupported' WHEN 5 THEN 'ok' ELSE 'request_failed' END AS status FROM events")
def provider_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 7
    code = F.when(k == 0, 401).when(k == 3, 429).when(k == 4, 404).when(k == 5, 200).otherwise(400)
    body = F.when(k == 1, '{"error": {"details": [{"reason": "API_KEY_INVALID"}]}}').when(k == 2, '{"error": {"code": "insufficient_quota"}}').when(k == 5, '{"data": []}').otherwise("{}")
    return table(spark, sf_dir, "events").select("event_id", R.probe_status(code, body).alias("status"))


@query(
    """SELECT page_id AS id, CAST(p AS INTEGER) AS place, CASE p WHEN 0 THEN 'https://a.example/' || CAST(page_id AS VARCHAR) ELSE 'https://b.example' END AS url, CASE p WHEN 0 THEN 'A' ELSE 'https://b.example' END AS title FROM pages, (VALUES (0), (1)) t(p) WHERE page_id % 3 = 0"""
)
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated citations count once; incomplete responses, and those without a search call, give none."""
    i, k = F.col("page_id").cast("string"), F.col("page_id") % 3
    status = F.when(k == 1, "incomplete").otherwise("completed")
    call = F.when(k == 2, "message").otherwise("web_search_call")
    note = F.concat(F.lit('{"url":"https://a.example/'), i, F.lit('","title":"A"}'))
    body = F.concat(F.lit('{"status":"'), status, F.lit('","output":[{"type":"'), call, F.lit('","status":"completed"},{"type":"message","content":[{"type":"output_text","text":"see https://c.example","annotations":['), note, F.lit(","), note, F.lit(',{"url_citation":{"url":"https://b.example"}}]}]}]}'))
    return R.citations(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), body.alias("body")))


def _index_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.chunk(texts(spark, sf_dir), 400)
    return c.select("chunk_id", (F.col("doc_id") * 100_000 + F.col("ordinal")).alias("seq"), F.col("doc_id").cast("string").alias("section"), "char_start", "char_end", "text")


@query()
def retrieve_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, vectors, index, retrieval and budget end to end; the stand-in embedder has no SQL."""
    path = folder(spark, "index")
    cache = spark.createDataFrame([], "cache_key string, vector array<double>")
    embed = E.hashed_embedder(16)
    X.build(_index_chunks(spark, sf_dir), cache, path, "stub", 16, embed)
    got = X.retrieve(X.Index(spark, path), "What does thea say of ontion and leaux?", "stub", 16, embed)
    return got.select("status", "omitted", "used", "matched", F.size("evidence").alias("n_evidence"))


_SEARCH = f"""life AS ({LIFECYCLE}), w AS (SELECT doc_id, {sql_words('text')} AS w, length(text) AS n FROM documents), stats AS (SELECT count(*) AS n_docs, avg(len(w)) AS avgdl FROM w),
tf AS (SELECT doc_id, n, len(w) AS dl, term, len(list_filter(w, lambda x: x = term)) AS tf FROM w, (VALUES ('thea'), ('der')) q(term)), df AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY term),
s AS (SELECT doc_id, any_value(n) AS n, round(sum(greatest(CASE WHEN (n_docs - df + 0.5) / (df + 0.5) > 1 THEN ln((n_docs - df + 0.5) / (df + 0.5)) ELSE 1e-6 END, 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN df USING (term), stats WHERE tf > 0 GROUP BY doc_id),
r AS (SELECT s.*, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s JOIN life USING (doc_id) WHERE status = 'approved' AND collection = 'de' AND effective_from <= DATE '2026-02-10' AND (effective_to IS NULL OR DATE '2026-02-10' < effective_to) QUALIFY rank <= 10)"""


@query(f"WITH {_SEARCH} SELECT doc_id, score, rank FROM (SELECT *, sum(n) OVER (ORDER BY rank) AS run FROM r) WHERE run <= 24000")
def review_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    evidence = docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", "text")
    return X.review_search(evidence, lifecycle(docs), "thea, der! THEA", "2026-02-10", "de", k=10).select("doc_id", "score", "rank")


@query("SELECT o_orderpriority AS series_id, CASE WHEN o_orderpriority LIKE '1%' THEN 'accepted' ELSE 'quarantined' END AS status, CASE left(o_orderpriority, 1) WHEN '2' THEN 'CROSSCHECK_MISMATCH' WHEN '3' THEN 'SOURCE_REVISION' WHEN '4' THEN 'INVALID_VALUE' WHEN '5' THEN 'MISSING_YEARS' ELSE 'none' END AS reason FROM orders GROUP BY 1, 2, 3")
def pilot_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), F.year("o_orderdate").alias("year")).agg(F.count("*").cast("double").alias("value"))
    starts = lambda s: F.startswith(F.col("series_id"), F.lit(s))
    first = F.col("year") == 1996
    true = o.where(~(starts("5") & first)).withColumn("value", F.when(starts("4") & first, F.col("value") + 0.5).otherwise(F.col("value")))
    fixed = {c: F.lit(v) for c, v in (("country", "VN"), ("iso3", "VNM"), ("indicator", "I"), ("expected_country", "VN"), ("expected_iso3", "VNM"), ("expected_indicator", "I"))}
    rows = true.withColumns(fixed | {"date": F.col("year").cast("string"), "position": (F.col("year") - 1990).cast("int")})
    twin = rows.withColumn("value", F.when(starts("2") & first, F.col("value") + 1).otherwise(F.col("value")))
    pinned = o.withColumn("value", F.when(starts("3") & first, F.col("value") + 1).otherwise(F.col("value")))
    return X.pilot(rows, twin, pinned, 1995, 2001).select("series_id", "status", F.coalesce("reason", F.lit("none")).alias("reason"))


@query("SELECT c AS \"check\", CASE c WHEN 'one_to_one' THEN (SELECT count(*) FROM documents WHERE doc_id % 100 = 0) WHEN 'text_equal' THEN (SELECT count(*) FROM documents WHERE doc_id % 100 = 1) WHEN 'document' THEN 0 ELSE 0 END AS failed FROM (VALUES ('one_to_one'), ('text_equal'), ('unique'), ('document')) t(c)")
def audit_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", "text")
    index = chunks.where("chunk_id % 100 <> 0").withColumn("text", F.when(F.col("chunk_id") % 100 == 1, "other").otherwise(F.col("text")))
    return D.audit_index(chunks, index, docs)
