"""Queries of runs, versions, traces, strict gates and parser contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import contracts as J
from evidra.functions import markup as M
from evidra.functions import text as T
from evidra.operators import chunks as C
from evidra.operators import lineage as L
from evidra.operators import review as V
from evidra.operators import runs as U
from evidra.operators import series as S
from evidra.plans.registry import query, sql_fold
from evidra.plans.series_plans import _ROWS, END, START, _rows
from evidra.session import table
from evidra.sources import readers as R


@query(
    f"""WITH {_ROWS}, n AS (SELECT *, row_number() OVER (PARTITION BY series_id, date ORDER BY position) > 1 AS again FROM r),
j AS (SELECT *, CASE WHEN country <> 'VN' THEN 'WRONG_COUNTRY' WHEN date NOT BETWEEN {START} AND {END} OR again THEN 'YEAR_OUT_OF_SCOPE_OR_REPEATED' WHEN value < 0 THEN 'INVALID_VALUE' WHEN value <> floor(value) THEN 'NOT_INTEGER' END AS code FROM n),
o AS (SELECT series_id, CASE WHEN series_id LIKE '5%' THEN 'WRONG_SOURCE' ELSE coalesce(min_by(code, position) FILTER (WHERE code IS NOT NULL), CASE WHEN count(DISTINCT date) < {END - START + 1} THEN 'MISSING_YEARS' END) END AS code,
  CASE WHEN series_id NOT LIKE '5%' THEN min(position) FILTER (WHERE code IS NOT NULL) END AS p FROM j GROUP BY series_id)
SELECT series_id, code, CAST(coalesce(p, -1) AS INTEGER) AS position FROM o WHERE code IS NOT NULL"""
)
def pilot_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.startswith("series_id", F.lit("5")), "3").otherwise("2")
    rows = _rows(spark, sf_dir).withColumns({"sourceid": source, "lastupdated": F.lit("2026-07-13")})
    return S.pilot_gate(rows, START, END).select("series_id", "code", F.coalesce("position", F.lit(-1)).alias("position"))


@query(
    f"""WITH {_ROWS}, clean AS (SELECT * FROM r WHERE substr(series_id, 1, 1) = '5')
SELECT series_id, CAST(date AS INTEGER) AS year, value, 'https://api.example.org/' || series_id AS source_url, sha256(series_id) AS raw_sha256 FROM clean"""
)
def verified_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the series without a failure in either format comes through, told where it is from."""
    rows = _rows(spark, sf_dir)
    source = rows.select("series_id").distinct().select("series_id", F.concat(F.lit("https://api.example.org/"), "series_id").alias("source_url"), F.lit("raw.json").alias("raw_path"), F.sha2("series_id", 256).alias("raw_sha256"), F.lit("2026").alias("dataset_version"))
    found, _ = S.import_series(rows, rows, source, START, END, "population")
    return found.select("series_id", "year", "value", "source_url", "raw_sha256")


@query(
    """WITH c AS (SELECT CASE WHEN page_id % 10 = 0 THEN 'https://data.worldbank.org/p/' || CAST(page_id AS VARCHAR) ELSE 'https://other.example/' || CAST(page_id AS VARCHAR) END AS url, 'q' || CAST(page_id % 3 AS VARCHAR) AS q, page_id FROM pages)
SELECT url, q AS queries, CAST(3 AS INTEGER) AS relevance, false AS catalog_verified FROM c
UNION ALL SELECT 'https://data.worldbank.org/indicator/N.3?locations=VN', (SELECT string_agg(DISTINCT q, ',' ORDER BY q) FROM c WHERE page_id % 10 = 0), 20, true"""
)
def catalogue_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations stand for the metrics of a catalogue, of which one has the topic's name."""
    i = F.col("page_id")
    url = F.when(i % 10 == 0, F.concat(F.lit("https://data.worldbank.org/p/"), i.cast("string"))).otherwise(F.concat(F.lit("https://other.example/"), i.cast("string")))
    found = table(spark, sf_dir, "pages").select(url.alias("url"), F.lit("t").alias("title"), F.array(F.concat(F.lit("q"), (i % 3).cast("string"))).alias("search_queries"), F.lit(3).alias("relevance"), F.lit(0).alias("priority"), F.lit(False).alias("catalog_verified"))
    k = F.col("n_nationkey")
    metrics = table(spark, sf_dir, "nation").select(F.concat(F.lit("N."), k.cast("string")).alias("id"), F.when(k == 3, "Population, Total").otherwise(F.col("n_name")).alias("name"), F.lit("2").alias("source_id"))
    out = S.expand_catalog(found, metrics, "population", "VN")
    return out.select("url", F.array_join("search_queries", ",").alias("queries"), "relevance", "catalog_verified")


def _provenance(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents, and the graph from the scope over crawls and documents to chunks."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", i.cast("string").alias("i"), F.concat(F.lit("crawl-"), "source").alias("crawl"), F.sha2("text", 256).alias("sha256"), "text")
    none, path, string = F.array().cast("array<string>"), F.lit(None).cast("string"), F.lit(None).cast("string")
    scope = spark.range(1).select(F.lit("scope").alias("id"), none.alias("parents"), path.alias("path"), string.alias("sha256"))
    crawls = d.select(F.col("crawl").alias("id"), F.array(F.lit("scope")).alias("parents"), path.alias("path"), string.alias("sha256")).distinct()
    recorded = F.when(i % 7 == 0, "old").otherwise(F.col("sha256"))
    docs = d.select(F.concat(F.lit("doc-"), "i").alias("id"), F.when(i % 3 == 0, F.array(F.lit("scope"), "crawl")).otherwise(F.array("crawl")).alias("parents"), F.col("i").alias("path"), recorded.alias("sha256"))
    chunks = d.select(F.concat(F.lit("chunk-"), "i").alias("id"), F.array(F.concat(F.lit("doc-"), "i")).alias("parents"), path.alias("path"), string.alias("sha256"))
    nodes = scope.unionByName(crawls).unionByName(docs).unionByName(chunks)
    return d, nodes


@query(
    """WITH t AS (SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN 'issue-' || CAST(doc_id AS VARCHAR) ELSE 'chunk-' || CAST(doc_id AS VARCHAR) END AS target FROM documents)
SELECT target, 'chunk-' || CAST(doc_id AS VARCHAR) AS node, 0 AS place, 'none' AS intact FROM t
UNION ALL SELECT target, 'doc-' || CAST(doc_id AS VARCHAR), 1, CASE WHEN doc_id % 7 = 0 THEN 'false' ELSE 'true' END FROM t
UNION ALL SELECT target, 'crawl-' || source, CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 2 END, 'none' FROM t
UNION ALL SELECT target, 'scope', CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 3 END, 'none' FROM t"""
)
def lineage_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk, or an issue found at it, is traced back depth first; each third document names its crawl last."""
    i, (d, nodes) = F.col("doc_id"), _provenance(spark, sf_dir)
    issues = d.where("doc_id % 2 = 0").select(F.concat(F.lit("issue-"), "i").alias("id"), F.concat(F.lit("chunk-"), "i").alias("detected_at"))
    targets = d.select(F.concat(F.when(i % 2 == 0, "issue-").otherwise("chunk-"), "i").alias("id"))
    found = L.explain(nodes, issues, targets, d.select(F.col("i").alias("path"), F.col("text").cast("binary").alias("content")))
    return found.select("target", "node", "place", F.coalesce(F.col("intact").cast("string"), F.lit("none")).alias("intact"))


@query(
    """WITH d AS (SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS doc, 'chunk-' || CAST(doc_id AS VARCHAR) AS chunk, 'crawl-' || source AS crawl, 'issue-' || CAST(doc_id AS VARCHAR) AS issue, doc_id % 2 = 0 AS odd FROM documents)
SELECT DISTINCT crawl AS target, 'scope' AS node, 'backward' AS direction FROM d UNION ALL SELECT crawl, doc, 'forward' FROM d UNION ALL SELECT crawl, chunk, 'forward' FROM d
UNION ALL SELECT doc, 'scope', 'backward' FROM d UNION ALL SELECT doc, crawl, 'backward' FROM d UNION ALL SELECT doc, chunk, 'forward' FROM d
UNION ALL SELECT issue, 'scope', 'backward' FROM d WHERE odd UNION ALL SELECT issue, crawl, 'backward' FROM d WHERE odd UNION ALL SELECT issue, doc, 'backward' FROM d WHERE odd"""
)
def lineage_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every crawl and document, and every issue found at a chunk, in both directions at once."""
    i, (d, nodes) = F.col("doc_id"), _provenance(spark, sf_dir)
    issues = d.where("doc_id % 2 = 0").select(F.concat(F.lit("issue-"), "i").alias("id"), F.concat(F.lit("chunk-"), "i").alias("detected_at"))
    targets = d.select(F.explode(F.array("crawl", F.concat(F.lit("doc-"), "i"), F.when(i % 2 == 0, F.concat(F.lit("issue-"), "i")).otherwise(F.lit("unknown")))).alias("id"))
    return L.affected(nodes, targets, issues)


@query(
    """SELECT doc_id, sha256('{"raw_sha256":"' || sha256(text) || '","parser":' || CASE WHEN doc_id % 2 = 0 THEN '"native"' ELSE 'null' END || ',"parser_library_version":null,"parser_config":null,"chunker":"spans-1","content":"'
|| sha256('{"text":' || CAST(to_json(text) AS VARCHAR) || ',"tables":null}') || '"}') AS version FROM documents"""
)
def document_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2("text", 256).alias("raw_sha256"), F.when(F.col("doc_id") % 2 == 0, "native").alias("parser"))
    return d.select("doc_id", C.document_version(d).alias("version"))


@query(
    """SELECT conv_id, turn, 'c' || substr(sha256('{"ordinal":' || CAST(turn AS VARCHAR) || ',"locator":{"start":0,"end":' || CAST(length(text) AS VARCHAR) || '},"text":' || CAST(to_json(text) AS VARCHAR) || '}'), 1, 24) AS chunk_id FROM conversations"""
)
def review_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.struct(F.lit(0).alias("start"), F.length("text").alias("end"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.review_chunk_id(F.col("turn"), place, F.col("text")).alias("chunk_id"))


@query(
    """SELECT page_id, sha256(CASE WHEN page_id % 3 = 0 THEN 'p' || CAST(page_id AS VARCHAR) ELSE url END) AS source_id, CASE page_id % 3 WHEN 0 THEN 'source-' || substr(sha256(html), 1, 16) WHEN 1 THEN 'url-' || substr(sha256(url), 1, 24) ELSE 'given' END AS review_source_id FROM pages"""
)
def source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    url = F.when(i % 3 == 0, "").otherwise(F.col("url"))
    given = F.when(i % 3 == 2, " given ").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", C.source_id(url, F.concat(F.lit("p"), i.cast("string"))).alias("source_id"), C.review_source_id(given, F.sha2("html", 256), url).alias("review_source_id"))


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as parsed documents: a text or two pages, a row, and a table of one row."""
    c, i = table(spark, sf_dir, "customer"), F.col("c_custkey")
    pages = F.array(*[F.struct(F.lit(k).alias("page"), F.concat(F.lit(f"page {k} of "), "c_name").alias("text")) for k in (1, 2)])
    cell = F.struct(F.lit(0).alias("column"), F.col("c_mktsegment").alias("text"))
    return c.select(
        i.cast("string").alias("parsed_path"), F.col("c_name").alias("title"), F.lit(None).cast("string").alias("source_note"), F.concat(F.lit("text of "), "c_name").alias("text"),
        F.when(i % 2 == 0, pages).alias("pages"), F.array(F.struct(F.col("c_mktsegment").alias("segment"))).alias("rows"), F.array(F.struct(F.array(F.array(cell)).alias("grid"))).alias("tables"),
    )


@query(
    """WITH s AS (
  SELECT c_custkey AS k, c_name, 'page' AS kind, p AS page, NULL AS row_, NULL AS table_, 'page ' || CAST(p AS VARCHAR) || ' of ' || c_name AS text FROM customer, (VALUES (1), (2)) t(p) WHERE c_custkey % 2 = 0
  UNION ALL SELECT c_custkey, c_name, 'text', NULL, NULL, NULL, 'text of ' || c_name FROM customer WHERE c_custkey % 2 = 1
  UNION ALL SELECT c_custkey, c_name, 'row', NULL, 0, NULL, '{"segment":"' || c_mktsegment || '"}' FROM customer
  UNION ALL SELECT c_custkey, c_name, 'table', NULL, 0, 0, '[{"column":0,"text":"' || c_mktsegment || '"}]' FROM customer)
SELECT CAST(k AS VARCHAR) AS parsed_path, kind, CAST(0 AS INTEGER) AS ordinal, c_name || chr(10) || text AS text,
  'c' || substr(sha256(concat_ws('|', CAST(k AS VARCHAR), '{"kind":"' || kind || '"' || CASE WHEN page IS NULL THEN '' ELSE ',"page":' || CAST(page AS VARCHAR) END || CASE WHEN row_ IS NULL THEN '' ELSE ',"row":0' END || CASE WHEN table_ IS NULL THEN '' ELSE ',"table":0' END || '}', '0', c_name || chr(10) || text)), 1, 24) AS chunk_id FROM s"""
)
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of texts, pages, rows and table rows."""
    return C.make_chunks(_papers(spark, sf_dir), 400).select("parsed_path", "kind", F.col("ordinal").cast("int").alias("ordinal"), "text", "chunk_id")


@query("SELECT CAST(c_custkey AS VARCHAR) AS parsed_path FROM customer WHERE length('[{\"column\":0,\"text\":\"' || c_mktsegment || '\"}]') > 33")
def wide_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rows that no chunk of 33 characters holds."""
    return C.wide_rows(C.sections(_papers(spark, sf_dir)), 33).select("parsed_path")


@query("SELECT CAST(c_custkey AS VARCHAR) AS parsed_path, 'page 2 of ' || c_name AS text FROM customer WHERE c_custkey % 2 = 0")
def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page that a chunk's place names."""
    found = _papers(spark, sf_dir).select("parsed_path", C.page_of(F.lit(2), F.col("pages")).alias("p"))
    return found.where("p is not null").select("parsed_path", "p.text")


@query("SELECT CAST(event_id AS VARCHAR) AS path, CASE WHEN event_id % 4 > 0 THEN '{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' ELSE 'none' END AS text, CASE WHEN event_id % 4 = 0 THEN 'not JSON' ELSE 'none' END AS error FROM events")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole JSON files, some torn or with a byte order mark."""
    i = F.col("event_id")
    body = F.when(i % 4 == 0, F.expr("substring(props, 1, length(props) - 1)")).when(i % 4 == 1, F.concat(F.lit("﻿"), "props")).otherwise(F.col("props"))
    found = R.json_texts(table(spark, sf_dir, "events").select(i.cast("string").alias("path"), body.cast("binary").alias("content")))
    return found.select("path", F.coalesce("text", F.lit("none")).alias("text"), F.coalesce("error", F.lit("none")).alias("error"))


@query("SELECT doc_id, CASE WHEN trim(text) = '' OR doc_id % 5 = 0 THEN 'no text' WHEN length(text) > 600000 OR doc_id % 5 = 1 THEN 'text or pages out of bounds' WHEN doc_id % 5 = 2 THEN 'no parser or options' ELSE 'none' END AS error FROM documents")
def parser_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 5
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(k == 0, " \n ").otherwise(F.col("text")).alias("t"), F.when(k != 1, F.array(F.lit(1))).alias("p"), F.when(k == 2, "other").otherwise("docling-local-v1").alias("n"))
    return d.select("doc_id", F.coalesce(R.parser_errors(F.col("t"), F.col("p"), F.col("n"), F.lit("{}")), F.lit("none")).alias("error"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'miss' WHEN 1 THEN 'changed' ELSE 'hit' END AS state, CASE WHEN doc_id % 3 = 2 THEN sha256(text || '!') ELSE 'none' END AS document FROM documents")
def parse_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some parses aren't stored, some were changed after they were."""
    i, body = F.col("doc_id"), F.concat(F.col("doc_id").cast("string"), F.lit(" "), "text").cast("binary")
    files = table(spark, sf_dir, "documents").select("doc_id", i.cast("string").alias("path"), body.alias("content"), F.concat("text", F.lit("!")).alias("document"))
    cache = files.where("doc_id % 3 > 0").select(R.cache_key(F.col("content"), "{}", "w1").alias("key"), F.when(i % 3 == 2, F.sha2("document", 256)).otherwise("old").alias("sha256"), "document")
    found = R.cached_parses(files.select("path", "content"), cache, "{}", "w1")
    return found.select(F.col("path").cast("long").alias("doc_id"), "state", F.coalesce(F.sha2("document", 256), F.lit("none")).alias("document"))


@query(
    """WITH n AS (SELECT event_id AS seq, event_type, user_id FROM events ORDER BY event_id DESC LIMIT 500), i AS (SELECT event_id AS seq, event_type FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 100)
SELECT 'node' AS kind, seq, 'n' || CAST(seq AS VARCHAR) AS id, CASE WHEN event_type = 'search' THEN 'Search' ELSE event_type END AS stage_label, 'token=[MASKED]' AS label, 'https://e.org/' || CAST(user_id AS VARCHAR) || '?api_key=%5BMASKED%5D' AS url FROM n
UNION ALL SELECT 'issue', seq, 'e' || CAST(seq AS VARCHAR), 'error', 'Bearer [MASKED]', 'none' FROM i
UNION ALL SELECT 'import', doc_id, 'import-' || CAST(doc_id AS VARCHAR), 'Queued for review', lang, '' FROM documents"""
)
def trace_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stand for nodes and issues; secrets in labels and URLs are masked."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    seq, user = i.cast("string"), F.col("user_id").cast("string")
    nodes = e.select(i.alias("seq"), F.concat(F.lit("n"), seq).alias("id"), F.col("event_type").alias("stage"), F.concat(F.lit("token="), user).alias("label"), F.lit("success").alias("status"), F.concat(F.lit("https://u:p@e.org/"), user, F.lit("?api_key="), user).alias("url"), F.lit(None).cast("string").alias("issue"))
    issues = e.where("event_type = 'error'").select(i.alias("seq"), F.concat(F.lit("e"), seq).alias("id"), F.lit("401").alias("code"), F.lit("n").alias("detected_at"), F.lit("error").alias("stage"), F.concat(F.lit("Bearer "), seq).alias("message"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "doc_id", F.col("lang").alias("title"), F.lit("pending").alias("status"), F.lit("file:///x").alias("source_url"))
    return U.trace_view(nodes, issues, docs).select("kind", "seq", "id", "stage_label", "label", F.coalesce("url", F.lit("none")).alias("url"))


@query("SELECT count(*) FILTER (WHERE doc_id % 4 = 0) AS automatic, count(*) FILTER (WHERE doc_id % 4 = 2) AS human, count(*) FILTER (WHERE doc_id % 4 IN (1, 3)) AS \"left\" FROM documents")
def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(F.when(i % 2 == 0, "approved").otherwise("pending").alias("status"), F.when(i % 4 == 0, "automatic").alias("approval_mode"))
    return U.review_counts(docs)


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 50")
def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.newest_first(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 50)


@query(
    f"""WITH m AS (SELECT doc_id, doc_id % 2 = 0 AS given, 'the ' || CASE doc_id % 3 WHEN 0 THEN 'Rate' WHEN 1 THEN 'Tỉ lệ' ELSE 'total' END || ' of ' || text AS metric, {sql_fold('text')} AS f FROM documents)
SELECT doc_id, NOT given AND (doc_id % 3 < 2 OR regexp_matches(f, '\\b(ti le|ty le|rate|ratio|percentage|percent)\\b|%')) AS missing, given AND NOT contains(f, 'thea') AS invented FROM m"""
)
def denominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates without a denominator, and denominators that aren't in the text."""
    i = F.col("doc_id")
    name = F.concat(F.lit("the "), F.when(i % 3 == 0, "Rate").when(i % 3 == 1, "Tỉ lệ").otherwise("total"), F.lit(" of "), "text")
    d = table(spark, sf_dir, "documents").select("doc_id", T.fold(name).alias("m"), T.fold(F.col("text")).alias("f"), F.when(i % 2 == 0, "thea").alias("d"))
    return d.select("doc_id", T.denominator_missing(F.col("m"), F.col("d"), F.array()).alias("missing"), T.denominator_invented(F.col("d"), F.col("f")).alias("invented"))


@query(f"SELECT doc_id, sha256({sql_fold('text')}) AS folded FROM documents")
def queue_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review queue's search form (T3); these texts have only the accents that it drops."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.queue_fold(F.col("text")), 256).alias("folded"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN '' ELSE event_type END AS unsupported FROM events")
def unsupported_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.array_join(U.unsupported(F.array("event_type"), F.array(F.lit("click"), F.lit("view"))), ",").alias("unsupported"))


@query("SELECT doc_id, '{\"text\":' || CAST(to_json(lang) AS VARCHAR) || ',\"parser\":\"p\"}' AS evidence, CAST(2 AS INTEGER) AS n_columns FROM documents")
def kept_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reviewer keeps of a parse, and what the index tells of a chunk."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("text"), F.lit("p").alias("parser"), F.lit("/run/x").alias("parsed_path"))
    shown = C.index_metadata(d.select("doc_id", "text", F.lit(1).alias("vector"), F.lit("k").alias("cache_key")))
    return d.join(shown.select("doc_id", F.lit(len(shown.columns)).alias("n_columns")), "doc_id").select("doc_id", F.to_json(R.parser_evidence(d)).alias("evidence"), "n_columns")


@query(
    """WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE c_custkey % 2 = 0) AS two FROM customer), s AS (SELECT 3 * n + two AS chunks, n.n AS docs FROM n)
SELECT c AS "check", CASE c WHEN 'index_known' THEN chunks - docs + 1 WHEN 'unique_id' THEN chunks ELSE chunks END AS checked,
CASE c WHEN 'index_known' THEN 1 WHEN 'index_equal' THEN docs + (SELECT count(*) FROM customer WHERE c_custkey % 5 = 0) ELSE 0 END AS failed
FROM s, (VALUES ('document_found'), ('kind_known'), ('prefix_kept'), ('version_equal'), ('span_equal'), ('within_limit'), ('id_recomputed'), ('index_equal'), ('unique_id'), ('index_known')) t(c)"""
)
def section_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that lacks the rows' chunks, has other texts for some tables, and one chunk too many."""
    docs = _papers(spark, sf_dir)
    chunks = C.make_chunks(docs, 400)
    odd = (F.col("kind") == "table") & (F.col("parsed_path").cast("long") % 5 == 0)
    index = chunks.where("kind <> 'row'").select("chunk_id", F.when(odd, "other").otherwise(F.col("text")).alias("text"))
    more = spark.createDataFrame([("c0", "none")], "chunk_id string, text string")
    return C.audit_sections(chunks, index.unionByName(more), docs, 400)


@query("SELECT doc_id, doc_id % 3 = 0 AS same, CASE WHEN doc_id % 2 = 0 THEN 'automatically_approved_not_fact_verified' ELSE 'human_reviewed_not_guaranteed' END AS confidence FROM documents")
def answer_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs with exactly the asked keys (U3), and how far an approval goes."""
    i = F.col("doc_id")
    body = F.when(i % 3 == 0, '{"b": 1, "a": null}').when(i % 3 == 1, '{"a": 1}').otherwise('{"a": 1, "b": 2, "c": 3}')
    return table(spark, sf_dir, "documents").select("doc_id", J.same_keys(body, ("a", "b")).alias("same"), V.factual_confidence(F.when(i % 2 == 0, "automatic")).alias("confidence"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'html' WHEN doc_id % 3 = 1 THEN 'text' ELSE 'none' END AS route, CASE WHEN doc_id % 3 = 2 THEN 'none' ELSE sha256(lang) END AS text FROM documents")
def routed_parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of body goes to the parser that is registered for it."""
    i = F.col("doc_id")
    body = F.when(i % 3 == 0, F.concat(F.lit("<p>"), "lang", F.lit("</p>"))).otherwise(F.col("lang"))
    files = table(spark, sf_dir, "documents").select(i.cast("string").alias("path"), body.cast("binary").alias("content"), F.when(i % 3 == 0, "html").when(i % 3 == 1, "txt").otherwise("pdf").alias("kind"))
    parsers = {
        "html": (("html",), lambda f: f.select("path", M.page_text(F.decode("content", "UTF-8")).alias("text"))),
        "text": (("txt", "md"), lambda f: f.select("path", R.text_upload(F.col("content")).alias("text"))),
    }
    found = R.routed(files, parsers)
    return found.select(F.col("path").cast("long").alias("doc_id"), F.coalesce("route", F.lit("none")).alias("route"), F.coalesce(F.sha2("text", 256), F.lit("none")).alias("text"))
