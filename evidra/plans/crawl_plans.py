"""Discovery, deduplication and crawl summary queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import markup as M
from evidra.functions import urls as U
from evidra.operators import robots as B
from evidra.operators import crawl as K
from evidra.plans.registry import query
from evidra.session import table, texts

_HOST = "lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))"
_CANDIDATES = f"""r AS (SELECT {_HOST} AS url, 'title ' || CAST(page_id AS VARCHAR) AS title, 'query ' || CAST(page_id % 3 AS VARCHAR) AS query, page_id AS seq FROM pages),
m AS (SELECT url, min_by(title, seq) AS title, min(seq) AS first_seq FROM r GROUP BY url),
qs AS (SELECT url, string_agg(query, ',' ORDER BY s) AS queries FROM (SELECT url, query, min(seq) AS s FROM r GROUP BY url, query) GROUP BY url)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    results = pages.select(U.host(F.col("url")).alias("url"), F.concat(F.lit("title "), F.col("page_id").cast("string")).alias("title"), F.concat(F.lit("query "), (F.col("page_id") % 3).cast("string")).alias("query"), F.col("page_id").alias("seq"))
    return K.merge_candidates(results)


@query(f"WITH {_CANDIDATES} SELECT url, title, queries, first_seq FROM m JOIN qs USING (url)")
def candidate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("url", "title", F.array_join("search_queries", ",").alias("queries"), "first_seq")


@query(
    f"""WITH {_CANDIDATES}, s AS (SELECT url, first_seq, first_seq % 9 AS relevance, CASE first_seq % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'lead' ELSE 'none' END AS relation, first_seq % 11 = 0 AS catalog_verified, first_seq % 5 AS priority FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY relevance >= 3 ORDER BY catalog_verified DESC, CASE relation WHEN 'direct' THEN 2 WHEN 'lead' THEN 1 ELSE 0 END DESC, relevance DESC, priority DESC, first_seq, url) AS p FROM s)
SELECT url, CASE WHEN relevance < 3 THEN 'rejected' WHEN p <= 5 THEN 'candidate' ELSE 'deferred' END AS decision, CAST(CASE WHEN relevance >= 3 AND p <= 5 THEN p ELSE 0 END AS INTEGER) AS place FROM o"""
)
def candidate_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("first_seq")
    relation = F.when(seq % 4 == 0, "direct").when(seq % 4 == 1, "lead").otherwise("none")
    scored = _candidates(spark, sf_dir).withColumns({"relevance": seq % 9, "relation": relation, "catalog_verified": seq % 11 == 0, "priority": seq % 5})
    return K.rank_candidates(scored, 5).select("url", "decision", F.coalesce("place", F.lit(0)).alias("place"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every page on its own host; relative targets take the page's host."""
    pages = table(spark, sf_dir, "pages")
    found = pages.select("page_id", F.col("url").alias("page_url"), F.explode(M.page_links("html")).alias("a"))
    base = F.regexp_extract("page_url", r"^([a-z]+://[^/?#]+)", 1)
    target = F.when(F.startswith(F.col("a.href"), F.lit("/")), F.concat(base, F.col("a.href"))).otherwise(F.col("a.href"))
    return found.select("page_id", "page_url", target.alias("url"), F.col("a.title").alias("title"))


_LINKS = """a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)"""


@query(f"WITH {_LINKS} SELECT page_id, count(*) AS n_links FROM a WHERE starts_with(href, '/') AND NOT regexp_matches(href, '/login|/search|wp-admin|javascript:', 'i') GROUP BY page_id")
def same_host_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.same_host_links(_links(spark, sf_dir)).groupBy("page_id").agg(F.count("*").alias("n_links"))


@query(
    f"""WITH {_LINKS}, h AS (SELECT page_id, replace(replace(href, '&amp;', '&'), '&#x27;', '''') AS href FROM a WHERE starts_with(href, '/') AND NOT regexp_matches(href, '/login|/search|wp-admin|javascript:', 'i'))
SELECT page_id, href, CAST(place AS INTEGER) AS place FROM (SELECT page_id, href, row_number() OVER (PARTITION BY page_id ORDER BY least(length(href), 9) DESC, href DESC) AS place FROM h WHERE length(href) >= 3) WHERE place <= 3"""
)
def link_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of a link here: the length of its path, nine at most."""
    links = K.same_host_links(_links(spark, sf_dir))
    path = F.regexp_replace("url", r"^[a-z]+://[^/?#]+", "")
    return K.link_topk(links.withColumn("score", F.least(F.length(path), F.lit(9)))).select("page_id", path.alias("href"), "place")


@query(
    """WITH d AS (SELECT doc_id, sha256(lower(text)) AS digest, doc_id % 7 AS relevance FROM documents), c AS (SELECT digest, min(doc_id) FILTER (WHERE relevance >= 3) AS claimed FROM d GROUP BY digest)
SELECT doc_id, CASE WHEN doc_id > claimed THEN 'duplicate' WHEN relevance < 3 THEN 'out_of_scope' ELSE 'kept' END AS outcome FROM d JOIN c USING (digest)"""
)
def exact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir).select("doc_id", F.col("doc_id").alias("seq"), F.sha2(F.lower("text"), 256).alias("digest"), (F.col("doc_id") % 7).alias("relevance"))
    return K.dedupe(docs).select("doc_id", "outcome")


@query(
    """WITH d AS (SELECT doc_id, sha256(lower(text)) AS digest, doc_id % 7 AS relevance FROM documents), c AS (SELECT digest, min(doc_id) AS claimed FROM d GROUP BY digest)
SELECT doc_id, CASE WHEN doc_id > claimed THEN 'duplicate' WHEN relevance < 3 THEN 'out_of_scope' ELSE 'kept' END AS outcome FROM d JOIN c USING (digest)"""
)
def exact_dedupe_model_planner(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir).select("doc_id", F.col("doc_id").alias("seq"), F.sha2(F.lower("text"), 256).alias("digest"), (F.col("doc_id") % 7).alias("relevance"))
    return K.dedupe(docs, rules_planner=False).select("doc_id", "outcome")


_STATUS = "CASE doc_id % 5 WHEN 0 THEN 'review' WHEN 1 THEN 'out_of_scope' WHEN 2 THEN 'source_lead' WHEN 3 THEN 'failed' ELSE 'duplicate' END"


def _with_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 5
    return texts(spark, sf_dir).select("doc_id", F.when(k == 0, "review").when(k == 1, "out_of_scope").when(k == 2, "source_lead").when(k == 3, "failed").otherwise("duplicate").alias("status"))


@query(f"SELECT {_STATUS} AS status, count(*) AS n FROM documents GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.status_counts(_with_status(spark, sf_dir))


@query(f"SELECT count(*) FILTER (WHERE s = 'verified_against_source') AS verified, count(*) FILTER (WHERE s = 'review') AS review, 'needs_review' AS run_status FROM (SELECT {_STATUS} AS s FROM documents)")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.run_status(_with_status(spark, sf_dir))


@query(f"SELECT (SELECT count(*) FROM pages) AS candidates, count(*) AS processed, (SELECT count(*) FROM nation) AS rows, count(*) FILTER (WHERE s = 'review') AS review, count(*) FILTER (WHERE s = 'failed') AS failed, 'has_verified_data' AS run_status, '' AS to_clarify FROM (SELECT {_STATUS} AS s FROM documents)")
def crawl_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.crawl_summary(_with_status(spark, sf_dir), table(spark, sf_dir, "pages"), table(spark, sf_dir, "nation"))


@query(
    """SELECT doc_id, CASE WHEN NOT (doc_id % 2 = 0 AND (doc_id % 3 = 0 OR doc_id % 5 < 3)) OR doc_id % 7 = 0 THEN 'out_of_scope'
WHEN doc_id % 11 < 5 OR (doc_id % 4 = 0 AND doc_id % 13 < 6) THEN 'review' ELSE 'source_lead' END AS status FROM documents"""
)
def check_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    checks = texts(spark, sf_dir).select(
        "doc_id",
        (i % 2 == 0).alias("subject_match"),
        F.when(i % 3 != 0, "VN").alias("country"),
        (i % 5 < 3).alias("geography_match"),
        F.when(i % 7 != 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("evidence_ids"),
        (i % 11 < 5).alias("contains_data"),
        F.when(i % 4 == 0, "conceptual").otherwise("statistical").alias("content_mode"),
        (i % 13 < 6).alias("contains_requested_metric"),
    )
    return K.check_status(checks).select("doc_id", "status")


@query(
    """WITH p AS (SELECT doc_id // 60 AS paper, doc_id % 60 + 1 AS page, doc_id % 4 AS score FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY page <= 2 DESC, score DESC, page) AS r FROM p WHERE page <= 2 OR score > 0)
SELECT paper, page, CAST(row_number() OVER (PARTITION BY paper ORDER BY page) AS INTEGER) AS position FROM k WHERE r <= 24"""
)
def page_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty documents stand for a paper's pages."""
    i = F.col("doc_id")
    pages = texts(spark, sf_dir).select(F.floor(i / 60).alias("doc_id"), (i % 60 + 1).alias("page"), (i % 4).alias("score"))
    return K.retain_pages(pages).select(F.col("doc_id").alias("paper"), "page", "position")


@query(
    """WITH w AS (SELECT doc_id, unnest(range(0, length(text), 5000)) AS start, text FROM documents), s AS (SELECT doc_id, CAST(start AS INTEGER) AS start, length(replace(substr(text, start + 1, 5000), 'e', '')) % 17 AS score FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, start = 0 ORDER BY score DESC, start) AS k FROM s)
SELECT doc_id, start, score FROM r WHERE start = 0 OR k <= 3"""
)
def window_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = K.windows(texts(spark, sf_dir).select("doc_id", "text"))
    scored = w.select("doc_id", "start", (F.length(F.replace("text", F.lit("e"), F.lit(""))) % 17).cast("long").alias("score"))
    return K.select_windows(scored)


@query(
    """WITH RECURSIVE b(url, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT url * 2 + k, depth + 1 FROM b, (VALUES (1), (2)) t(k) WHERE depth < 3)
SELECT url, depth, CAST(row_number() OVER (ORDER BY depth, url) AS INTEGER) AS place FROM b WHERE url IN (SELECT page_id FROM pages) QUALIFY place <= 12"""
)
def crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth-first over a static graph in which page n links to 2n+1 and 2n+2."""
    pages = table(spark, sf_dir, "pages").select("page_id")
    graph = pages.select(F.explode(F.array(F.struct((F.col("page_id") * 2 + 1).alias("dst"), F.lit(1).alias("seq")), F.struct((F.col("page_id") * 2 + 2).alias("dst"), F.lit(2).alias("seq")))).alias("e"), F.col("page_id").alias("src")).select("src", "e.dst", "e.seq").join(pages.withColumnRenamed("page_id", "dst"), "dst", "left_semi")
    return K.frontier(graph, pages.where("page_id = 0").select(F.col("page_id").alias("url"), F.lit(0).alias("seq")), 12, 3)


@query("SELECT user_id AS job_id, coalesce(max_by(CAST(json_extract(props, '$.k') AS VARCHAR), event_id) FILTER (WHERE event_type = 'error'), 'none') AS error FROM events GROUP BY user_id")
def last_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.when(F.col("event_type") == "error", "failed").otherwise("running").alias("state"), F.get_json_object("props", "$.k").alias("code"), F.col("event_id").alias("seq"))
    return K.last_error(e).select("job_id", F.coalesce("error", F.lit("none")).alias("error"))


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 500")
def event_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.tail(table(spark, sf_dir, "events").select("event_id", "event_type"), F.col("event_id"))


@query("SELECT bool_and(event_type = 'error') AS all_failed, bool_and(event_type = 'error' AND value > 5) AS all_challenged FROM events")
def discovery_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), F.when(F.col("value") > 5, 202).otherwise(200).alias("http_status"))
    return K.discovery_failed(e)


@query(
    """WITH u AS (SELECT page_id, url, regexp_extract(url, '^(https?)', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_replace(regexp_replace(url, '^https?://[^/?#]+', ''), '#.*$', '') AS path FROM pages),
c AS (SELECT *, scheme = 'https' AND NOT starts_with(host, 'blog.') AND NOT starts_with(host, 'm.') AS checked FROM u),
r AS (SELECT *, CASE WHEN NOT checked THEN 'none' WHEN regexp_matches(path, '^/en/.*\\.html$') THEN '/en/*.html$' WHEN regexp_matches(path, '^/.*\\?page=') THEN '/*?page=' WHEN starts_with(path, '/en/') THEN '/en/' ELSE 'none' END AS rule FROM c)
SELECT page_id, CASE WHEN scheme = 'http' THEN 'not_present' WHEN checked THEN 'checked' ELSE 'unavailable' END AS state, CASE WHEN checked THEN CAST(length(host) + 8 AS DOUBLE) ELSE 0.6 END AS delay, rule,
scheme = 'http' OR (checked AND length(host) <= 22 AND rule IN ('none', '/en/*.html$')) AS allowed FROM r"""
)
def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved answers of every origin of the pages: none for plain HTTP, failures and markup for some hosts, and rules with a delay of the name's length and 8."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    at = pages.select(B.origin(F.col("url")).alias("origin")).distinct()
    name = F.substring_index("origin", "//", -1)
    plain, blog, mobile = F.startswith("origin", F.lit("http:")), F.startswith(name, F.lit("blog.")), F.startswith(name, F.lit("m."))
    rules = F.concat(F.lit("User-agent: *\nDisallow: /\n\nUser-agent: Other\nUser-agent: Evidra\nDisallow: /en/ # English\nAllow: /en/*.html$\nDisallow: /*?page=\nDisallow:\nCrawl-delay: "), (F.length(name) + 8).cast("string"))
    saved = at.select("origin", F.when(plain, 404).when(blog, 503).otherwise(200).alias("status"), F.when(mobile, "<html>").otherwise(rules).alias("body"))
    found = B.allowed(pages, saved, "evidra/1.0")
    return found.select("page_id", F.col("robots_state").alias("state"), F.col("robots_delay").alias("delay"), F.coalesce("robots_rule", F.lit("none")).alias("rule"), F.col("robots_allowed").alias("allowed"))
