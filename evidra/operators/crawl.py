"""Discovery, candidates, links and crawl summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidra.functions.urls import host

RELEVANT = 3


def merge_candidates(results: DataFrame) -> DataFrame:
    """One row for each URL of ``results(url, title, query, seq)``: its first title, its queries in order, its first place."""
    # A query once for each URL, so what is gathered of a hot URL is its different queries.
    asked = results.groupBy("url", "query").agg(F.min(F.struct("seq")).alias("at"), F.min_by(F.struct("seq", "title"), "seq").alias("first"))
    merged = asked.groupBy("url").agg(F.min_by("first", "first.seq").alias("first"), F.array_sort(F.collect_list(F.struct("at", "query"))).alias("q"))
    return merged.select("url", "first.title", F.transform("q", lambda x: x["query"]).alias("search_queries"), F.col("first.seq").alias("first_seq"))


def rank_candidates(candidates: DataFrame, most: int) -> DataFrame:
    """A decision and a rank for each candidate.

    ``relevance`` under 3 is rejected.  The others are ordered by
    ``catalog_verified``, ``relation`` (direct before lead), ``relevance``,
    ``priority``, then first place; those beyond ``most`` are deferred and
    have no ``place``.  URLs are unique, as merged candidates are.
    """
    relation = F.when(F.col("relation") == "direct", 2).when(F.col("relation") == "lead", 1).otherwise(0)
    order = [F.desc(F.coalesce("catalog_verified", F.lit(False))), F.desc(relation), F.desc("relevance"), F.desc("priority"), F.asc("first_seq"), F.asc("url")]
    good = candidates.where(F.col("relevance") >= RELEVANT)
    # The limit keeps ``most`` rows of each partition, so only that many are numbered in one task.
    best = good.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order))).select("url", "place")
    decision = F.when(F.coalesce(F.col("relevance") < RELEVANT, F.lit(True)), "rejected").when(F.col("place").isNotNull(), "candidate").otherwise("deferred")
    return candidates.join(best, "url", "left").withColumn("decision", decision)


def same_host_links(links: DataFrame) -> DataFrame:
    """links to the page's own host that lead to no login, search or admin page; ``page_id, page_url, url, title``."""
    bad = r"(?i)/login|/search|wp-admin|javascript:"
    return links.where((host(F.col("page_url")) == host(F.col("url"))) & ~F.col("url").rlike(bad))


def link_topk(links: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` best links of each page by score, URL and title, all descending; only scores of 3 or more."""
    w = Window.partitionBy("page_id").orderBy(F.desc("score"), F.desc("url"), F.desc("title"))
    return links.where(F.col("score") >= RELEVANT).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def dedupe(docs: DataFrame, rules_planner: bool = True) -> DataFrame:
    """C4: ``docs(doc_id, seq, digest, relevance)`` with ``outcome``.

    The first relevant document of a digest stays, later ones are duplicates,
    and earlier ones were out of scope without claiming the digest.  With a
    model planner every document claims it.  Hot digests are counted by
    aggregation and joined back, never sorted in one task.
    """
    ok = F.col("relevance") >= RELEVANT
    claim = docs.groupBy("digest").agg(F.min(F.when(ok, F.col("seq")) if rules_planner else F.col("seq")).alias("claimed"))
    outcome = F.when(F.col("seq") > F.col("claimed"), "duplicate").when(~ok, "out_of_scope").otherwise("kept")
    return docs.join(claim, "digest").withColumn("outcome", outcome).drop("claimed")


def status_counts(docs: DataFrame) -> DataFrame:
    """A1."""
    return docs.groupBy("status").agg(F.count("*").alias("n"))


def run_status(docs: DataFrame, ambiguities: int = 0) -> DataFrame:
    """A2: one row: the run's status by precedence."""
    n = lambda s: F.count_if(F.col("status") == s)
    counts = docs.agg(n("verified_against_source").alias("verified"), n("review").alias("review"))
    status = F.when(F.lit(ambiguities > 0), "needs_clarification").when(F.col("verified") > 0, "has_verified_data").when(F.col("review") > 0, "needs_review").otherwise("incomplete")
    return counts.select("verified", "review", status.alias("run_status"))


def crawl_summary(docs: DataFrame, candidates: DataFrame, observations: DataFrame, ambiguities: list[str] | None = None) -> DataFrame:
    """One row: what a run found and how it ends; nothing that failed or waits for review counts as verified."""
    n = lambda s: F.count_if(F.col("status") == s)
    counts = docs.agg(F.count("*").alias("processed"), n("review").alias("review"), n("failed").alias("failed"))
    wide = counts.crossJoin(F.broadcast(candidates.agg(F.count("*").alias("candidates")))).crossJoin(F.broadcast(observations.agg(F.count("*").alias("rows"))))
    status = F.when(F.lit(bool(ambiguities)), "needs_clarification").when(F.col("rows") > 0, "has_verified_data").when(F.col("review") > 0, "needs_review").otherwise("incomplete")
    return wide.select("candidates", "processed", "rows", "review", "failed", status.alias("run_status"), F.lit("; ".join(ambiguities or [])).alias("to_clarify"))


def check_status(checks: DataFrame) -> DataFrame:
    """The status that a checked document takes."""
    in_scope = F.col("subject_match") & (F.col("country").isNull() | F.col("geography_match")) & (F.coalesce(F.size("evidence_ids"), F.lit(0)) > 0)
    data = F.col("contains_data") | ((F.col("content_mode") == "conceptual") & F.col("contains_requested_metric"))
    return checks.withColumn("status", F.when(in_scope & data, "review").when(in_scope, "source_lead").otherwise("out_of_scope"))


def retain_pages(pages: DataFrame, most: int = 24) -> DataFrame:
    """Of each document the pages 1 and 2 and those that score, ``most`` at most, back in page order."""
    front = F.col("page") <= 2
    w = Window.partitionBy("doc_id").orderBy(F.desc(front), F.desc("score"), F.asc("page"))
    kept = pages.where(front | (F.col("score") > 0)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))).drop("place")


def windows(docs: DataFrame, size: int = 5000) -> DataFrame:
    """``doc_id, start, text``: contiguous windows of ``size`` characters."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(size))
    w = docs.where(F.length("text") > 0).select("doc_id", "text", F.explode(starts).alias("start"))
    return w.select("doc_id", "start", F.expr(f"substring(text, start + 1, {size})").alias("text"))


def select_windows(scored: DataFrame, best: int = 3) -> DataFrame:
    """Each document's first window and the ``best`` others by score, then place; in order of place."""
    w = Window.partitionBy("doc_id", F.col("start") == 0).orderBy(F.desc("score"), F.asc("start"))
    return scored.withColumn("place", F.row_number().over(w)).where((F.col("start") == 0) | (F.col("place") <= best)).drop("place")


def frontier(graph: DataFrame, seeds: DataFrame, max_pages: int, max_depth: int) -> DataFrame:
    """Breadth-first order over a static link graph ``(src, dst, seq)``: ``url, depth, place``, the first ``max_pages``."""
    seen = seeds.select("url", F.lit(0).alias("depth"), F.col("seq").cast("long").alias("seq"))
    front = seen
    for depth in range(1, max_depth + 1):
        step = front.select(F.col("url").alias("src"), F.col("seq").alias("parent")).join(graph, "src")
        step = step.groupBy(F.col("dst").alias("url")).agg(F.min(F.struct("parent", "seq")).alias("s"))
        step = step.join(seen, "url", "left_anti")
        # The limit comes first, so only its rows are numbered in one task.
        best = step.orderBy("s", "url").limit(max_pages)
        front = best.select("url", F.lit(depth).alias("depth"), F.row_number().over(Window.orderBy("s", "url")).cast("long").alias("seq"))
        seen = seen.unionByName(front)
    first = seen.orderBy("depth", "seq", "url").limit(max_pages)
    return first.withColumn("place", F.row_number().over(Window.orderBy("depth", "seq", "url"))).drop("seq")


def discovery_failed(events: DataFrame) -> DataFrame:
    """One row: whether all searches failed, and whether all of them did with HTTP 202."""
    failed = F.col("status") == "failed"
    return events.agg(F.coalesce(F.bool_and(failed), F.lit(False)).alias("all_failed"), F.coalesce(F.bool_and(failed & (F.col("http_status") == 202)), F.lit(False)).alias("all_challenged"))


def last_error(events: DataFrame) -> DataFrame:
    """Code of the last failed event of each job."""
    return events.groupBy("job_id").agg(F.max_by(F.when(F.col("state") == "failed", F.col("code")), F.when(F.col("state") == "failed", F.col("seq"))).alias("error"))


def tail(events: DataFrame, order: Column, n: int = 500) -> DataFrame:
    """The last ``n`` events."""
    return events.orderBy(order.desc()).limit(n)
