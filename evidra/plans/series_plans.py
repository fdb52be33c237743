"""Time-series and lineage queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.operators import lineage as L
from evidra.operators import series as S
from evidra.plans.registry import query
from evidra.session import table
from evidra.sources import readers as R

START, END = 1995, 2001
#: Orders of each priority by year as an observation series; some rows are spoilt as a function of their place.
_ROWS = """y AS (SELECT o_orderpriority AS series_id, year(o_orderdate) AS year, CAST(count(*) AS DOUBLE) AS value FROM orders WHERE NOT (o_orderpriority LIKE '4%' AND year(o_orderdate) = 1999) GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY year DESC) - 1 AS position FROM y),
r AS (SELECT series_id, position, year, CASE WHEN series_id LIKE '1%' AND position = 2 THEN 'XX' ELSE 'VN' END AS country,
  CASE WHEN series_id LIKE '2%' AND position = 1 THEN year + 1 ELSE year END AS date, CASE WHEN series_id LIKE '3%' AND position = 3 THEN value + 0.5 ELSE value END AS value FROM p)"""


def _years(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series_id"), F.year("o_orderdate").alias("year"))
    o = o.where(~(F.startswith("series_id", F.lit("4")) & (F.col("year") == 1999)))
    return o.groupBy("series_id", "year").agg(F.count("*").cast("double").alias("value"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    p = _years(spark, sf_dir).withColumn("position", F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("year"))) - 1)
    starts = lambda s: F.startswith(F.col("series_id"), F.lit(s))
    pos = F.col("position")
    return p.select(
        "series_id",
        "position",
        F.when(starts("1") & (pos == 2), "XX").otherwise("VN").alias("country"),
        F.lit("VNM").alias("iso3"),
        F.lit("ORDERS").alias("indicator"),
        F.lit("VN").alias("expected_country"),
        F.lit("VNM").alias("expected_iso3"),
        F.lit("ORDERS").alias("expected_indicator"),
        F.when(starts("2") & (pos == 1), F.col("year") + 1).otherwise(F.col("year")).cast("string").alias("date"),
        F.when(starts("3") & (pos == 3), F.col("value") + 0.5).otherwise(F.col("value")).alias("value"),
    )


_VIOLATIONS = f"""{_ROWS}, n AS (SELECT *, row_number() OVER (PARTITION BY series_id, date ORDER BY position) > 1 AS again FROM r),
j AS (SELECT *, CASE WHEN country <> 'VN' THEN 'COUNTRY_MISMATCH' WHEN date NOT BETWEEN {START} AND {END} THEN 'OUT_OF_SCOPE_YEAR' WHEN again THEN 'DUPLICATE_YEAR' WHEN value < 0 OR value <> floor(value) THEN 'INVALID_VALUE' END AS code FROM n),
v AS (SELECT series_id, code, '$[1][' || CAST(position AS VARCHAR) || ']' || CASE code WHEN 'COUNTRY_MISMATCH' THEN '.country' WHEN 'INVALID_VALUE' THEN '.value' ELSE '.date' END AS locator FROM j WHERE code IS NOT NULL
  UNION ALL SELECT series_id, 'MISSING_YEARS', '$[1]' FROM j GROUP BY series_id HAVING count(code) = 0 AND count(DISTINCT date) < {END - START + 1})"""


@query(f"WITH {_VIOLATIONS} SELECT series_id, code, locator FROM v")
def series_gate_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.check_series(_rows(spark, sf_dir), START, END, "population").select("series_id", "code", "locator")


@query(f"WITH {_VIOLATIONS} SELECT series_id, min_by(code, locator) AS code, min(locator) AS locator FROM v GROUP BY series_id")
def series_first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.first_errors(S.check_series(_rows(spark, sf_dir), START, END, "population")).select("series_id", "code", "locator")


@query(f"WITH {_VIOLATIONS} SELECT series_id, date AS year, value, '$[1][' || CAST(position AS VARCHAR) || ']' AS raw_locator FROM r WHERE series_id NOT IN (SELECT series_id FROM v)")
def series_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return S.accepted(rows, S.check_series(rows, START, END, "population"))


@query(f"WITH {_ROWS}, d AS (SELECT DISTINCT series_id FROM y) SELECT series_id, coalesce(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k), '') AS missing FROM (SELECT series_id, k, (series_id, k) IN (SELECT series_id, year FROM y) AS have FROM d, range({START}, {END + 2}) t(k)) WHERE NOT have GROUP BY series_id")
def series_missing_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = S.missing_years(_years(spark, sf_dir), START, END + 1)
    return m.where(F.size("missing") > 0).select("series_id", F.array_join(F.transform("missing", lambda y: y.cast("string")), ",").alias("missing"))


@query(f"WITH {_ROWS} SELECT series_id, year, CASE WHEN series_id LIKE '5%' THEN 'only_left' ELSE 'differs' END AS mismatch FROM y WHERE series_id LIKE '5%' OR year = 1997")
def series_crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _years(spark, sf_dir)
    b = a.where(~F.startswith("series_id", F.lit("5"))).withColumn("value", F.when(F.col("year") == 1997, F.col("value") + 1).otherwise(F.col("value")))
    return S.cross_check(a, b, ["series_id", "year"], "value").select("series_id", "year", "mismatch")


@query(f"WITH {_ROWS} SELECT series_id, max(value) FILTER (WHERE year = {END}) - max(value) FILTER (WHERE year = {START}) AS delta FROM y GROUP BY series_id")
def series_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.delta(_years(spark, sf_dir), START, END)


@query("SELECT o_orderpriority AS series_id, CAST(CASE WHEN o_orderpriority LIKE '1%' THEN 2 ELSE 1 END AS BIGINT) AS n_sources, NOT o_orderpriority LIKE '1%' AS accepted FROM orders GROUP BY o_orderpriority")
def series_single_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _years(spark, sf_dir).withColumns({"raw_path": F.lit("raw.json"), "raw_sha256": F.when(F.startswith("series_id", F.lit("1")) & (F.col("year") == 1996), "b").otherwise("a")})
    return S.single_source(rows)


@query("SELECT o_orderpriority AS series_id, true AS rejected FROM orders GROUP BY o_orderpriority")
def series_negative_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.negative_control(_rows(spark, sf_dir), START, END)


@query(
    "SELECT o_orderpriority AS series_id, true AS envelope_ok, CAST(count(*) AS INTEGER) AS n, CAST(sum(v) AS DOUBLE) AS total FROM (SELECT o_orderpriority, count(*) AS v FROM orders GROUP BY o_orderpriority, year(o_orderdate)) GROUP BY o_orderpriority"
)
def envelope_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of meta and rows are built from orders and read back (S3)."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), F.year("o_orderdate").cast("string").alias("date")).agg(F.count("*").cast("double").alias("value"))
    rows = o.groupBy("series_id").agg(F.collect_list(F.struct(F.struct(F.lit("VN").alias("id")).alias("country"), F.lit("VNM").alias("countryiso3code"), "date", "value")).alias("rows"))
    meta = F.struct(F.lit(1).alias("page"), F.lit(1).alias("pages"), F.size("rows").alias("total"), F.lit("2").alias("sourceid"), F.lit("2026-07-13").alias("lastupdated"))
    body = F.concat(F.lit("["), F.to_json(meta), F.lit(","), F.to_json("rows"), F.lit("]"))
    found = R.envelope_rows(rows.select("series_id", body.alias("body")))
    return found.groupBy("series_id", "envelope_ok").agg(F.count("*").cast("int").alias("n"), F.sum("value").alias("total"))


@query("SELECT o_orderpriority AS series_id, true AS envelope_ok, CAST(count(*) AS INTEGER) AS n, CAST(sum(v) AS DOUBLE) AS total FROM (SELECT o_orderpriority, count(*) AS v FROM orders GROUP BY o_orderpriority, year(o_orderdate)) GROUP BY o_orderpriority")
def xml_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The XML twin of the payloads."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), F.year("o_orderdate").cast("string").alias("date")).agg(F.count("*").cast("string").alias("value"))
    row = F.concat(F.lit('<wb:data><wb:indicator id="ORDERS">o</wb:indicator><wb:country id="VN">v</wb:country><wb:countryiso3code>VNM</wb:countryiso3code><wb:date>'), "date", F.lit("</wb:date><wb:value>"), "value", F.lit("</wb:value></wb:data>"))
    body = o.groupBy("series_id").agg(F.collect_list(row).alias("r"))
    xml = F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?><wb:data page="1" pages="1" total="'), F.size("r").cast("string"), F.lit('" xmlns:wb="http://www.worldbank.org">'), F.array_join("r", ""), F.lit("</wb:data>"))
    return R.xml_rows(body.select("series_id", xml.alias("body"))).groupBy("series_id", "envelope_ok").agg(F.count("*").cast("int").alias("n"), F.sum("value").alias("total"))


#: A document is made from its source's crawl, a chunk from the document; ids are a function of the tables.
_EDGES = "e AS (SELECT 'scope' AS parent, 'crawl-' || source AS child FROM (SELECT DISTINCT source FROM documents) UNION ALL SELECT 'crawl-' || source, 'doc-' || CAST(doc_id AS VARCHAR) FROM documents UNION ALL SELECT 'doc-' || CAST(doc_id AS VARCHAR), 'chunk-' || CAST(doc_id AS VARCHAR) FROM documents UNION ALL SELECT 'scope', 'doc-' || CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 2 = 0)"


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("i"), "doc_id", "source")
    none = F.array().cast("array<string>")
    crawl = F.concat(F.lit("crawl-"), F.col("source"))
    scope = d.limit(1).select(F.lit("scope").alias("id"), none.alias("parents"))
    crawls = d.select(crawl.alias("id"), F.array(F.lit("scope")).alias("parents")).distinct()
    docs = d.select(F.concat(F.lit("doc-"), "i").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.array(crawl, F.lit("scope"))).otherwise(F.array(crawl)).alias("parents"))
    chunks = d.select(F.concat(F.lit("chunk-"), "i").alias("id"), F.array(F.concat(F.lit("doc-"), "i")).alias("parents"))
    return scope.unionByName(crawls).unionByName(docs).unionByName(chunks)


@query(f"WITH RECURSIVE {_EDGES}, up(seed, node) AS (SELECT 'chunk-' || CAST(doc_id AS VARCHAR), 'chunk-' || CAST(doc_id AS VARCHAR) FROM documents UNION SELECT seed, parent FROM up JOIN e ON child = node) SELECT seed, node FROM up")
def lineage_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk is a seed."""
    seeds = table(spark, sf_dir, "documents").select(F.concat(F.lit("chunk-"), F.col("doc_id").cast("string")).alias("seed"))
    return L.ancestors(_nodes(spark, sf_dir), seeds)


@query(f"WITH RECURSIVE {_EDGES}, down(seed, node) AS (SELECT 'crawl-src1', 'crawl-src1' UNION SELECT seed, child FROM down JOIN e ON parent = node) SELECT seed, node FROM down WHERE seed <> node")
def lineage_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.descendants(_nodes(spark, sf_dir), spark.createDataFrame([("crawl-src1",)], "seed string"))


@query(
    """SELECT event_id, code, CASE code WHEN 'AUTH_FAILED' THEN 'search' WHEN 'MISSING_YEARS' THEN 'discovery' WHEN 'INVALID_VALUE' THEN 'parse' WHEN 'SOURCE_REVISION' THEN 'check' ELSE event_type END AS restart_from
FROM (SELECT event_id, event_type, CASE event_id % 5 WHEN 0 THEN 'AUTH_FAILED' WHEN 1 THEN 'MISSING_YEARS' WHEN 2 THEN 'INVALID_VALUE' WHEN 3 THEN 'SOURCE_REVISION' ELSE 'OTHER' END AS code FROM events)"""
)
def remediation_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    code = F.when(k == 0, "AUTH_FAILED").when(k == 1, "MISSING_YEARS").when(k == 2, "INVALID_VALUE").when(k == 3, "SOURCE_REVISION").otherwise("OTHER")
    issues = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("stage"), code.alias("code"))
    return L.remediation(issues).select("event_id", "code", "restart_from")


@query("SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'missing' WHEN doc_id % 9 = 1 THEN 'changed' ELSE 'intact' END AS provenance FROM documents")
def lineage_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest recorded digest of a path counts."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    first = d.where("doc_id % 9 <> 0").select("path", F.when(F.col("doc_id") % 9 == 1, F.col("sha256")).otherwise("old").alias("sha256"), F.lit(1).alias("seq"))
    second = d.where("doc_id % 9 <> 0").select("path", F.when(F.col("doc_id") % 9 == 1, "new").otherwise(F.col("sha256")).alias("sha256"), F.lit(2).alias("seq"))
    return L.latest_artifact(first.unionByName(second), d).select("doc_id", "provenance")
