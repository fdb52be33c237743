"""Text, URL, JSON and date queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import text as T
from evidra.functions import urls as U
from evidra.functions.secrets import forms, mask_known
from evidra.plans.registry import query, sql_fold
from evidra.session import table, texts
from evidra.sources import sinks

CONCEPTS = [["thea", "theanes"], ["ontion"], ["der", "und"], ["leaux"]]
PLAN = ["thea", "ontion", "nneverx", "ing"]


@query(f"SELECT doc_id, sha256({sql_fold('text')}) AS folded FROM documents")
def fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", F.sha2(T.fold(F.col("text")), 256).alias("folded"))


@query(f"SELECT doc_id, sha256(trim(regexp_replace({sql_fold('text')}, '\\s+', ' ', 'g'))) AS folded FROM documents")
def fold_squeezed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", F.sha2(T.squeeze(T.fold(F.col("text"))), 256).alias("folded"))


@query(f"SELECT item_id, array_to_string(regexp_extract_all({sql_fold('text')}, '[\\p{{L}}\\p{{N}}_]+')[:40], ' ') AS terms, CAST(least(len(list_distinct(regexp_extract_all({sql_fold('text')}, '[\\p{{L}}\\p{{N}}_]+'))), 24) AS INTEGER) AS n_distinct FROM benchmark")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = T.fold(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.query_terms(f), " ").alias("terms"), F.size(T.query_terms(f, 24, distinct=True)).alias("n_distinct"))


@query(
    f"""WITH t AS (SELECT item_id, unnest(regexp_extract_all({sql_fold('text')}, '[a-z0-9]+')) AS term, generate_subscripts(regexp_extract_all({sql_fold('text')}, '[a-z0-9]+'), 1) AS k FROM benchmark),
f AS (SELECT item_id, term, min(k) AS k FROM t WHERE length(term) >= 3 AND term NOT IN ('lieu', 'thu', 'thap', 'theo', 'tung', 'nam', 'giai', 'doan', 'thong', 'ke', 'nguon', 'chinh', 'thuc') GROUP BY item_id, term)
SELECT item_id, string_agg(term, ' ' ORDER BY k) AS terms FROM f GROUP BY item_id"""
)
def plan_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.plan_terms(T.fold(F.col("text"))), " ").alias("terms")).where("terms <> ''")


@query(
    """WITH t AS (SELECT o_orderkey, unnest(regexp_extract_all('due ' || strftime(o_orderdate, '%Y-%m-%d') || ' from ' || CAST(year(o_orderdate) - 1 AS VARCHAR) || ' ref ' || CAST(o_orderkey AS VARCHAR), '\\b((?:19|20)\\d{2})\\b', 1)) AS y FROM orders)
SELECT o_orderkey, string_agg(DISTINCT y, ',' ORDER BY y) AS years FROM t GROUP BY o_orderkey"""
)
def year_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("due "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" from "), (F.year("o_orderdate") - 1).cast("string"), F.lit(" ref "), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(T.years(text), ",").alias("years"))


def _sql_any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(f, '{w}')" for w in words) + ")"


@query(
    f"""SELECT doc_id, CAST(CASE WHEN contains(f, 'dan so') OR contains(f, 'population') THEN 4 ELSE 0 END + CASE WHEN contains(f, 'viet nam') OR contains(f, 'vietnam') OR contains(f, 'vnm') THEN 3 ELSE 0 END
+ least({" + ".join(f"CAST(contains(f, '{t}') AS INTEGER)" for t in PLAN)}, 4) AS INTEGER) AS relevance,
CAST(round_even(10.0 * ({" + ".join(f"CAST({_sql_any(g)} AS INTEGER)" for g in CONCEPTS)}) / {len(CONCEPTS)}, 0) AS INTEGER) AS concept_score
FROM (SELECT doc_id, {sql_fold('text')} AS f FROM documents)"""
)
def relevance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir).select("doc_id", T.fold(F.col("text")).alias("f"))
    return d.select("doc_id", T.relevance(F.col("f"), "population", "VN", PLAN).alias("relevance"), T.concept_score(F.col("f"), CONCEPTS).alias("concept_score"))


_HOST = "lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))"


@query(
    """WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages), q AS (SELECT page_id, split_part(u, '?', 1) AS base, CASE WHEN contains(u, '?') THEN string_split(substr(u, strpos(u, '?') + 1), '&') ELSE [] END AS parts FROM p)
SELECT page_id, CASE WHEN regexp_matches(base, '^[a-z]+://[^/]+$') THEN base || '/' ELSE base END || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END AS url
FROM (SELECT page_id, base, list_sort(list_filter(parts, lambda x: NOT (starts_with(lower(x), 'utm_') OR starts_with(lower(x), 'fbclid=') OR starts_with(lower(x), 'gclid=')))) AS k FROM q)"""
)
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.canonical_url("url").alias("url"))


@query(
    f"""SELECT page_id, h AS host, CASE WHEN h = 'worldbank.org' OR ends_with(h, '.worldbank.org') OR ends_with(h, '.gov.vn') OR ends_with(h, '.gov') THEN 4
WHEN h IN ('un.org', 'unodc.org', 'who.int', 'oecd.org') OR regexp_matches(h, '\\.(un\\.org|unodc\\.org|who\\.int|oecd\\.org)$') THEN 3 ELSE 0 END AS priority, true AS is_public
FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'data.worldbank.org' WHEN 1 THEN 'worldbank.org.evil.example' WHEN 2 THEN 'www.gso.gov.vn' WHEN 3 THEN 'fakegov.vn' WHEN 4 THEN 'unstats.un.org' ELSE {_HOST} END AS h FROM pages)"""
)
def source_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-alike hosts score 0."""
    hosts = ["data.worldbank.org", "worldbank.org.evil.example", "www.gso.gov.vn", "fakegov.vn", "unstats.un.org"]
    url = F.col("url")
    for i, h in enumerate(hosts):
        url = F.when(F.col("page_id") % 6 == i, F.concat(F.lit(f"https://{h}/x?id="), F.col("page_id").cast("string"))).otherwise(url)
    p = table(spark, sf_dir, "pages").select("page_id", url.alias("u"))
    return p.select("page_id", U.host(F.col("u")).alias("host"), U.source_priority(F.col("u")).alias("priority"), U.public_url(F.col("u")).alias("is_public"))


@query(
    r"""SELECT conv_id, turn, substr(regexp_replace('token=k' || CAST(conv_id * 100 + turn AS VARCHAR) || ' Bearer abc' || CAST(conv_id * 100 + turn AS VARCHAR) || ' said ' || text,
'(bearer\s+|(?:api[_-]?key|token|password|secret)\s*[=:]\s*)[^\s&,;]+', '\1[MASKED]', 'gi'), 1, 1200) AS masked FROM conversations"""
)
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two secrets in front of each whole text, which is searched too."""
    key = (F.col("conv_id") * 100 + F.col("turn")).cast("string")
    text = F.concat(F.lit("token=k"), key, F.lit(" Bearer abc"), key, F.lit(" said "), "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.redact_secrets(text).alias("masked"))


#: Secrets that the two queries below hide in real texts and addresses, with signs that quoting changes; one begins like another.
HIDDEN = ("a/b+c d&é=1", "k-9%~x y", "k-9%~x yz", "s3cret/zz")
_HIDDEN_FORMS = [f for s in HIDDEN for f in forms(s)]
_SHOWN_FORMS = sorted(set(_HIDDEN_FORMS), key=len, reverse=True)


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _form(at: str) -> str:
    """SQL for the form that row ``at`` hides."""
    return f"list_extract([{', '.join(map(_literal, _HIDDEN_FORMS))}], CAST({at} % {len(_HIDDEN_FORMS)} AS INTEGER) + 1)"


def _without(text: str) -> str:
    """SQL that masks all forms, the longest first."""
    for f in _SHOWN_FORMS:
        text = f"replace({text}, {_literal(f)}, '[MASKED]')"
    return text


def _hidden(at: Column) -> Column:
    return F.get(F.array(*map(F.lit, _HIDDEN_FORMS)), (at % len(_HIDDEN_FORMS)).cast("int"))


@query(
    f"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS x, {_form("(conv_id * 3 + turn)")} AS f FROM conversations)
SELECT conv_id, turn, {_without("x[:length(x) // 2] || f || x[length(x) // 2 + 1:] || f")} AS masked FROM t"""
)
def redact_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole text hides a secret in its middle and at its end, in one of all forms; none is left."""
    at, x = F.col("conv_id") * 3 + F.col("turn"), F.coalesce("text", F.lit(""))
    half = F.floor(F.length(x) / 2).cast("int")
    hidden = F.concat(F.substring(x, F.lit(1), half), _hidden(at), F.substring(x, half + 1, F.length(x)), _hidden(at))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", mask_known(hidden, HIDDEN).alias("masked"))


@query(
    rf"""SELECT page_id, {_without(f"regexp_extract(url, '^https?://[^/?#]+') || '/' || {_form('page_id')} || '/x'")} || '?page=' || CAST(page_id AS VARCHAR) || '&token=%5BMASKED%5D' AS safe
FROM pages WHERE regexp_matches(url, '^https?://[a-z0-9.-]+(/|$)')"""
)
def safe_known_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A secret in the path of each page's address; such a path keeps no part of it, and a credential parameter none of its value."""
    pages = table(spark, sf_dir, "pages").where(F.col("url").rlike("^https?://[a-z0-9.-]+(/|$)"))
    # A question mark or a hash sign would end the path, and no form has one.
    url = F.concat(F.regexp_extract("url", "^https?://[^/?#]+", 0), F.lit("/"), _hidden(F.col("page_id")), F.lit("/x?page="), F.col("page_id").cast("string"), F.lit("&token=t#f"))
    return pages.select("page_id", U.safe_url(url, HIDDEN).alias("safe"))


@query("SELECT page_id, 'https://api.example.org/v2/data?id=' || CAST(page_id AS VARCHAR) || '&api_key=%5BMASKED%5D&Session_Token=%5BMASKED%5D' AS safe FROM pages")
def redact_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id").cast("string")
    url = F.concat(F.lit("https://user:pw@api.example.org/v2/data?id="), p, F.lit("&api_key=s"), p, F.lit("&Session_Token=t"), p, F.lit("#frag"))
    return table(spark, sf_dir, "pages").select("page_id", U.safe_url(url).alias("safe"))


@query("SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) >= 50")
def json_status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter on a field inside JSON (F18, JS1)."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", "event_type", k.alias("k")).where("k >= 50")


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def summary_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists without the heavy columns; the scan doesn't read them."""
    return table(spark, sf_dir, "documents").drop("text")


@query(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'none' END AS day FROM orders"""
)
def canonical_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the strict form is a date; short months, compact forms and week dates aren't."""
    d = F.col("o_orderdate")
    forms = [F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "yyyyMMdd"), F.concat(F.date_format(d, "yyyy"), F.lit("-1-1")), F.concat(F.date_format(d, "yyyy"), F.lit("-W01-1"))]
    text = F.element_at(F.array(*forms), (F.col("o_orderkey") % 4).cast("int") + 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(T.canonical_date(text).cast("string"), F.lit("none")).alias("day"))


@query(
    """WITH n AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY o_custkey), o AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN k END AS k FROM customer LEFT JOIN n ON o_custkey = c_custkey)
SELECT c_custkey AS url, coalesce(k, -1) AS version FROM o"""
)
def snapshot_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4, K5: the last row of each key replaces the old snapshot's row."""
    new = table(spark, sf_dir, "orders").where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("url"), F.col("o_orderkey").alias("version"))
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("url"), F.lit(-1).cast("long").alias("version"))
    return sinks.upsert(old, sinks.last_wins(new, ["url"], "version"), ["url"])


_DIGEST = "sha256(CAST(doc_id AS VARCHAR) || chr(31) || text)"


@query(
    f"""SELECT count(*) AS rows, sha256({" || '|' || ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8))}) AS digest
FROM (SELECT {_DIGEST} AS h FROM documents)"""
)
def table_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: a digest that doesn't depend on row order."""
    return sinks.manifest(texts(spark, sf_dir), ["doc_id", "text"])
