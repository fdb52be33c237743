"""Readers and contract checks of inputs."""

from __future__ import annotations

import csv
import gzip
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions.udf import batched

INDEXABLE = ("review", "verified_against_source")
#: File suffixes and media types that are taken in.
SUFFIXES = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "tiff": "image/tiff", "webp": "image/webp", "html": "text/html", "csv": "text/csv", "json": "application/json", "txt": "text/plain", "md": "text/markdown"}
MAX_JSON = 20_000_000
MAX_TEXT = 600_000
MAX_BODY = 10_000_000


def parsed_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One JSON document a file, indexable ones that have been assessed, with their path."""
    docs = spark.read.schema(schema).option("multiLine", True).json(f"{folder}/*.json").withColumn("parsed_path", F.input_file_name())
    name = F.element_at(F.split("parsed_path", "/"), -1)
    return docs.where(F.col("status").isin(*INDEXABLE) & ~F.startswith(name, F.lit("unassessed-")))


def json_texts(files: DataFrame) -> DataFrame:
    """``files(path, content)`` of JSON bytes: ``path, text, value, error``; the text is the value written anew, the value keeps its structure."""
    body = F.decode(F.col("content"), "UTF-8")
    value = F.try_parse_json(F.regexp_replace(body, "^\ufeff", ""))
    return files.select("path", F.to_json(value).alias("text"), value.alias("value"), F.when(value.isNull(), "not JSON").alias("error"))


PARSER = "docling-local-v1"


def parser_errors(text: Column, pages: Column, parser: Column, config: Column) -> Column:
    """the first way in which a parser's output breaks its contract, null for none."""
    return (
        F.when(F.coalesce(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit("")) == "", "no text")
        .when((F.length(text) > MAX_TEXT) | pages.isNull(), "text or pages out of bounds")
        .when(~parser.eqNullSafe(F.lit(PARSER)) | config.isNull(), "no parser or options")
    )


def cache_key(content: Column, options: str, worker: str) -> Column:
    """The key of a parse: the bytes, the options and the worker's signature."""
    return F.sha2(F.concat(content, F.encode(F.lit(f"{options}|{worker}"), "UTF-8")), 256)


def cached_parses(files: DataFrame, cache: DataFrame, options: str, worker: str) -> DataFrame:
    """``path, document, state`` of ``files(path, content)`` against ``cache(key, sha256, document)``.

    ``state`` is hit, miss, too_large, or changed: a stored document whose
    digest isn't the recorded one is never served.
    """
    keyed = files.select("path", cache_key(F.col("content"), options, worker).alias("key"))
    found = keyed.join(cache.select("key", "sha256", "document"), "key", "left")
    state = F.when(F.col("document").isNull(), "miss").when(F.length("document") > MAX_JSON, "too_large").when(F.sha2("document", 256) != F.col("sha256"), "changed").otherwise("hit")
    return found.select("path", F.when(state == "hit", F.col("document")).alias("document"), state.alias("state"))


#: Fields of a parse that a reviewer keeps.
PARSER_FIELDS = ("text", "html_leads", "html_math", "pages", "tables", "docling_document", "unpaginated_items", "parser", "parser_library_version", "parser_config", "pdf_total_pages", "selected_pages", "parse_partial", "parse_warnings", "coverage_note")


def parser_evidence(docs: DataFrame) -> Column:
    """P10: the structure that a parser found, without paths or decisions of the run."""
    return F.struct(*[F.col(c) for c in PARSER_FIELDS if c in docs.columns])


_META = "struct<page:int,pages:int,total:int,sourceid:string,lastupdated:string>"
_ROW = "array<struct<country:struct<id:string>,countryiso3code:string,indicator:struct<id:string>,date:string,value:double,unit:string>>"


def envelope_rows(payloads: DataFrame) -> DataFrame:
    """S3: ``payloads(series_id, body)`` of ``[meta, rows]`` to rows with their position and the meta fields.

    ``envelope_ok`` is false on every row of a payload that isn't one whole
    page; a payload without readable rows gives one row with null position.
    """
    meta = F.from_json(F.get_json_object("body", "$[0]"), _META)
    rows = F.from_json(F.get_json_object("body", "$[1]"), _ROW)
    p = payloads.select("series_id", meta.alias("meta"), rows.alias("rows"))
    ok = (F.col("meta.page") == 1) & (F.col("meta.pages") == 1) & (F.col("meta.total") == F.size("rows"))
    p = p.withColumn("envelope_ok", F.coalesce(ok, F.lit(False)))
    return p.select("series_id", "envelope_ok", "meta.sourceid", "meta.lastupdated", F.posexplode_outer("rows").alias("position", "r")).select("series_id", "envelope_ok", "sourceid", "lastupdated", "position", F.col("r.country.id").alias("country"), F.col("r.countryiso3code").alias("iso3"), F.col("r.indicator.id").alias("indicator"), "r.date", "r.value", "r.unit")


def metadata_ok(rows: DataFrame) -> Column:
    """First check of D2: the dataset's source and date of update."""
    return F.coalesce((F.col("sourceid") == "2") & (F.coalesce(F.col("lastupdated"), F.lit("")) != ""), F.lit(False))


def xml_rows(payloads: DataFrame) -> DataFrame:
    """The XML twin of :func:`envelope_rows`, in the namespace prefix ``wb``."""
    plain = F.regexp_replace(F.regexp_replace("body", r"^[\s﻿]*<\?xml[^>]*\?>", ""), r"(</?)wb:", "$1")
    plain = F.regexp_replace(plain, r"\sxmlns(:\w+)?=\"[^\"]*\"", "")
    x = payloads.select("series_id", plain.alias("x"))
    paths = {"country": "data/data/country/@id", "iso3": "data/data/countryiso3code/text()", "indicator": "data/data/indicator/@id", "date": "data/data/date/text()"}
    n = F.expr("cast(xpath_number(x, 'count(data/data)') as int)")
    ok = F.expr("xpath_int(x, 'data/@page') = 1 and xpath_int(x, 'data/@pages') = 1 and xpath_int(x, 'data/@total') = xpath_int(x, 'count(data/data)')")
    cols = [F.expr(f"xpath(x, '{p}')").alias(c) for c, p in paths.items()]
    rows = x.withColumn("n", n).where("n > 0").select("series_id", ok.alias("envelope_ok"), F.col("x"), *cols, F.posexplode(F.sequence(F.lit(1), F.col("n"))).alias("position", "i"))
    # One value element for each row, so values are read by position.
    got = F.regexp_extract_all("x", F.lit(r"<value(?:\s*/>|[^>]*>([^<]*)</value>)"), 1)
    return rows.select("series_id", "envelope_ok", "position", *[F.get(c, F.col("position")).alias(c) for c in paths], F.get(got, F.col("position")).try_cast("double").alias("value"))


@batched("struct<rows:array<array<string>>,error:string>")
def csv_table(text: pd.Series) -> pd.Series:
    """Rows of strings; the dialect is found from the first 8192 characters; ragged, empty or overlong tables are errors."""

    def one(x: str | None) -> dict:
        body = (x or "").removeprefix("﻿")
        try:
            dialect = csv.Sniffer().sniff(body[:8192], ",;\t|")
        except csv.Error:
            dialect = csv.excel
        try:
            rows = [r for r in csv.reader(body.splitlines(keepends=True), dialect) if r]
        except csv.Error as e:
            return {"rows": None, "error": str(e)}
        if not 1 <= len(rows) <= 10_000:
            return {"rows": None, "error": "row count out of range"}
        if len({len(r) for r in rows}) != 1:
            return {"rows": None, "error": "rows differ in length"}
        return {"rows": rows, "error": None}

    return pd.Series([one(x) for x in text], dtype=object)


def decoded_body(encoding: Column | str, body: Column | str, limit: int = MAX_BODY) -> Column:
    """Gzip or identity bodies; the size bound holds before and after decoding.

    A missing body stays missing.  Gzip without a single member, not even an
    empty one, is damaged.
    """

    @batched("struct<body:binary,error:string>")
    def decoded(encoding: pd.Series, body: pd.Series) -> pd.Series:
        def one(kind: str | None, raw: bytes | None) -> dict:
            kind = (kind or "identity").lower()
            try:
                if kind == "gzip":
                    if not raw:
                        raise EOFError
                    out = gzip.decompress(raw) if len(raw) <= limit and _gzip_size(raw, limit) <= limit else None
                elif kind == "identity":
                    if raw is None:
                        return {"body": None, "error": None}
                    out = raw
                else:
                    return {"body": None, "error": "unknown encoding"}
            except (OSError, EOFError, zlib.error):
                return {"body": None, "error": "damaged body"}
            if out is None or len(out) > limit:
                return {"body": None, "error": "body too large"}
            return {"body": out, "error": None}

        return pd.Series([one(k, b) for k, b in zip(encoding, body, strict=True)], dtype=object)

    return decoded(encoding, body)


def _gzip_size(raw: bytes, limit: int) -> int:
    """Decoded size, counted in steps and at most one step beyond the bound."""
    total, rest = 0, raw
    while rest:
        d = zlib.decompressobj(31)
        while not d.eof:
            piece = d.decompress(rest, 1 << 20)
            rest = d.unconsumed_tail
            total += len(piece)
            if total > limit or not (piece or rest):
                break
        if total > limit or not d.eof:
            break
        rest = d.unused_data
    return total


def content_kind(content: Column, declared: Column, url: Column) -> Column:
    """The kind of a body: PDF by its first bytes, else by type, and by the URL's suffix where the type says little."""
    suffix = F.lower(F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    suffix = F.when(suffix == "jpeg", "jpg").otherwise(suffix)
    kind = F.lower(F.trim(F.element_at(F.split(F.coalesce(declared, F.lit("")), ";"), 1)))
    known = F.create_map(*[F.lit(x) for s, m in SUFFIXES.items() if s != "jpeg" for x in (m, s)])
    vague = kind.isin("", "application/octet-stream", "text/plain") & suffix.isin(*SUFFIXES)
    return F.when(F.substring(content, 1, 5) == F.lit(b"%PDF-"), "pdf").when(vague, suffix).otherwise(F.try_element_at(known, kind))


def upload_type(name: Column, content: Column) -> Column:
    """Media type of an upload; null for unknown suffixes, and where the PDF suffix and bytes disagree."""
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    pdf = F.substring(content, 1, 5) == F.lit(b"%PDF-")
    table = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    return F.when(pdf == (suffix == "pdf"), F.try_element_at(table, suffix))


def parser_route(kind: Column, mode: str, layout_installed: bool) -> Column:
    """The layout parser for formats that need one, the native parser for the others; null where none applies."""
    office = kind.isin("docx", "pptx", "xlsx", "png", "jpg", "tiff", "webp")
    layout = F.lit("layout") if layout_installed else F.lit(None).cast("string")
    if mode == "layout":
        return F.when(office | (kind == "pdf"), layout).otherwise("native")
    if mode == "native":
        return F.when(office, F.lit(None)).otherwise("native")
    return F.when(office, layout).when(kind == "pdf", F.coalesce(layout, F.lit("native"))).otherwise("native")


Parser = Callable[[DataFrame], DataFrame]


def routed(files: DataFrame, parsers: dict[str, tuple[tuple[str, ...], Parser]]) -> DataFrame:
    """``path, route, text`` of ``files(path, content, kind)``: each row by the parser that is registered for its kind.

    ``parsers`` maps a route to its kinds and to a function from files to
    ``path, text``; a kind of several routes takes the first, and rows of none
    come back without a route.
    """
    taken = F.coalesce(*[F.when(F.col("kind").isin(*kinds), F.lit(name)) for name, (kinds, _) in parsers.items()], F.lit(None).cast("string"))
    dealt = files.withColumn("route", taken)
    out = dealt.where("route is null").select("path", "route", F.lit(None).cast("string").alias("text"))
    for name, (_, parse) in parsers.items():
        own = parse(dealt.where(F.col("route") == name))
        out = out.unionByName(own.select("path", F.lit(name).alias("route"), "text"))
    return out


def text_upload(content: Column) -> Column:
    """Strict UTF-8 text without a byte order mark; null for other bytes."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.regexp_replace(F.decode(content, "utf-8"), "^\\x{FEFF}", ""))


def pinned_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """``country_iso3, indicator_id, source_id, year, value`` of a file with a map from year to value."""
    raw = spark.read.option("multiLine", True).schema("country_iso3 string, indicator_id string, source_id string, `values` map<string,bigint>").json(path)
    return raw.select("country_iso3", "indicator_id", "source_id", F.explode("values").alias("year", "value")).withColumn("year", F.col("year").cast("int"))


def safe_json(body: Column, schema: str) -> Column:
    """The parsed value, or null for torn or overlong JSON."""
    return F.when(F.octet_length(body) <= MAX_JSON, F.from_json(body, schema, {"mode": "PERMISSIVE"}))


def already_imported(found: DataFrame, imported: DataFrame) -> DataFrame:
    """Rows whose path and raw digest are both new."""
    return found.join(imported.select("parsed_path").distinct(), "parsed_path", "left_anti").join(imported.select("raw_sha256").distinct(), "raw_sha256", "left_anti")


def size_flags(text: Column, body: Column) -> Column:
    """which limits an input exceeds."""
    return F.array_compact(F.array(F.when(F.length(text) > MAX_TEXT, "text"), F.when(F.octet_length(body) > MAX_BODY, "body")))


def plan_violations(plans: DataFrame) -> DataFrame:
    """``plans`` with ``violations`` of the plan's contract.

    Reads ``concepts, queries, country, start_year, end_year, brief_start,
    brief_end, denominator, brief``; texts of the last two are folded.
    """
    c = F.col("concepts")
    groups = F.size(c).between(1, 6) & F.forall(c, lambda g: F.size(g).between(1, 8) & F.forall(g, lambda a: F.length(a) >= 3))
    queries = F.size("queries").between(1, 3) & F.forall("queries", lambda q: ~F.contains(q, F.lit("://")))
    years = F.col("start_year").eqNullSafe(F.col("brief_start")) & F.col("end_year").eqNullSafe(F.col("brief_end"))
    checks = [("concepts", groups), ("queries", queries), ("country", F.col("country").isNull() | F.col("country").rlike("^[A-Z]{2}$")), ("years", years), ("denominator", F.col("denominator").isNull() | F.contains("brief", F.col("denominator")))]
    return plans.withColumn("violations", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks])))
