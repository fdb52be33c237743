"""Documents: plans, segments, reading order, alignment, fidelity, import."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidra.functions.text import COUNTRIES, STOP_TERMS, TOPICS, compatible
from evidra.functions.udf import batched
from evidra.operators.chunks import characters, split

ENGLISH = {"VN": "Vietnam", "US": "United States", "JP": "Japan", "FR": "France"}
#: Words that make a brief statistical, and the two kinds of added search words.
STATISTICAL = r"\b(?:ti le|ty le|so luong|so vu|thong ke|chi so|dataset|statistics|rate)\b"
ADDED = {True: (" số liệu thống kê", " dataset csv"), False: (" giáo trình giải thích", " tài liệu PDF")}


class ScopeError(ValueError):
    """A brief that no plan can be made of."""


@dataclass(frozen=True)
class Plan:
    brief: str
    subject: str
    topic: str | None
    country: str | None
    start_year: int | None
    end_year: int | None
    statistical: bool
    queries: list[str]
    terms: list[str] = field(default_factory=list)


def plan_scope(brief: str) -> Plan:
    """What a brief asks for; vague, overlong and overwide briefs are errors."""
    text = compatible(pd.Series([brief])).iloc[0]
    if len(brief.strip()) < 2 or len(brief) > 8000 or re.fullmatch(r"(?:de|bai) [a-z0-9]{1,2}", text):
        raise ScopeError("the brief names no subject or is too long")
    years = sorted({int(y) for y in re.findall(r"\b(?:19|20)\d{2}\b", brief)})
    if years and years[-1] - years[0] > 30:
        raise ScopeError("the brief spans more than 31 years")
    pick = lambda table: next((k for k, names in table.items() if any(n in text for n in names)), None)
    topic, country = pick(TOPICS), pick(COUNTRIES)
    subject = re.split(r"[.!?\n]", brief)[0].strip()
    statistical = bool(years) or re.search(STATISTICAL, text) is not None
    search = subject
    if topic and country:
        search = " ".join([ENGLISH[country], topic, *dict.fromkeys(str(y) for y in (years[:1] + years[-1:]))])
    known, files = ADDED[statistical]
    terms = [w for w in re.findall(r"[a-z0-9]+", text) if len(w) >= 3 and w not in STOP_TERMS]
    return Plan(brief, subject, topic, country, years[0] if years else None, years[-1] if years else None, statistical, list(dict.fromkeys([search, subject + known, search + files])), list(dict.fromkeys(terms)))


def segments(windows: DataFrame, size: int = 1500) -> DataFrame:
    """``doc_id, id, start, end, text``: the lines of inspected windows in pieces of ``size`` characters.

    ``windows(doc_id, start, text)``; blank pieces are left out, ids count
    from 0 in order of place, offsets are code points of the document.
    """
    lines = windows.select("doc_id", F.col("start").alias("w"), F.posexplode(F.split("text", "\n")).alias("k", "line"))
    # Each line begins behind the ones before it and their newlines: a running sum along the window.
    before = Window.partitionBy("doc_id", "w").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("at", F.col("w") + F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0))).where("line <> ''")
    pieces = lines.select("doc_id", "at", "line", F.explode(F.sequence(F.lit(0), F.length("line") - 1, F.lit(size))).alias("o"))
    pieces = pieces.select("doc_id", (F.col("at") + F.col("o")).cast("int").alias("start"), F.expr(f"substring(line, o + 1, {size})").alias("text"))
    pieces = pieces.where(F.col("text").rlike(r"(?U)\S")).withColumn("end", F.col("start") + F.length("text"))
    return pieces.withColumn("id", F.row_number().over(Window.partitionBy("doc_id").orderBy("start")) - 1).select("doc_id", "id", "start", "end", "text")


def reading_order(items: DataFrame) -> DataFrame:
    """``doc_id, page, text, items`` of ``items(doc_id, page, seq, ref, label, text)``.

    Items of a page are joined by blank lines and keep their offsets, which a
    running sum gives; items without a page are never given one and come under
    a null page.  One page is read in one task.
    """
    before = Window.partitionBy("doc_id", "page").orderBy("seq", "ref", "label", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = items.where(F.trim("text") != "").withColumn("char_start", F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0)).cast("int"))
    row = F.struct("char_start", "text", "ref", "label", (F.col("char_start") + F.length("text")).alias("char_end"))
    pages = placed.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(row)).alias("r"))
    kept = F.transform("r", lambda x: F.struct(x["ref"].alias("ref"), x["label"].alias("label"), x["char_start"].alias("char_start"), x["char_end"].alias("char_end")))
    return pages.select("doc_id", "page", F.array_join(F.transform("r", lambda x: x["text"]), "\n\n").alias("text"), kept.alias("items"))


def items_of_span(items: Column, start: Column, end: Column) -> Column:
    """The page items that a chunk's span touches."""
    return F.filter(items, lambda x: (x["char_start"] < end) & (x["char_end"] > start))


def warnings_of_page(refs: Column, tables: Column) -> Column:
    """Warnings of the tables whose place is among a chunk's item references."""
    return F.flatten(F.transform(F.filter(tables, lambda t: F.array_contains(refs, t["locator"])), lambda t: t["warnings"]))


def warnings_of_row(cells: Column, warnings: Column) -> Column:
    """Warnings of a table row's cells, and those about missing places."""
    return F.filter(warnings, lambda w: F.array_contains(cells, w["cell_index"]) | (w["code"] == "MISSING_GRID_CELLS"))


@batched("struct<chunks:array<struct<ordinal:int,start:int,end:int,text:string>>,error:string>")
def aligned(text: pd.Series, parts: pd.Series, limit: pd.Series) -> pd.Series:
    """Chunks of segments that must stand in the text in order, with nothing but white space between and around them."""

    def one(t: str, own: list[str], n: int) -> dict:
        chunks, at = [], 0
        for part in (p for p in own if p):
            start = t.find(part, at)
            if start < 0 or t[at:start].strip():
                return {"chunks": None, "error": "a segment isn't where the text goes on"}
            chunks += [{"ordinal": len(chunks) + i, "start": start + a, "end": start + b, "text": part[a:b]} for i, (a, b) in enumerate(split(part, n, characters))]
            at = start + len(part)
        if t[at:].strip() or not chunks:
            return {"chunks": None, "error": "the segments don't cover the text"}
        return {"chunks": chunks, "error": None}

    return pd.Series([one(t or "", list(p), int(n)) for t, p, n in zip(text, parts, limit, strict=True)], dtype=object)


def audit_index(chunks: DataFrame, index: DataFrame, docs: DataFrame) -> DataFrame:
    """``check, failed``: chunks and index hold the same rows once each, and every chunk has its document."""
    both = chunks.select("chunk_id", F.sha2("text", 256).alias("a")).join(index.select("chunk_id", F.sha2("text", 256).alias("b")), "chunk_id", "full_outer")
    one = both.agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("one_to_one"), F.count_if(F.col("a") != F.col("b")).alias("text_equal"))
    twice = chunks.groupBy("chunk_id").count().agg(F.count_if(F.col("count") > 1).alias("unique"))
    alone = chunks.join(docs.select("doc_id").distinct(), "doc_id", "left_anti").agg(F.count("*").alias("document"))
    wide = one.crossJoin(F.broadcast(twice)).crossJoin(F.broadcast(alone))
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("failed")) for c in ("one_to_one", "text_equal", "unique", "document")])).alias("x")).select("x.*")


def cell_fidelity(ours: DataFrame, native: DataFrame) -> DataFrame:
    """Cells that differ from the native parse at their position, or that only one side has."""
    keys = ["table_id", "row", "column"]
    fields = ["text", "rowspan", "colspan", "header"]
    a = ours.select(*keys, F.struct(*fields).alias("a"))
    b = native.select(*keys, F.struct(*fields).alias("b"))
    return a.join(b, keys, "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(*keys, F.col("a").isNull().alias("missing"), F.col("b").isNull().alias("extra"))


def original_intact(docs: DataFrame, files: DataFrame) -> DataFrame:
    """``doc_id, intact``: whether the stored bytes are those that were reviewed."""
    found = files.select("doc_id", F.sha2("content", 256).alias("found"))
    return docs.join(found, "doc_id", "left").select("doc_id", F.coalesce(F.col("found") == F.col("source_sha256"), F.lit(False)).alias("intact"))


def failed_extractions(failed: DataFrame, fetched: DataFrame) -> DataFrame:
    """Each failed extraction with the first successful fetch of its raw file."""
    first = fetched.where("status = 'success'").groupBy("raw_path").agg(F.min_by(F.struct("url", "sha256", "seq"), "seq").alias("f")).select("raw_path", "f.url", "f.sha256")
    return failed.join(first, "raw_path")


def snapshot(docs: DataFrame) -> DataFrame:
    """Approved documents for an index run; parser evidence only where the text is unedited."""
    keep = ~F.coalesce(F.col("edited"), F.lit(False)) & F.col("text").eqNullSafe(F.col("parsed_text"))
    return docs.where("status = 'approved'").withColumn("parser_evidence", F.when(keep, F.col("parser_evidence"))).withColumn("parse_warnings", F.when(F.size("review_warnings") > 0, F.col("review_warnings")).otherwise(F.col("parse_warnings")))


def imported(run: DataFrame, series: DataFrame, known: DataFrame) -> DataFrame:
    """Documents and single-source series of a run that the store lacks."""
    from evidra.operators.series import single_source
    from evidra.sources.readers import already_imported

    good = single_source(series).where("accepted").select("series_id")
    rows = series.join(good, "series_id").groupBy("series_id").agg(F.first("raw_path").alias("parsed_path"), F.first("raw_sha256").alias("raw_sha256")).withColumn("kind", F.lit("series"))
    every = run.select("parsed_path", "raw_sha256").withColumn("kind", F.lit("document")).unionByName(rows.drop("series_id"))
    return already_imported(every, known)


def queue_filter(docs: DataFrame, text: str, status: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """The review queue: folded search words, status and job, the worst score first."""
    from evidra.functions.text import fold

    found = docs.where(F.contains(fold(F.concat_ws(" ", "title", "source_id", "collection")), fold(F.lit(text))))
    found = found if status is None else found.where(F.col("status") == status)
    found = found if ids is None else found.join(ids, "doc_id", "left_semi")
    return found.orderBy(F.coalesce("score", F.lit(0)), "doc_id")
