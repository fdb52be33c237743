"""Chunking: exact spans, sections, identifiers, versions, coverage."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidra.functions.udf import batched


_SPANS = "array<struct<start:long,end:long>>"
_WORD = re.compile(r"\w+|[^\w\s]")


def characters(text: str) -> int:
    """Token count of the character tokenizer."""
    return len(text)


def word_pieces(text: str) -> int:
    """Token count of a tokenizer of words and single marks."""
    return len(_WORD.findall(text))


def split(text: str, limit: int, count: Callable[[str], int] = characters) -> list[tuple[int, int]]:
    """Contiguous spans that cover ``text``, each of ``limit`` tokens at most and as long as that allows.

    A span that isn't the last ends behind its last newline, if that lies in
    its second half.  A single character over the limit is an error.
    """
    out, start, n = [], 0, len(text)
    while start < n:
        good, step = start, max(1, limit)
        if count is characters:
            good = min(n, start + limit)
        else:
            # ``bad`` is the first known end that is too long; ends beyond the text count as too long.
            bad = n + 1
            while good < n and bad > n:
                probe = min(n, start + step)
                if count(text[start:probe]) <= limit:
                    good, step = probe, step * 2
                else:
                    bad = probe
            while bad - good > 1 and bad <= n:
                probe = (good + bad) // 2
                good, bad = (probe, bad) if count(text[start:probe]) <= limit else (good, probe)
        if good == start:
            raise ValueError("one character exceeds the chunk limit")
        if good < n:
            line = text.rfind("\n", start, good)
            if line > start + (good - start) // 2:
                good = line + 1
        out.append((start, good))
        start = good
    return out


def spans_udf(limit: int, count: Callable[[str], int] = characters):  # noqa: ANN201
    """T6 in Arrow batches: the spans of each text, in code points."""

    @batched(_SPANS)
    def spans(text: pd.Series) -> pd.Series:
        return text.map(lambda x: [{"start": a, "end": b} for a, b in split(x or "", limit, count)])

    return spans


def chunk(sections: DataFrame, limit: int, count: Callable[[str], int] = characters) -> DataFrame:
    """C8 for text sections: ``doc_id, ordinal, char_start, char_end, text, chunk_id``.

    ``sections(doc_id, text)``; ``chunk_id`` digests document, place and
    content (P5), so equal texts of different documents stay apart.  Null and
    empty texts have no chunks.
    """
    rows = sections.select("doc_id", "text", F.posexplode(spans_udf(limit, count)("text")).alias("ordinal", "s"))
    content = F.expr("substring(text, cast(s.start + 1 as int), cast(s.end - s.start as int))")
    cut = rows.select("doc_id", F.col("ordinal").cast("int").alias("ordinal"), F.col("s.start").alias("char_start"), F.col("s.end").alias("char_end"), content.alias("text"))
    key = F.concat_ws("|", F.col("doc_id").cast("string"), F.col("char_start").cast("string"), F.col("text"))
    return cut.withColumn("chunk_id", F.concat(F.lit("c"), F.substring(F.sha2(key, 256), 1, 24)))


def coverage(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Per document with text: whether its chunks, joined in order, are its text, and touch without gap or overlap."""
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    gaps = chunks.withColumn("gap", F.col("char_start") != F.coalesce(F.lag("char_end").over(w), F.lit(0)))
    joined = gaps.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("p"), F.bool_or("gap").alias("gap"), F.count("*").alias("n_chunks"))
    joined = joined.select("doc_id", "n_chunks", "gap", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("whole"))
    return docs.join(joined, "doc_id").select("doc_id", "n_chunks", ((F.col("whole") == F.col("text")) & ~F.col("gap")).alias("covered"))


def prefix(title: str = "title", note: str = "source_note") -> Column:
    """Title and note lines in front of a chunk, cut to 300 and 600 characters."""
    return F.concat(F.substring(title, 1, 300), F.lit("\n"), F.coalesce(F.concat(F.substring(note, 1, 600), F.lit("\n")), F.lit("")))


def sections(docs: DataFrame) -> DataFrame:
    """Every document's sections: its pages, or its text without pages; its rows; its tables' rows.

    ``docs(parsed_path, text, pages, rows, tables)`` with the nested shapes of
    the parsed document; one row for each section with its kind and place.
    """
    place = {"page": "int", "row": "int", "table": "int"}

    def shaped(df: DataFrame, kind: str, text: Column, **at: Column) -> DataFrame:
        cols = [at.get(k, F.lit(None)).cast(t).alias(k) for k, t in place.items()]
        return df.select("parsed_path", F.lit(kind).alias("kind"), *cols, text.alias("text"))

    has = F.coalesce(F.size("pages"), F.lit(0)) > 0
    pages = docs.where(has).select("parsed_path", F.explode("pages").alias("p"))
    plain = docs.where(~has & F.col("text").isNotNull())
    rows = docs.select("parsed_path", F.posexplode("rows").alias("i", "r"))
    tables = docs.select("parsed_path", F.posexplode("tables").alias("t", "x")).select("parsed_path", "t", F.posexplode("x.grid").alias("i", "cells"))
    return (
        shaped(pages, "page", F.col("p.text"), page=F.col("p.page"))
        .unionByName(shaped(plain, "text", F.col("text")))
        .unionByName(shaped(rows, "row", F.to_json("r", {"ignoreNullFields": "false"}), row=F.col("i")))
        .unionByName(shaped(tables, "table", F.to_json("cells", {"ignoreNullFields": "false"}), table=F.col("t"), row=F.col("i")))
    )


def document_version(docs: DataFrame, chunker: str = "spans-1") -> Column:
    """Digest of the raw bytes' digest, parser, library, options, chunker and content of each row.

    Columns that ``docs`` lacks, and nulls, count as null; struct fields are
    written in a fixed order, so equal documents have equal versions.
    """
    have = set(docs.columns)
    part = lambda c: F.to_json(F.col(c)) if c in have and docs.schema[c].dataType.typeName() in ("array", "struct", "map") else F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    content = F.sha2(F.to_json(F.struct(part("text").alias("text"), part("tables").alias("tables")), {"ignoreNullFields": "false"}), 256)
    named = [part(c).alias(c) for c in ("raw_sha256", "parser", "parser_library_version", "parser_config")]
    return F.sha2(F.to_json(F.struct(*named, F.lit(chunker).alias("chunker"), content.alias("content")), {"ignoreNullFields": "false"}), 256)


def review_chunk_id(ordinal: Column, locator: Column, text: Column) -> Column:
    """Identifier of a review chunk from its number, place and text."""
    key = F.to_json(F.struct(ordinal.alias("ordinal"), locator.alias("locator"), text.alias("text")), {"ignoreNullFields": "false"})
    return F.concat(F.lit("c"), F.substring(F.sha2(key, 256), 1, 24))


def source_id(url: Column, path: Column) -> Column:
    """Digest of a document's URL, or of its path."""
    return F.sha2(F.coalesce(F.nullif(url, F.lit("")), path), 256)


def review_source_id(given: Column, source_sha256: Column, url: Column) -> Column:
    """The given identifier of a reviewed source, or one from its URL, or from its bytes."""
    made = F.coalesce(F.concat(F.lit("url-"), F.substring(F.sha2(F.nullif(url, F.lit("")), 256), 1, 24)), F.concat(F.lit("source-"), F.substring(source_sha256, 1, 16)))
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), made)


def wide_rows(found: DataFrame, limit: int, count: Callable[[str], int] = characters) -> DataFrame:
    """table rows of :func:`sections` over ``limit`` tokens, which can't be split safely."""

    @batched("int")
    def size(text: pd.Series) -> pd.Series:
        return text.map(lambda x: count(x or ""))

    return found.where(F.col("kind") == "table").where(size("text") > limit)


def make_chunks(docs: DataFrame, limit: int, count: Callable[[str], int] = characters, chunker: str = "spans-1") -> DataFrame:
    """Chunks of every section of ``docs``, texts, pages, rows and table rows, with title lines in front.

    ``docs`` as for :func:`sections`, with ``title, source_note``.  A chunk
    holds ``limit`` tokens with its prefix; its identifier digests document,
    place, start and content; its page is found by :func:`page_of`.  A prefix
    that leaves fewer than 50 tokens, and a table row that doesn't fit, are
    errors.
    """
    heads = docs.select("parsed_path", prefix().alias("prefix"), document_version(docs, chunker).alias("document_version"))
    found = sections(docs).join(heads, "parsed_path").where(F.length("text") > 0)

    @batched(f"struct<spans:{_SPANS},error:string>")
    def cut(text: pd.Series, before: pd.Series, kind: pd.Series) -> pd.Series:
        def one(t: str, p: str, k: str) -> dict:
            room = limit - count(p)
            if room < 50:
                return {"spans": None, "error": "the title leaves no room"}
            if k == "table" and count(t) > room:
                return {"spans": None, "error": "a table row is too wide"}
            return {"spans": [{"start": a, "end": b} for a, b in split(t, room, count)], "error": None}

        return pd.Series([one(t, p, k) for t, p, k in zip(text, before, kind, strict=True)], dtype=object)

    spans = found.withColumn("cut", cut("text", "prefix", "kind"))
    checked = spans.withColumn("s", F.when(F.col("cut.error").isNotNull(), F.raise_error(F.col("cut.error"))).otherwise(F.col("cut.spans")))
    rows = checked.select("parsed_path", "kind", "page", "row", "table", "prefix", "document_version", "text", F.posexplode("s").alias("ordinal", "s"))
    content = F.concat("prefix", F.expr("substring(text, cast(s.start + 1 as int), cast(s.end - s.start as int))"))
    place = F.to_json(F.struct("kind", "page", "row", "table"))
    rows = rows.select("parsed_path", "kind", "page", "row", "table", "ordinal", "document_version", F.col("s.start").alias("char_start"), F.col("s.end").alias("char_end"), content.alias("text"), place.alias("place"))
    return rows.withColumn("chunk_id", F.concat(F.lit("c"), F.substring(F.sha2(F.concat_ws("|", "parsed_path", "place", F.col("char_start").cast("string"), "text"), 256), 1, 24))).drop("place")


def page_of(page: Column, pages: Column) -> Column:
    """The page of a document that a chunk's place names, null where there is none."""
    return F.get(F.filter(pages, lambda p: p["page"] == page), F.lit(0))


def index_metadata(chunks: DataFrame) -> DataFrame:
    """What the index tells of a chunk: everything but its vector and cache key."""
    return chunks.drop("vector", "cache_key")


def row_with_headers(tables: DataFrame) -> DataFrame:
    """``table_id, row, column, text, cell_index, headers`` for each place of each table's grid.

    ``tables(table_id, cells, grid)``.  A header of a column is a header cell
    above the first row that has a cell that is none, and whose span covers
    the column; a place without cell keeps nulls.
    """
    first = F.coalesce(F.array_min(F.transform(F.filter("cells", lambda c: ~c["header"]), lambda c: c["row"])), F.lit(1))
    t = tables.select("table_id", "cells", "grid", F.filter("cells", lambda c: c["header"] & (c["row"] < first)).alias("heads"))
    t = t.select("table_id", "cells", "heads", F.posexplode("grid").alias("row", "places")).select("table_id", "cells", "heads", "row", F.posexplode("places").alias("column", "cell_index"))
    heads = F.transform(F.filter("heads", lambda h: (h["column"] <= F.col("column")) & (F.col("column") < h["column"] + h["colspan"])), lambda h: h["text"])
    cell = F.when(F.col("cell_index").isNotNull(), F.get("cells", F.col("cell_index")))
    return t.select("table_id", "row", "column", cell["text"].alias("text"), "cell_index", heads.alias("headers"))


def audit(chunks: DataFrame, docs: DataFrame, limit: int) -> DataFrame:
    """D4 for text chunks: ``check, checked, failed`` over all chunks.

    Checks: unique ids, a document for each chunk, the span's text equal to
    the document's at its place, the token limit, recomputed ids.
    """
    key = F.concat_ws("|", F.col("doc_id").cast("string"), F.col("char_start").cast("string"), F.col("text"))
    d = docs.select("doc_id", F.col("text").alias("whole"))
    joined = chunks.join(d, "doc_id", "left").select(
        F.col("whole").isNotNull().alias("document_found"),
        F.coalesce(F.expr("substring(whole, cast(char_start + 1 as int), cast(char_end - char_start as int)) = text"), F.lit(False)).alias("span_equal"),
        (F.length("text") <= limit).alias("within_limit"),
        (F.concat(F.lit("c"), F.substring(F.sha2(key, 256), 1, 24)) == F.col("chunk_id")).alias("id_recomputed"),
    )
    names = ["document_found", "span_equal", "within_limit", "id_recomputed"]
    long = joined.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("ok")) for c in names])).alias("x")).select("x.*")
    repeats = chunks.groupBy("chunk_id").count().select(F.lit("unique_id").alias("check"), (F.col("count") == 1).alias("ok"))
    return long.unionByName(repeats).groupBy("check").agg(F.count("*").alias("checked"), F.count_if(~F.col("ok")).alias("failed"))


#: Kinds of sections whose place an audit can follow.
KINDS = ("page", "text", "row", "table")


def audit_sections(chunks: DataFrame, index: DataFrame, docs: DataFrame, limit: int, count: Callable[[str], int] = characters, chunker: str = "spans-1") -> DataFrame:
    """``check, checked, failed`` of :func:`make_chunks` rows against the index and the parsed documents.

    Each chunk must have a document, a known kind of place, the document's
    prefix and version, the text of its section at its span, tokens within the
    limit, its own identifier, and the same row in ``index(chunk_id, text)``;
    identifiers are unique and the index holds no others.
    """

    @batched("int")
    def size(text: pd.Series) -> pd.Series:
        return text.map(lambda x: count(x or ""))

    place = ["parsed_path", "kind", "page", "row", "table"]
    heads = docs.select("parsed_path", prefix().alias("p"), document_version(docs, chunker).alias("v"))
    parts = sections(docs).select(*place, F.col("text").alias("whole"))
    same = F.lit(True)
    c, s = chunks.alias("c"), parts.alias("s")
    for name in place:
        same = same & F.col(f"c.{name}").eqNullSafe(F.col(f"s.{name}"))
    # Equal on the path and the kind, so the join is by hash; the other parts of the place may be null.
    near = c.join(s, (F.col("c.parsed_path") == F.col("s.parsed_path")) & (F.col("c.kind") == F.col("s.kind")) & same, "left").select("c.*", "whole").join(heads, "parsed_path", "left")
    near = near.join(index.select("chunk_id", F.col("text").alias("indexed")), "chunk_id", "left")
    body = F.expr("substring(whole, cast(char_start + 1 as int), cast(char_end - char_start as int))")
    key = F.concat_ws("|", "parsed_path", F.to_json(F.struct("kind", "page", "row", "table")), F.col("char_start").cast("string"), "text")
    checks = {
        "document_found": F.col("v").isNotNull(),
        "kind_known": F.col("kind").isin(*KINDS),
        "prefix_kept": F.startswith("text", F.col("p")),
        "version_equal": F.col("document_version") == F.col("v"),
        "span_equal": F.col("text") == F.concat("p", body),
        "within_limit": size("text") <= limit,
        "id_recomputed": F.col("chunk_id") == F.concat(F.lit("c"), F.substring(F.sha2(key, 256), 1, 24)),
        "index_equal": F.col("text") == F.col("indexed"),
    }
    rows = near.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok")) for n, ok in checks.items()])).alias("x")).select("x.*")
    repeats = chunks.groupBy("chunk_id").count().select(F.lit("unique_id").alias("check"), (F.col("count") == 1).alias("ok"))
    others = index.select("chunk_id").join(chunks.select("chunk_id").distinct().withColumn("known", F.lit(True)), "chunk_id", "left").select(F.lit("index_known").alias("check"), F.col("known").isNotNull().alias("ok"))
    return rows.unionByName(repeats).unionByName(others).groupBy("check").agg(F.count("*").alias("checked"), F.count_if(~F.col("ok")).alias("failed"))


__all__ = ["audit", "audit_sections", "characters", "chunk", "coverage", "document_version", "index_metadata", "make_chunks", "page_of", "prefix", "review_chunk_id", "review_source_id", "row_with_headers", "sections", "source_id", "spans_udf", "split", "wide_rows", "word_pieces"]
