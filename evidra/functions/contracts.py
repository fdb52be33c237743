"""Contracts of JSON values: schemas, pointers, canonical form, options."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from evidra.functions.udf import batched

_KINDS = {type(None): "null", bool: "boolean", int: "integer", str: "string", list: "array", dict: "object"}


def schema_errors(value: Any, schema: dict, path: str = "$") -> list[str]:
    """JS3: where a value departs from a schema of types, nullable types, enums, exact keys and array items."""
    kinds = schema.get("type")
    kind = _KINDS.get(type(value), "number" if isinstance(value, float) else "other")
    if kind not in (kinds if isinstance(kinds, list) else [kinds]):
        return [f"{path}: {kind}"]
    if "enum" in schema and value not in schema["enum"]:
        return [f"{path}: enum"]
    if kind == "object":
        if value.keys() != schema["properties"].keys():
            return [f"{path}: keys"]
        return [e for k, sub in schema["properties"].items() for e in schema_errors(value[k], sub, f"{path}.{k}")]
    if kind == "array":
        return [e for i, x in enumerate(value) for e in schema_errors(x, schema["items"], f"{path}[{i}]")]
    return []


def validated(body: Column, schema: dict) -> Column:
    """The errors of each JSON text against ``schema``; unreadable text is one error."""

    def run(text: pd.Series) -> pd.Series:
        def one(x: str | None) -> list[str]:
            try:
                return schema_errors(json.loads(x or ""), schema)
            except ValueError:
                return ["$: not JSON"]

        return text.map(one)

    run.__annotations__ = {"text": pd.Series, "return": pd.Series}
    return batched("array<string>")(run)(body)


@batched("string")
def pointer(body: pd.Series, path: pd.Series) -> pd.Series:
    """J15, JS4: the JSON value that a pointer such as ``#/a/0/b~1c`` names, as JSON; null where there is none."""

    def one(x: str | None, p: str | None) -> str | None:
        try:
            at = json.loads(x or "")
            for part in (p or "").removeprefix("#").split("/")[1:]:
                key = part.replace("~1", "/").replace("~0", "~")
                at = at[int(key)] if isinstance(at, list) else at[key]
            return json.dumps(at, ensure_ascii=False, sort_keys=True)
        except (ValueError, KeyError, IndexError, TypeError):
            return None

    return pd.Series([one(x, p) for x, p in zip(body, path, strict=True)], dtype=object)


@batched("string")
def canonical_json(body: pd.Series) -> pd.Series:
    """JS2: keys sorted, no spare white space; null for text that isn't JSON."""

    def one(x: str) -> str | None:
        try:
            return json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return body.map(one, na_action="ignore")


def same_keys(body: Column, keys: tuple[str, ...]) -> Column:
    """Whether a JSON object has exactly these keys."""
    return F.coalesce(F.array_sort(F.json_object_keys(body)) == F.array(*[F.lit(k) for k in sorted(keys)]), F.lit(False))


def evidence_ok(ids: Column, years: Column, segments: Column) -> Column:
    """Eight ids at most, all of them segments, and every year in the text of a chosen segment.

    ``segments``: ``array<struct<id:int,text:string>>`` whose ids count from 0.
    """
    chosen = F.filter(segments, lambda s: F.array_contains(ids, s["id"]))
    seen = F.flatten(F.transform(chosen, lambda s: F.transform(F.regexp_extract_all(s["text"], F.lit(r"(?U)\b((?:19|20)\d{2})\b"), 1), lambda y: y.cast("int"))))
    inside = F.forall(ids, lambda i: (i >= 0) & (i < F.size(segments)))
    return F.coalesce((F.size(ids) <= 8) & inside & (F.size(F.array_except(years, seen)) == 0), F.lit(False))


def observed_years(segments: Column) -> Column:
    """Each segment's id with its years."""
    return F.transform(segments, lambda s: F.struct(s["id"].alias("id"), F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(s["text"], F.lit(r"(?U)\b((?:19|20)\d{2})\b"), 1), lambda y: y.cast("int")))).alias("years")))


def iso2(x: Column) -> Column:
    return F.coalesce(x.rlike("^[A-Z]{2}$"), F.lit(False))


def several_numbers(cell: Column, header: Column) -> Column:
    """Whether a cell that is no column header holds more than one number."""
    return F.coalesce(~header & cell.rlike(r"\d[.,]?\d*\s+\d"), F.lit(False))


def metadata(title: Column, collection: Column, version: Column) -> Column:
    """Trimmed, cut and defaulted metadata of a review document."""
    given = lambda c, n, default: F.coalesce(F.nullif(F.substring(F.trim(c), 1, n), F.lit("")), F.lit(default))
    return F.struct(given(title, 300, "untitled").alias("title"), given(collection, 120, "default").alias("collection"), given(version, 120, "1").alias("document_version"))


def file_title(url: Column) -> Column:
    """The name of a URL's file without its suffix, decoded, with spaces for dashes and underscores."""
    name = F.element_at(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), url), "/"), -1)
    return F.trim(F.regexp_replace(F.coalesce(F.try_url_decode(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")), name), "[-_]+", " "))


#: The ranges of parser options.
OPTIONS = {"mode": ("auto", "layout", "native"), "pages": (1, 200), "timeout": (10, 600), "threads": (1, 8)}


def check_options(options: dict[str, Any]) -> dict[str, Any]:
    """the options, or an error for an unknown name or a value out of range."""
    for name, value in options.items():
        allowed = OPTIONS.get(name)
        if allowed is None:
            raise ValueError(f"unknown option {name}")
        if isinstance(allowed[0], str):
            good = value in allowed
        else:
            good = type(value) is int and allowed[0] <= value <= allowed[1]
        if not good:
            raise ValueError(f"option {name} is out of range")
    return options


def check_question(question: str, budget: int, top_k: int, count=len) -> None:  # noqa: ANN001
    """F11."""
    if not question.strip() or count(question) > 2000 or not 1 <= top_k <= 20 or budget < 500:
        raise ValueError("question, budget or number of results is out of range")
