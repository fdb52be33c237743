"""Saved model and search responses, errors and receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Machine codes and the status each stands for.
BAD_KEY = ("API_KEY_INVALID", "invalid_api_key", "authentication_error")
NO_QUOTA = ("insufficient_quota", "billing_hard_limit_reached")
_CONTENT = "array<struct<type:string,text:string,annotations:array<struct<url:string,title:string,url_citation:struct<url:string,title:string>>>>>"
RESPONSE = f"struct<id:string,model:string,status:string,error:string,incomplete_details:string,output:array<struct<type:string,status:string,content:{_CONTENT}>>,choices:array<struct<finish_reason:string,message:struct<content:string>>>,candidates:array<struct<finishReason:string,content:struct<parts:array<struct<text:string,thought:boolean>>>>>>"
_ERROR = "struct<error:struct<code:string,type:string,details:array<struct<reason:string>>>>"


def parsed(body: Column) -> Column:
    return F.from_json(body, RESPONSE)


def complete(r: Column) -> Column:
    """Whether a response of the first transport is whole."""
    return F.coalesce((r["status"] == "completed") & r["error"].isNull() & r["incomplete_details"].isNull(), F.lit(False))


def text_of(r: Column, transport: Column) -> Column:
    """The answer text, or null for an incomplete one; ``transport`` is candidates, choices or responses."""
    parts = F.filter(r["candidates"][0]["content"]["parts"], lambda p: ~F.coalesce(p["thought"], F.lit(False)))
    first = F.when(r["candidates"][0]["finishReason"] == "STOP", F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), ""))
    second = F.when(r["choices"][0]["finish_reason"] == "stop", F.coalesce(r["choices"][0]["message"]["content"], F.lit("")))
    content = F.filter(F.flatten(F.transform(r["output"], lambda o: F.coalesce(o["content"], F.array().cast(_CONTENT)))), lambda c: c["type"] == "output_text")
    third = F.when(complete(r), F.array_join(F.transform(content, lambda c: F.coalesce(c["text"], F.lit(""))), ""))
    return F.when(transport == "candidates", first).when(transport == "choices", second).otherwise(third)


def citations(responses: DataFrame, most: int = 30) -> DataFrame:
    """``id, place, url, title`` of the citations of ``responses(id, body)``, the first of each URL.

    Only complete responses with a completed search call and a citation give
    rows; a URL in the prose is no citation.
    """
    r = responses.select("id", parsed(F.col("body")).alias("r"))
    searched = F.coalesce(F.exists("r.output", lambda o: (o["type"] == "web_search_call") & (o["status"] == "completed")), F.lit(False))
    content = F.flatten(F.transform("r.output", lambda o: F.coalesce(o["content"], F.array().cast(_CONTENT))))
    notes = F.flatten(F.transform(content, lambda c: F.transform(F.coalesce(c["annotations"], F.array().cast("array<struct<url:string,title:string,url_citation:struct<url:string,title:string>>>")), lambda a: F.struct(F.coalesce(a["url_citation"]["url"], a["url"]).alias("url"), F.coalesce(a["url_citation"]["title"], a["title"]).alias("title")))))
    long = r.where(complete(F.col("r")) & searched).select("id", F.posexplode(notes).alias("seq", "n")).where(F.coalesce("n.url", F.lit("")) != "")
    first = long.groupBy("id", "n.url").agg(F.min_by("n.title", "seq").alias("title"), F.min("seq").alias("seq"))
    ranked = first.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("seq", "url", "title"))), 1, most).alias("c"))
    return ranked.select("id", F.posexplode("c").alias("place", "c")).select("id", "place", "c.url", F.coalesce("c.title", "c.url").alias("title"))


def probe_status(code: Column, body: Column) -> Column:
    """The closed status of a provider's answer, from its HTTP and machine codes only."""
    e = F.from_json(body, _ERROR)["error"]
    reasons = F.concat(F.array(e["code"], e["type"]), F.coalesce(F.transform(e["details"], lambda d: d["reason"]), F.array().cast("array<string>")))
    has = lambda codes: F.coalesce(F.exists(reasons, lambda x: x.isin(*codes)), F.lit(False))
    listed = F.coalesce(F.get_json_object(body, "$.data").startswith("["), F.lit(False)) | F.coalesce(F.get_json_object(body, "$.models").startswith("["), F.lit(False))
    return (
        F.when((code == 401) | has(BAD_KEY), "invalid_key")
        .when((code == 402) | has(NO_QUOTA), "quota_exceeded")
        .when(code == 403, "permission_denied")
        .when(code == 429, "rate_limited")
        .when(code.isin(404, 405), "unsupported")
        .when((code == 200) & listed, "ok")
        .otherwise("request_failed")
    )


def safe_error(message: Column) -> Column:
    """A closed code for an error message; nothing of the message itself is kept."""
    http = F.regexp_extract(message, r"^AI_HTTP_(\d{3}): request failed; provider body omitted$", 1)
    capability = F.regexp_extract(message, r"^CAPABILITY_UNVERIFIED: ([A-Z_]+_VERIFIED);", 1)
    return F.when(http != "", F.concat(F.lit("AI_HTTP_"), http)).when(message == "AI_NETWORK_ERROR: request failed", "AI_NETWORK_ERROR").when(capability != "", F.concat(F.lit("CAPABILITY_UNVERIFIED:"), capability)).otherwise("PIPELINE_FAILED")


def receipts(responses: DataFrame) -> DataFrame:
    """Digest, model, id and size of each stored response."""
    r = parsed(F.col("body"))
    return responses.select(F.sha2("body", 256).alias("sha256"), r["model"].alias("model"), r["id"].alias("response_id"), F.octet_length("body").alias("bytes"))


def ranking_complete(ranks: DataFrame, candidates: DataFrame) -> DataFrame:
    """``missing, unknown, repeated``: a model's ranking must name every candidate once and no other."""
    n = ranks.groupBy("id").agg(F.count("*").alias("n"))
    both = candidates.select("id").distinct().withColumn("c", F.lit(True)).join(n, "id", "full_outer")
    return both.agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("c").isNull()).alias("unknown"), F.count_if(F.col("n") > 1).alias("repeated"))


def repaired(first: DataFrame, second: DataFrame) -> DataFrame:
    """``id, answer, validation``: an answer that fails its check may be given once more, then it is rejected.

    Both tables: ``id, answer, ok``.
    """
    s = second.select("id", F.col("answer").alias("again"), F.col("ok").alias("again_ok"))
    joined = first.join(s, "id", "left")
    good = F.coalesce("again_ok", F.lit(False))
    return joined.select("id", F.when(F.col("ok"), F.col("answer")).when(good, F.col("again")).alias("answer"), F.when(F.col("ok") | good, "accepted").otherwise("rejected").alias("validation"))


def current_keys(events: DataFrame, credentials: DataFrame) -> DataFrame:
    """Events with ``current_key``: whether they used the provider's present credential."""
    c = credentials.select("provider", F.col("version").alias("present"))
    return events.join(c, "provider", "left").withColumn("current_key", F.coalesce(F.col("credential_version") == F.col("present"), F.lit(False))).drop("present")
