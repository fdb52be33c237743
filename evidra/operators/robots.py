"""Robots policy over saved bodies; the fetch stays outside.

Each origin's ``robots.txt`` becomes one row: a state, a delay, and its rules
as an array sorted by precedence, which the size of a body bounds.  Addresses
are joined with it by origin, and the first rule that matches decides; nothing
is multiplied by the number of rules, and a hot origin can be split.

Groups begin at a ``User-agent`` line that follows a rule.  Those whose name is
the longest one that the agent's own name begins with count, together; those
named ``*`` count where there is no other.  By default the longest pattern
wins, and of equally long ones the allowing one; ``precedence="first"`` takes
them in the order of the file.  ``*`` stands for any characters and ``$`` for
the end of the address.  A body may be 500 KB long; a longer one, one that is
markup, and any answer but 2xx, 404 and 410 leave the policy unknown, and
unknown is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The least and the greatest delay in seconds.
LEAST, MOST = 0.6, 30.0
MAX_ROBOTS = 500_000
_FIELDS = ("user-agent", "allow", "disallow", "crawl-delay", "request-rate")


def origin(url: Column) -> Column:
    """Scheme and authority in lower case; null for anything but HTTP(S)."""
    found = F.lower(F.regexp_extract(url, r"^(?i)(https?://[^/?#\s]+)", 1))
    return F.when(found != "", found)


def _plain(path: Column) -> Column:
    """Percent signs decoded, except those of a slash; a stray one stands for itself."""
    kept = F.regexp_replace(F.regexp_replace(path, "%(?![0-9A-Fa-f]{2})", "%25"), "(?i)%2f", "%252F")
    return F.coalesce(F.try_url_decode(F.replace(kept, F.lit("+"), F.lit("%2B"))), path)


def target(url: Column) -> Column:
    """Path and query as rules see them."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^(?i)https?://[^/?#]+", ""), "#.*$", "")
    return _plain(F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest)))


def _state(status: Column, body: Column) -> Column:
    markup = F.startswith(F.ltrim(body), F.lit("<"))
    good = status.between(200, 299) & body.isNotNull() & ~markup & (F.length(body) <= MAX_ROBOTS)
    return F.when(status.isin(404, 410), "not_present").when(good, "checked").otherwise("unavailable")


def policies(robots: DataFrame, agent: str, precedence: str = "longest") -> DataFrame:
    """``origin, state, delay, rules`` of ``robots(origin, status, body)``, one row an origin.

    Of several rows of one origin the least counts, by status and body.  Delays
    are the greatest of the agent's groups, or of the common ones where those name none.
    """
    if precedence not in ("longest", "first"):
        raise ValueError("precedence is longest or first")
    name = agent.split("/")[0].strip().lower()
    if not name:
        raise ValueError("an agent needs a name")
    saved = robots.where(F.col("origin").isNotNull()).groupBy(F.lower("origin").alias("origin")).agg(F.min(F.struct("status", "body")).alias("r"))
    saved = saved.select("origin", _state(F.col("r.status"), F.col("r.body")).alias("state"), F.col("r.body").alias("body"))
    lines = saved.where("state = 'checked'").select("origin", F.posexplode(F.split(F.regexp_replace("body", "^﻿", ""), r"\r\n|\r|\n")).alias("place", "line"))
    text = F.regexp_replace("line", "#.*$", "")
    lines = lines.select("origin", "place", F.lower(F.trim(F.substring_index(text, ":", 1))).alias("field"), F.trim(F.regexp_replace(text, "^[^:]*:?", "")).alias("value")).where(F.col("field").isin(*_FIELDS))
    # A body's lines, at most half a megabyte.
    order = Window.partitionBy("origin").orderBy("place")
    agents = F.col("field") == "user-agent"
    begins = agents & ~F.coalesce(F.lag("field").over(order) == "user-agent", F.lit(False))
    lines = lines.withColumn("begins", begins.cast("int")).withColumn("group", F.sum("begins").over(order))
    own = F.when(F.col("value") == "*", 0).when((F.col("value") != "") & F.startswith(F.lit(name), F.lower("value")), F.length("value"))
    fit = F.max(F.when(agents, own)).over(Window.partitionBy("origin", "group"))
    lines = lines.withColumn("fit", fit).where((F.col("group") > 0) & F.col("fit").isNotNull() & ~agents)
    lines = lines.withColumn("best", F.max("fit").over(Window.partitionBy("origin")))

    pattern = F.when(F.startswith("value", F.lit("/")) | F.startswith("value", F.lit("*")), F.col("value")).otherwise(F.concat(F.lit("/"), F.col("value")))
    plain = _plain(pattern)
    body = F.regexp_replace(plain, r"\$$", "")
    wild = F.contains(body, F.lit("*"))
    regex = F.concat(F.lit(r"^(?s)\Q"), F.replace(F.replace(body, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit("*"), F.lit(r"\E.*\Q")), F.lit(r"\E"), F.when(F.endswith(plain, F.lit("$")), F.lit("$")).otherwise(""))
    rule = F.struct((-F.length("value") if precedence == "longest" else F.col("place")).alias("rank"), (F.col("field") == "disallow").alias("refuses"), F.col("value").alias("pattern"), F.when(~wild & ~F.endswith(plain, F.lit("$")), plain).alias("prefix"), regex.alias("regex"))
    is_rule = F.col("field").isin("allow", "disallow") & (F.col("value") != "") & (F.col("fit") == F.col("best"))
    seconds = F.when(F.col("field") == "crawl-delay", F.col("value").try_cast("double"))
    rate = F.split("value", "/")
    pause = F.when(F.col("field") == "request-rate", F.try_divide(F.try_element_at(rate, F.lit(2)).try_cast("double"), F.try_element_at(rate, F.lit(1)).try_cast("double")))
    value = F.greatest(seconds, pause)
    found = lines.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.when(is_rule, rule))).alias("rules"),
        F.coalesce(F.max(F.when(F.col("fit") == F.col("best"), value)), F.max(F.when(F.col("fit") == 0, value))).alias("delay"),
    )
    return saved.select("origin", "state").join(found, "origin", "left").select("origin", "state", F.greatest(F.coalesce("delay", F.lit(LEAST)), F.lit(LEAST)).alias("delay"), "rules")


def allowed(urls: DataFrame, robots: DataFrame, agent: str, url: str = "url", precedence: str = "longest") -> DataFrame:
    """The rows of ``urls`` with ``robots_state, robots_delay, robots_rule, robots_allowed``.

    ``robots_rule`` is the pattern that decided, null where none did.  An
    origin without a saved answer is unavailable, and a delay of over 30
    seconds refuses everything.  The policy file itself is always allowed.
    """
    clash = [c for c in urls.columns if c.startswith("robots_")]
    if clash:
        raise ValueError(f"columns {clash} are the result's own")
    own = policies(robots, agent, precedence).select(F.col("origin").alias("robots_origin"), F.col("state").alias("robots_known"), F.col("delay").alias("robots_pause"), F.col("rules").alias("robots_rules"))
    joined = urls.withColumns({"robots_at": origin(F.col(url)), "robots_path": target(F.col(url))}).join(own, F.col("robots_at") == F.col("robots_origin"), "left")
    hits = F.filter("robots_rules", lambda r: F.when(r["prefix"].isNotNull(), F.startswith(F.col("robots_path"), r["prefix"])).otherwise(F.rlike(F.col("robots_path"), r["regex"])))
    joined = joined.withColumn("robots_hit", F.get(hits, 0))
    state = F.coalesce("robots_known", F.lit("unavailable"))
    free = F.coalesce(~F.col("robots_hit.refuses"), F.lit(True)) | (F.col("robots_path") == "/robots.txt")
    ok = (state == "not_present") | ((state == "checked") & free & (F.col("robots_pause") <= MOST))
    return joined.select(*urls.columns, state.alias("robots_state"), F.coalesce("robots_pause", F.lit(LEAST)).alias("robots_delay"), F.col("robots_hit.pattern").alias("robots_rule"), ok.alias("robots_allowed"))
