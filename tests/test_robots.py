"""Robots policy: groups, precedence, states, delays; a plain standard parser for ordinary files."""

from __future__ import annotations

from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from evidra.operators import robots as R

BODY = """﻿# a comment
User-agent: other
Disallow: /
User-Agent: EVI
User-agent: third
Crawl-delay: 2
Disallow: /private # no
Allow: /private/open
Disallow: /*.pdf$
Disallow:
Sitemap: https://a.example/map
Disallow: /q\\Ex?
Disallow: /caf%C3%A9
User-agent: *
Disallow: /star
Crawl-delay: 9
"""


def _ask(spark, robots, urls, agent="evidra/1.0", **more):
    r = spark.createDataFrame(robots, "origin string, status int, body string")
    u = spark.createDataFrame([(x,) for x in urls], "url string")
    return {x.url: x for x in R.allowed(u, r, agent, **more).collect()}


def test_groups_and_longest_match(spark):
    o = "https://a.example"
    want = {"/": True, "/private": False, "/private/open/x": True, "/x/y.pdf": False, "/x/y.pdf?a": True, "/star": True, "/q\\Ex?1": False, "/q": True, "/caf%c3%A9/": False, "/café": False, "/robots.txt": True}
    got = _ask(spark, [(o, 200, BODY)], [o + p for p in want])
    assert {p: got[o + p].robots_allowed for p in want} == want
    assert got[o + "/private/open/x"].robots_rule == "/private/open" and got[o + "/"].robots_rule is None
    assert {g.robots_delay for g in got.values()} == {2.0}
    others = _ask(spark, [(o, 200, BODY)], [o + "/star", o + "/private", o + "/robots.txt"], agent="nobody")
    assert [others[o + p].robots_allowed for p in ("/star", "/private", "/robots.txt")] == [False, True, True]
    assert others[o + "/star"].robots_delay == 9.0


def test_states_and_delays(spark):
    rows = [("http://gone.e", 404, None), ("http://down.e", 503, ""), ("http://page.e", 200, " <html>"), ("http://slow.e", 200, "User-agent: *\nCrawl-delay: 31"), ("http://rate.e", 200, "User-agent: *\nRequest-rate: 2/10\nCrawl-delay: x"), ("http://empty.e", 200, ""), ("http://long.e", 200, "#" * 500_001), (None, 200, "")]
    names = ["gone", "down", "page", "slow", "rate", "empty", "long", "none"]
    got = _ask(spark, rows, [f"HTTP://{n.upper()}.e/x" for n in names] + ["ftp://gone.e/", None])
    see = [(g.robots_state, g.robots_delay, g.robots_allowed) for g in (got[f"HTTP://{n.upper()}.e/x"] for n in names)]
    assert see == [("not_present", 0.6, True), ("unavailable", 0.6, False), ("unavailable", 0.6, False), ("checked", 31.0, False), ("checked", 5.0, True), ("checked", 0.6, True), ("unavailable", 0.6, False), ("unavailable", 0.6, False)]
    assert not got["ftp://gone.e/"].robots_allowed and got[None].robots_allowed is False


def test_file_order_equals_the_standard_parser(spark):
    body = "User-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /c/d\nAllow: /c\nDisallow: /e f"
    plain = RobotFileParser()
    plain.parse(body.splitlines())
    urls = [f"https://s.e{p}" for p in ("/", "/a", "/a/b", "/ab", "/c", "/c/d/e", "/e%20f", "/x?/a")]
    got = _ask(spark, [("https://s.e", 200, body)], urls, precedence="first")
    assert {u: got[u].robots_allowed for u in urls} == {u: plain.can_fetch("evidra", u) for u in urls}


def test_groups_of_one_name_are_joined_and_bad_calls_refused(spark):
    body = "Disallow: /nogroup\nUser-agent: evidra\nDisallow: /a\n\nUser-agent: *\nDisallow: /s\nUser-agent: evidra\nDisallow: /b"
    got = _ask(spark, [("https://j.e", 200, body), ("https://j.e", 500, "x")], [f"https://j.e/{p}" for p in ("a", "b", "s", "nogroup")])
    assert [g.robots_allowed for g in got.values()] == [False, False, True, True]
    empty = spark.createDataFrame([], "url string")
    assert R.allowed(empty, spark.createDataFrame([], "origin string, status int, body string"), "x").count() == 0
    with pytest.raises(ValueError):
        R.allowed(empty.withColumn("robots_x", F.lit(1)), empty, "x")
    with pytest.raises(ValueError):
        R.policies(empty, "x", "last")
