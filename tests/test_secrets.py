"""Known secrets in every form, in texts, URLs and what a reader of a run is shown."""

from __future__ import annotations

import random
import re
from urllib.parse import quote, quote_plus

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidra.functions.secrets import MASK, count_known, forms, mask_known, masked
from evidra.functions.text import redact_secrets
from evidra.functions.urls import safe_url
from evidra.operators.runs import trace_view

SECRETS = ("a/b+c", "p q&r=1", "é~x", "abc", "abcd")


def plain(text, secrets):
    """Leftmost, then longest, character by character."""
    upper = re.sub("%[0-9A-Fa-f]{2}", lambda m: m.group().upper(), text)
    known, out, i = sorted({f for s in secrets if s for f in forms(s)}, key=len, reverse=True), "", 0
    while i < len(text):
        hit = next((f for f in known if upper.startswith(re.sub("%[0-9A-Fa-f]{2}", lambda m: m.group().upper(), f), i)), None)
        out, i = (out + MASK, i + len(hit)) if hit else (out + text[i], i + 1)
    return out


def test_forms():
    assert {"a/b+c", quote("a/b+c", safe=""), quote_plus("p q&r=1"), quote("p q&r=1", safe=""), "a%2fb%2bc", "a/b%2Bc"} <= {f for s in SECRETS for f in forms(s)}


def test_masking_like_plain(spark):
    r = random.Random(8)
    parts = [f for s in SECRETS for f in forms(s)] + ["a", "b", "%2", "ab", "abce", " ", "/", "+", "é", "中"]
    rows = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(400)] + ["", None, "x" * 100_000 + "abcd"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").repartition(3)
    got = {x.i: x.m for x in df.select("i", mask_known(F.col("t"), SECRETS).alias("m")).collect()}
    assert got == {i: None if t is None else plain(t, SECRETS) for i, t in enumerate(rows)}
    assert count_known(pd.Series(list(got.values())), SECRETS) == 0


@pytest.mark.parametrize("secrets", [(), ("",), ("", "")])
def test_nothing_known(spark, secrets):
    df = spark.createDataFrame([("abc",)], "t string")
    assert df.select(mask_known(F.col("t"), secrets)).first()[0] == "abc"
    assert masked("abc", secrets) == "abc" and count_known(pd.Series(["abc"]), secrets) == 0


def test_text_and_url(spark):
    df = spark.createDataFrame([("of a/b+c and a%2Fb%2Bc and a%2fb%2bc", "https://u:p@h.org/a%2fb%2Bc/abcd?q=a/b+c&x=p+q%26r%3D1&token=zz#abc", None)], "t string, u string, n string")
    r = df.select(redact_secrets(F.col("t"), SECRETS).alias("t"), safe_url("u", SECRETS).alias("u"), safe_url("n", SECRETS).alias("n")).first()
    assert r.t == f"of {MASK} and {MASK} and {MASK}" and r.n is None
    assert count_known(pd.Series([r.u]), SECRETS) == 0 and r.u.startswith(f"https://h.org/{MASK}/{MASK}?") and "zz" not in r.u


def test_trace_shows_no_secret(spark):
    url = "https://h.org/run/a%2Fb%2Bc?key=1&next=abcd"
    nodes = spark.createDataFrame([(1, "n-abc", "crawl", "got a/b+c", "running", url, None)], "seq int, id string, stage string, label string, status string, url string, issue string")
    issues = spark.createDataFrame([(1, "i", "X", "n", "crawl", "bad p+q%26r%3D1")], "seq int, id string, code string, detected_at string, stage string, message string")
    docs = spark.createDataFrame([(1, 5, "abcd title", "pending", url)], "seq int, doc_id long, title string, status string, source_url string")
    shown = trace_view(nodes, issues, docs, SECRETS).toPandas()
    assert len(shown) == 3 and sum(count_known(shown[c], SECRETS) for c in ("id", "label", "url")) == 0
