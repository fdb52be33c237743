"""Readers, sinks and streaming jobs."""

from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from evidra.operators import embedding as E
from evidra.sources import readers as R
from evidra.sources import sinks as S
from evidra.streaming import jobs as J


def envelope(total=None, **meta):
    rows = [{"country": {"id": "VN"}, "countryiso3code": "VNM", "indicator": {"id": "I"}, "date": str(y), "value": v, "unit": ""} for y, v in ((2021, 5), (2020, None))]
    return json.dumps([{"page": 1, "pages": 1, "total": 2 if total is None else total, "sourceid": "2", "lastupdated": "2026-07-13"} | meta, rows])


def test_envelope(spark):
    df = spark.createDataFrame([("good", envelope()), ("pages", envelope(pages=2)), ("total", envelope(total=5)), ("torn", "[{")], "series_id string, body string")
    got = {(r.series_id, r.position): r for r in R.envelope_rows(df).collect()}
    assert got["good", 0].envelope_ok and got["good", 1].value is None and got["good", 0].unit == ""
    assert not got["pages", 0].envelope_ok and not got["total", 0].envelope_ok and not got["torn", None].envelope_ok
    ok = R.envelope_rows(df).where(R.metadata_ok(df)).select("series_id").distinct().count()
    assert ok == 3


def test_xml(spark):
    row = '<wb:data><wb:indicator id="I">i</wb:indicator><wb:country id="VN">v</wb:country><wb:countryiso3code>VNM</wb:countryiso3code><wb:date>{}</wb:date>{}</wb:data>'
    body = '<?xml version="1.0"?><wb:data page="1" pages="1" total="2" xmlns:wb="http://www.worldbank.org">' + row.format(2021, "<wb:value>5</wb:value>") + row.format(2020, "<wb:value />") + "</wb:data>"
    got = sorted(tuple(r) for r in R.xml_rows(spark.createDataFrame([("s", body)], "series_id string, body string")).select("position", "envelope_ok", "country", "date", "value").collect())
    assert got == [(0, True, "VN", "2021", 5.0), (1, True, "VN", "2020", None)]


def test_bodies(spark):
    rows = [("gzip", bytearray(gzip.compress(b"a") + gzip.compress(b"b"))), ("gzip", bytearray(gzip.compress(b"abc")[:-3])), ("br", bytearray(b"x")), (None, bytearray(b"y")), ("gzip", bytearray(gzip.compress(b"0" * 10_000_001)))]
    df = spark.createDataFrame(rows, "e string, b binary").select(R.decoded_body("e", "b").alias("d"))
    got = [(r.d.body and bytes(r.d.body), r.d.error) for r in df.collect()]
    assert got == [(b"ab", None), (None, "damaged body"), (None, "unknown encoding"), (b"y", None), (None, "body too large")]


def test_missing_and_empty_bodies(spark):
    rows = [("gzip", b""), ("gzip", None), (None, None), ("identity", b""), ("gzip", gzip.compress(b"")), ("identity", b"abcd"), ("gzip", gzip.compress(b"abcd")), ("gzip", gzip.compress(b"0" * 99))]
    df = spark.createDataFrame([(e, None if b is None else bytearray(b)) for e, b in rows], "e string, b binary")
    got = [(r.d.body if r.d.body is None else bytes(r.d.body), r.d.error) for r in df.select(R.decoded_body("e", "b").alias("d")).collect()]
    assert got == [(None, "damaged body"), (None, "damaged body"), (None, None), (b"", None), (b"", None), (b"abcd", None), (b"abcd", None), (b"0" * 99, None)]
    assert [r.d.error for r in df.select(R.decoded_body("e", "b", 30).alias("d")).collect()][3:] == [None] * 4 + ["body too large"]


def test_bodies_equal_their_sql(spark, tmp_path):
    import duckdb

    from evidra.plans import catalogue

    texts = [None, "", "a", "\x1f", "é" * 3, "x" * 600_001, "y" * 10_000_001]
    docs = [(i, texts[(i + i // 7) % 7]) for i in range(-4, 45)] + [(None, None), (None, "a"), (None, texts[5])]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = catalogue.QUERIES["bodies"](spark, f"file://{tmp_path}").collect()
    want = duckdb.sql(f"WITH documents AS (SELECT * FROM '{tmp_path}/documents.parquet/*.parquet') " + catalogue.ORACLES["bodies"]).fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(got) == len(docs)


def test_types(spark):
    rows = [("a.pdf", bytearray(b"%PDF-1"), "application/pdf"), ("a.pdf", bytearray(b"x"), None), ("a.txt", bytearray(b"%PDF-1"), None), ("a.exe", bytearray(b"x"), None), ("a.md", bytearray(b"\xff"), None)]
    df = spark.createDataFrame(rows, "n string, c binary, t string").select(R.upload_type(F.col("n"), F.col("c")), R.text_upload(F.col("c")))
    got = df.collect()
    assert [r[0] for r in got] == ["application/pdf", None, None, None, "text/markdown"]
    assert got[4][1] is None and got[3][1] == "x"


def test_json_documents(spark, tmp_path):
    for name, status in (("document-1", "review"), ("unassessed-document-2", "review"), ("document-3", "out_of_scope")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"title": name, "text": "t", "status": status}))
    got = R.parsed_documents(spark, f"file://{tmp_path}", "title string, text string, status string").collect()
    assert [r.title for r in got] == ["document-1"]
    (tmp_path / "b.json").write_text(json.dumps({"country_iso3": "VNM", "indicator_id": "I", "source_id": "2", "values": {"2020": 1, "2021": 2}}))
    assert sorted((r.year, r.value) for r in R.pinned_benchmark(spark, f"file://{tmp_path}/b.json").collect()) == [(2020, 1), (2021, 2)]


def test_safe_json(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('{"a"',), (None,)], "b string").select(R.safe_json(F.col("b"), "a int")["a"])
    assert [r[0] for r in df.collect()] == [1, None, None]


def test_plan_contract(spark):
    schema = "concepts array<array<string>>, queries array<string>, country string, start_year int, end_year int, brief_start int, brief_end int, denominator string, brief string"
    good = ([["crime", "offences"]], ["q"], "VN", 2020, 2021, 2020, 2021, "people", "crimes a thousand people")
    bad = ([["ab"]], ["http://x"], "vn", 2020, 2022, 2020, 2021, "cars", "crimes")
    got = R.plan_violations(spark.createDataFrame([good, bad], schema)).select("violations").collect()
    assert [r[0] for r in got] == [[], ["concepts", "queries", "country", "years", "denominator"]]


def test_publish(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.range(5)
    assert S.publish(df, path, {"small": F.col("id") < 9}) == {"rows": 5, "small": 0}
    with pytest.raises(S.AuditError):
        S.publish(spark.range(50), path, {"small": F.col("id") < 9})
    assert spark.read.parquet(path).count() == 5
    S.publish(spark.range(7), path)
    assert spark.read.parquet(path).count() == 7 and len(list(tmp_path.iterdir())) == 1


def test_freeze_once(spark, tmp_path):
    store = f"file://{tmp_path}/s"
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "c string")
    assert S.freeze(df, store, "c").count() == 2
    assert S.freeze(df.union(spark.createDataFrame([("d",)], "c string")), store, "c").count() == 1
    assert spark.read.parquet(store).count() == 3


def test_manifest_ignores_order(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "i long, t string"), spark.createDataFrame([(2, None), (1, "x")], "i long, t string")
    c = spark.createDataFrame([(1, "x"), (2, "")], "i long, t string")
    digest = lambda d: S.manifest(d, ["i", "t"]).first().digest
    assert digest(a) == digest(b) != digest(c)


def test_review_stream(spark, tmp_path):
    schema = "doc_id long, seq long, revision long, action string, actor string, note string"
    spark.createDataFrame([(1, 1, 1, "approve", "a", ""), (1, 2, 2, "withdraw", "a", "n"), (2, 1, 5, "approve", "a", "")], schema).write.parquet(str(tmp_path / "in"))
    q = J.review_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("reviewed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.doc_id, r.seq, r.status, r.outcome) for r in spark.table("reviewed").collect())
    assert got == [(1, 1, "approved", "applied"), (1, 2, "withdrawn", "applied"), (2, 1, "pending", "stale")]


def test_embed_stream_is_incremental(spark, tmp_path):
    schema = "chunk_id long, seq long, text string"
    spark.createDataFrame([(1, 1, "a"), (2, 2, "a"), (3, 3, "b")], schema).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    cache = str(tmp_path / "cache")
    J.embed_stream(source(), cache, str(tmp_path / "cp"), "m", 4, E.hashed_embedder(4)).awaitTermination(120)
    assert spark.read.parquet(cache).count() == 2
    spark.createDataFrame([(4, 4, "b"), (5, 5, "c")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    J.embed_stream(source(), cache, str(tmp_path / "cp"), "m", 4, E.hashed_embedder(4)).awaitTermination(120)
    assert spark.read.parquet(cache).count() == 3


def test_last_wins_takes_null_places_last(spark):
    rows = [("a", 1, "x"), ("a", 3, "y"), ("a", None, "z"), ("b", None, "n"), (None, 2, "k")]
    got = S.last_wins(spark.createDataFrame(rows, "key string, seq int, v string"), ["key"], "seq")
    assert got.columns == ["key", "seq", "v"]
    assert {tuple(r) for r in got.collect()} == {("a", 3, "y"), ("b", None, "n"), (None, 2, "k")}
