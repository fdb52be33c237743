"""Plans, documents, responses and the index end to end."""

from __future__ import annotations

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from evidra.functions import contracts as J
from evidra.operators import documents as D
from evidra.operators.merkle import Sealed
from evidra.operators import embedding as E
from evidra.operators import responses as R
from evidra.operators import retrieval as X
from evidra.plans.document_plans import check_segments


def test_plan_scope():
    p = D.plan_scope("Dân số Việt Nam giai đoạn 2020–2024. Thêm chi tiết")
    assert (p.topic, p.country, p.start_year, p.end_year, p.statistical) == ("population", "VN", 2020, 2024, True)
    assert p.queries[0] == "Vietnam population 2020 2024" and len(p.queries) == 3 and "dan" in p.terms
    assert not D.plan_scope("AI").statistical
    for bad in ("đề F", "x", "a" * 8001, "1950 to 2020"):
        with pytest.raises(D.ScopeError):
            D.plan_scope(bad)


def test_schema_and_pointer(spark):
    schema = {"type": "object", "properties": {"a": {"type": ["string", "null"], "enum": ["x", None]}, "b": {"type": "array", "items": {"type": "integer"}}}}
    assert J.schema_errors({"a": None, "b": [1]}, schema) == []
    assert J.schema_errors({"a": "y", "b": [True]}, schema) == ["$.a: enum", "$.b[0]: boolean"]
    assert J.schema_errors({"a": "x"}, schema) == ["$: keys"]
    df = spark.createDataFrame([('{"a": [{"b/c": 1}]}', "#/a/0/b~1c"), ('{"a": 1}', "#/x"), ("torn", "#/a")], "b string, p string")
    assert [r[0] for r in df.select(J.pointer("b", "p")).collect()] == ["1", None, None]
    assert spark.createDataFrame([('{"b": 1, "a": "é"}',)], "b string").select(J.canonical_json("b")).first()[0] == '{"a":"é","b":1}'
    with pytest.raises(ValueError):
        J.check_options({"pages": True})
    assert J.check_options({"pages": 3, "mode": "auto"})


@pytest.mark.parametrize(("ids", "years", "ok"), [([0], [2020], True), ([0], [2021], False), ([9], [], False), (list(range(9)), [], False), ([], [], True)])
def test_evidence_ids_and_years(spark, ids, years, ok):
    df = spark.createDataFrame([(ids, years, [(0, "in 2020"), (1, "no year")])], "i array<int>, y array<int>, s array<struct<id:int,text:string>>")
    assert df.select(J.evidence_ok(F.col("i"), F.col("y"), F.col("s"))).first()[0] is ok


def test_small_rules(spark):
    df = spark.createDataFrame([("0.965 0.969", False, " ", "https://e.org/My-File_1.PDF")], "c string, h boolean, t string, u string")
    row = df.select(J.several_numbers(F.col("c"), F.col("h")), J.metadata(F.col("t"), F.lit(None), F.lit("2"))["title"], J.file_title(F.col("u")), J.iso2(F.lit("VN"))).first()
    assert tuple(row) == (True, "untitled", "My File 1", True)


def test_segments_of_every_text(spark, tmp_path):
    """Texts of all lengths have segments, by a plain loop over their lines."""
    rows = [(1, "short\n\n \t\nlast line"), (2, "a" * 3100 + "\n" + "é" * 1500), (3, ("word " * 900 + "\n") * 6), (4, ""), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for i, text in rows:
        spans = [(m.start() + o, min(m.start() + o + 1500, m.end())) for m in re.finditer(r"[^\n]+", text or "") for o in range(0, len(m.group()), 1500)]
        spans = [(a, b) for a, b in spans if text[a:b].strip()]
        want |= {(i, k, a, b, hashlib.sha256(text[a:b].encode()).hexdigest()) for k, (a, b) in enumerate(spans)}
    got = [tuple(r) for r in check_segments(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want and {g[0] for g in got} == {1, 2, 3}


def test_segments_and_alignment(spark):
    w = spark.createDataFrame([(1, 10, "ab\n\n  \n" + "x" * 1600)], "doc_id long, start int, text string")
    got = [(r.id, r.start, r.end) for r in D.segments(w).orderBy("id").collect()]
    assert got == [(0, 10, 12), (1, 17, 1517), (2, 1517, 1617)]
    df = spark.createDataFrame([("a b\nc", ["a b", "c"]), ("a b c", ["a", "c"]), ("a b", ["a"])], "t string, p array<string>")
    out = [r[0] for r in df.select(D.aligned("t", "p", F.lit(2))).collect()]
    assert [c.text for c in out[0].chunks] == ["a ", "b", "c"] and out[1].chunks is None and out[2].error


def test_page_projections(spark):
    df = spark.createDataFrame([([("r1", 0, 5), ("r2", 7, 9)], [("r2", [(0, "M"), (3, "MISSING_GRID_CELLS")])])], "items array<struct<ref:string,char_start:int,char_end:int>>, tables array<struct<locator:string,warnings:array<struct<cell_index:int,code:string>>>>")
    touched = D.items_of_span(F.col("items"), F.lit(5), F.lit(8))
    row = df.select(F.transform(touched, lambda x: x["ref"]), F.size(D.warnings_of_page(F.array(F.lit("r2")), F.col("tables"))), F.size(D.warnings_of_row(F.array(F.lit(9)), F.col("tables")[0]["warnings"]))).first()
    assert tuple(row) == (["r2"], 2, 1)


def test_fidelity_and_files(spark):
    schema = "table_id int, row int, column int, text string, rowspan int, colspan int, header boolean"
    a = spark.createDataFrame([(1, 0, 0, "a", 1, 1, True), (1, 0, 1, "b", 1, 1, False)], schema)
    b = spark.createDataFrame([(1, 0, 0, "a", 1, 1, True), (1, 0, 1, "B", 1, 1, False), (1, 1, 0, "c", 1, 1, False)], schema)
    assert sorted(tuple(r)[1:] for r in D.cell_fidelity(a, b).collect()) == [(0, 1, False, False), (1, 0, True, False)]
    docs = spark.createDataFrame([(1, "x"), (2, "x")], "doc_id long, source_sha256 string").withColumn("source_sha256", F.sha2(F.lit("body"), 256))
    files = spark.createDataFrame([(1, bytearray(b"body"))], "doc_id long, content binary")
    assert sorted(tuple(r) for r in D.original_intact(docs, files).collect()) == [(1, True), (2, False)]


def test_import_is_idempotent(spark):
    run = spark.createDataFrame([("p1", "s1"), ("p2", "s2")], "parsed_path string, raw_sha256 string")
    series = spark.createDataFrame([("a", "r1", "h1"), ("a", "r1", "h1"), ("b", "r2", "h2"), ("b", "r3", "h3")], "series_id string, raw_path string, raw_sha256 string")
    none = spark.createDataFrame([], "parsed_path string, raw_sha256 string")
    first = D.imported(run, series, none)
    assert sorted(r.parsed_path for r in first.collect()) == ["p1", "p2", "r1"]
    assert D.imported(run, series, first.select("parsed_path", "raw_sha256")).count() == 0


def test_responses(spark):
    whole = {"status": "completed", "output": [{"type": "message", "content": [{"type": "output_text", "text": "a"}, {"type": "x", "text": "no"}, {"type": "output_text", "text": "b"}]}]}
    rows = [("responses", json.dumps(whole)), ("responses", json.dumps(whole | {"status": "incomplete"})), ("choices", json.dumps({"choices": [{"finish_reason": "stop", "message": {"content": "c"}}]})), ("choices", json.dumps({"choices": [{"finish_reason": "length", "message": {"content": "c"}}]})), ("candidates", json.dumps({"candidates": [{"finishReason": "STOP", "content": {"parts": [{"text": "think", "thought": True}, {"text": "d"}]}}]})), ("candidates", "torn")]
    df = spark.createDataFrame(rows, "t string, body string")
    assert [r[0] for r in df.select(R.text_of(R.parsed(F.col("body")), F.col("t"))).collect()] == ["ab", None, "c", None, "d", None]
    messages = ["AI_HTTP_429: request failed; provider body omitted", "AI_NETWORK_ERROR: request failed", "secret text"]
    got = [r[0] for r in spark.createDataFrame([(m,) for m in messages], "m string").select(R.safe_error(F.col("m"))).collect()]
    assert got == ["AI_HTTP_429", "AI_NETWORK_ERROR", "PIPELINE_FAILED"]
    a = spark.createDataFrame([(1, "x", True), (2, "y", False), (3, "z", False)], "id int, answer string, ok boolean")
    b = spark.createDataFrame([(2, "y2", True), (3, "z2", False)], "id int, answer string, ok boolean")
    assert sorted(tuple(r) for r in R.repaired(a, b).collect()) == [(1, "x", "accepted"), (2, "y2", "accepted"), (3, None, "rejected")]
    ranks, candidates = spark.createDataFrame([(1,), (1,), (9,)], "id int"), spark.createDataFrame([(1,), (2,)], "id int")
    assert tuple(R.ranking_complete(ranks, candidates).first()) == (1, 1, 1)


def test_index_life(spark, tmp_path):
    path, dims = f"file://{tmp_path}/index", 8
    calls: list[int] = []
    stub = E.hashed_embedder(dims)

    def embed(texts):
        calls.append(len(texts))
        return stub(texts)

    chunks = spark.createDataFrame([(f"c{i}", i, "s", 10 * i, 10 * i + 10, f"text number {'needle' if i == 4 else i}") for i in range(9)], "chunk_id string, seq long, section string, char_start long, char_end long, text string")
    cache = spark.createDataFrame([], "cache_key string, vector array<double>")
    assert X.build(chunks, cache, path, "m", dims, stub)["status"] == "ready_partial"
    got = X.retrieve(X.Index(spark, path), "needle", "m", dims, embed, top_k=1).first()
    assert got.status == "evidence" and {"c4", "c3", "c5"} >= {e.chunk_id for e in got.evidence} and len(calls) == 1
    assert got.used <= 6000 - 150
    empty = X.retrieve(X.Index(spark, path), "needle", "m", dims, embed, ratings=chunks.select(F.col("chunk_id").alias("id"), F.lit(0).alias("rating"))).first()
    assert (empty.status, empty.evidence) == ("no_relevant_evidence", [])
    before = len(calls)
    outside = X.retrieve(X.Index(spark, path), "needle", "m", dims, embed, in_scope=lambda q: False).first()
    assert outside.status == "outside_scope" and len(calls) == before
    with pytest.raises(X.StaleIndexError):
        X.retrieve(X.Index(spark, path), "needle", "other", dims, embed)
    with pytest.raises(ValueError):
        X.retrieve(X.Index(spark, path), "needle", "m", dims, embed, budget=100)
    index = X.Index(spark, path)
    table = Sealed(spark, f"{path}/{index.manifest['postings']}", index.manifest["postings_root"])
    leaf = f"{table.path}/rows/leaf={min(table.proven_leaves(['needle']))}"
    spark.read.parquet(leaf).limit(1).write.mode("append").parquet(leaf)
    with pytest.raises(X.StaleIndexError, match="postings"):
        X.retrieve(index, "needle", "m", dims, embed)
    chunks.withColumn("vector", F.array(F.lit(1.0))).write.mode("overwrite").parquet(f"{path}/chunks")
    with pytest.raises(X.StaleIndexError):
        X.retrieve(X.Index(spark, path), "needle", "m", dims, embed)
    with pytest.raises(ValueError):
        X.build(chunks, cache, path, "m", dims, stub, max_chunks=3)
    with pytest.raises(X.StaleIndexError):
        X.Index(spark, path).check("m", dims)


def test_a_build_deals_out_shared_texts_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(E, "KEY_BITS", 64)
    dims, asked = 4, spark.sparkContext.accumulator(0)
    stub = E.hashed_embedder(dims)

    def embed(texts):
        asked.add(len(texts))
        return stub(texts)

    texts = [f"own {i}" for i in range(40)] + ["twice"] * 2 + ["often"] * 30 + ["known"] * 2 + ["known once"]
    chunks = spark.createDataFrame([(f"c{i}", i, "s", 10 * i, 10 * i + 10, t) for i, t in enumerate(texts)], "chunk_id string, seq long, section string, char_start long, char_end long, text string")
    cached = [1.0, 2.0, 3.0, 4.0]
    cache = spark.createDataFrame([("known", cached), ("known once", cached), ("other", cached)], "text string, vector array<double>").select(E.cache_key("m", dims, F.col("text")).alias("cache_key"), "vector")
    path = f"file://{tmp_path}/index"
    got = X.build(chunks, cache, path, "m", dims, embed)
    rows = X.Index(spark, path).chunks.collect()
    # Each text that the cache lacks is asked for once, however many chunks hold it.
    assert asked.value == 42 and got["chunk_count"] == len(rows) == len(texts) == len({r.ord for r in rows})
    assert {r.chunk_id: (r.seq, r.section, r.char_start, r.char_end, r.text) for r in rows} == {f"c{i}": (i, "s", 10 * i, 10 * i + 10, t) for i, t in enumerate(texts)}
    assert all(r.vector == (cached if r.text.startswith("known") else stub([r.text])[0].tolist()) for r in rows)
    assert got["avgdl"] == sum(len(t.split()) for t in texts) / len(texts)
    by_ord = {r.ord: r.text for r in rows}
    posted = {(by_ord[r.doc_id], r.term, r.tf, r.dl) for r in X.Index(spark, path).postings(["often", "own", "7", "none"]).collect()}
    assert posted == {("often", "often", 1, 1), *((f"own {i}", "own", 1, 2) for i in range(40)), ("own 7", "7", 1, 2)}


def test_a_text_of_its_own_stays_where_it_is(spark):
    keyed = spark.range(300).select(F.sha2(F.col("id").cast("string"), 256).alias("cache_key"), "id")
    marked = E.maybe_shared(keyed, keyed.where("id < 20").select(F.xxhash64("cache_key").alias("h")))
    assert {r.id for r in marked.where("shared").collect()} == set(range(20))
    few = E.maybe_shared(keyed, keyed.where("id < 20").select(F.xxhash64("cache_key").alias("h")), 64)
    assert set(range(20)) <= {r.id for r in few.where("shared").collect()} and few.count() == 300
    plan = marked.where("not shared")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_a_build_writes_no_more_than_it_needs(spark, tmp_path):
    import random
    from pathlib import Path

    from evidra.sources.folders import shared_folder

    def shuffled():
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    # Marks only, so there are no words; half a MB that doesn't shrink much.
    rng = random.Random(5)
    texts = ["".join(rng.choices("!#$%&()*+,-./:;<=>?@[]^_{|}~", k=400)) for _ in range(1200)]
    chunks = spark.createDataFrame([(f"c{i}", i, "s", 400 * i, 400 * i + 400, t) for i, t in enumerate(texts)], "chunk_id string, seq long, section string, char_start long, char_end long, text string")
    cache = spark.createDataFrame([], "cache_key string, vector array<double>")
    kept = Path(shared_folder(spark).removeprefix("file://"), "evidra")
    before, there = shuffled(), set(kept.glob("*"))
    X.build(chunks, cache, f"file://{tmp_path}/index", "m", 4, E.hashed_embedder(4))
    assert shuffled() - before < 100_000
    assert set(kept.glob("*")) == there
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
