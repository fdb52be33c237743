"""Runs, traces, strict gates, versions, chunks of sections, review gate, readers of parses."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evidra.operators import chunks as C
from evidra.operators import lineage as L
from evidra.operators import review as R
from evidra.operators import runs as U
from evidra.operators import search as S
from evidra.operators import series as D
from evidra.sources import folders
from evidra.sources import readers


def rows(df, *keys):
    return sorted((tuple(r) for r in df.select(*keys).collect()), key=repr)


# Review


def ledger_doc(**more):
    base = {"collection": "c", "source_id": "s", "document_version": "1", "effective_from": "2026-01-01", "effective_to": None, "digest": "d", "n_chunks": 1, "text_error": False, "text_warning": False, "partial": False, "n_warnings": 0, "duplicate": False, "time_sensitive": False, "proven": True}
    return base | more


def event(action="approve", revision=1, **more):
    return {"action": action, "revision": revision, "actor": "ann", "note": "why", "acknowledge": False, "mode": "manual"} | {"new_" + c: None for c in R._CHANGE} | more


def outcome(book, doc_id, given, *events):
    return [book.apply(doc_id, given, e)[2] for e in events][-1]


def test_approvals_need_chunks_no_errors_and_confirmed_warnings():
    for given, e, want in (
        (ledger_doc(), event(), "applied"),
        (ledger_doc(n_chunks=0), event(), "blocked"),
        (ledger_doc(text_error=True), event(acknowledge=True), "blocked"),
        (ledger_doc(partial=True), event(acknowledge=True), "blocked"),
        (ledger_doc(time_sensitive=True, effective_from=None), event(acknowledge=True), "blocked"),
        (ledger_doc(text_warning=True), event(), "not_acknowledged"),
        (ledger_doc(duplicate=True), event(acknowledge=True), "applied"),
        (ledger_doc(), event(mode="automatic"), "not_eligible"),
        (ledger_doc(), event(mode="automatic", actor=R.AUTOMATIC), "applied"),
        (ledger_doc(proven=False), event(mode="automatic", actor=R.AUTOMATIC), "not_eligible"),
        (ledger_doc(), event(revision=2), "stale"),
        (ledger_doc(), event("withdraw"), "conflict"),
        (ledger_doc(), event("reject", note=" "), "invalid"),
    ):
        assert outcome(R.Ledger(), 1, given, e) == want


def test_approvals_of_one_source_and_text():
    book = R.Ledger()
    assert outcome(book, 1, ledger_doc(effective_to="2026-02-01"), event()) == "applied"
    assert outcome(book, 2, ledger_doc(digest="e"), event()) == "version_exists"
    assert outcome(book, 3, ledger_doc(digest="f", document_version="2", effective_from="2026-01-15"), event()) == "period_overlaps"
    assert outcome(book, 4, ledger_doc(digest="f", document_version="2", effective_from="2026-02-01"), event()) == "applied"
    assert outcome(book, 5, ledger_doc(source_id="t"), event()) == "content_exists"
    assert outcome(book, 6, ledger_doc(source_id="t", collection="other"), event()) == "applied"
    assert outcome(book, 1, ledger_doc(), event("withdraw", 2)) == "applied"
    assert outcome(book, 5, ledger_doc(source_id="t"), event()) == "applied"


def test_edits():
    book, given = R.Ledger(), ledger_doc(partial=True)
    assert outcome(book, 1, given, event("edit", 2)) == "stale"
    assert outcome(book, 1, given, event("edit", new_effective_to="2025-01-01")) == "invalid"
    assert book.apply(1, given, event("edit", new_document_version="2")) == ("pending", 2, "applied", "d", "imported")
    assert book.apply(1, given, event("edit", 2, new_digest="e", new_n_chunks=2)) == ("pending", 3, "applied", "e", R.EDITED_PARSER)
    assert outcome(book, 1, given, event(revision=3)) == "not_acknowledged"
    assert outcome(book, 1, given, event(revision=3, acknowledge=True)) == "applied"
    assert outcome(book, 1, given, event("edit", 4)) == "conflict"


def test_gate_and_evidence(spark):
    docs = spark.createDataFrame([(i, *ledger_doc(source_id=s, digest=f"d{i}", document_version=str(i)).values()) for i, s in ((1, "a"), (2, "a"), (3, "b"))], "doc_id long, collection string, source_id string, document_version string, effective_from string, effective_to string, digest string, n_chunks int, text_error boolean, text_warning boolean, partial boolean, n_warnings int, duplicate boolean, time_sensitive boolean, proven boolean")
    events = spark.createDataFrame([(2, 1, "approve", 1), (1, 2, "approve", 1), (3, 3, "approve", 1), (3, 4, "withdraw", 2), (1, 5, "approve", None)], "doc_id long, seq long, action string, revision long").withColumns({"actor": F.lit("ann"), "note": F.lit("n"), "acknowledge": F.lit(False), "mode": F.lit("manual")})
    found = R.gate(docs, events)
    assert rows(found, "doc_id", "seq", "outcome") == [(1, 2, "period_overlaps"), (1, 5, "stale"), (2, 1, "applied"), (3, 3, "applied"), (3, 4, "applied")]
    assert rows(R.evidence_changes(found), "doc_id", "change") == [(2, "insert"), (3, "delete")]
    assert R.gate(docs, events.where("false")).count() == 0


def test_intervals_and_days(spark):
    df = spark.sql("SELECT * FROM VALUES (1, DATE'2026-01-01', DATE'2026-01-02'), (2, DATE'2026-01-01', DATE'2026-01-01'), (3, NULL, DATE'2026-01-01'), (4, NULL, NULL) t(i, a, b)")
    assert rows(df, "i", R.valid_interval(F.col("a"), F.col("b"))) == [(1, True), (2, False), (3, False), (4, True)]
    assert str(spark.range(1).select(R.local_today(F.lit("2026-01-01 17:00:00").cast("timestamp"))).first()[0]) == "2026-01-02"


def test_newest_earlier_copy(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 4)
    docs = spark.createDataFrame([(i, i, "c", "x" if i % 3 else "y") for i in range(20)], "doc_id long, seq long, collection string, source_sha256 string")
    want = [(i, j) for i in range(20) for j in [max((j for j in range(i) if (j % 3 > 0) == (i % 3 > 0)), default=None)] if j is not None]
    assert rows(R.duplicates(docs), "doc_id", "duplicate_of") == sorted(want, key=repr)


# Lineage


def test_explain_walks_depth_first(spark):
    nodes = [("a", [], None, None), ("b", ["a"], "p", "old"), ("c", ["a"], None, None), ("d", ["c", "b", "a"], None, None), ("e", ["d", "b"], "q", None), ("x", [], None, None)]
    table = spark.createDataFrame(nodes, "id string, parents array<string>, path string, sha256 string")
    issues = spark.createDataFrame([("e1", "d")], "id string, detected_at string")
    files = spark.createDataFrame([("p", bytearray(b"x"))], "path string, content binary")
    found = L.explain(table, issues, spark.createDataFrame([("e1",), ("e",), ("nothing",)], "id string"), files)
    got = {}
    for r in found.orderBy("target", "place").collect():
        got.setdefault(r.target, []).append((r.node, r.intact))
    assert [n for n, _ in got["e1"]] == ["d", "c", "a", "b"] and [n for n, _ in got["e"]] == ["e", "d", "c", "a", "b"]
    assert dict(got["e1"])["b"] is False and dict(got["e1"])["c"] is None and set(got) == {"e1", "e"}


def test_stage_log(spark):
    log = L.StageLog()
    with pytest.raises(PermissionError), log.stage("scope", "outer"), log.stage("search", "inner"):
        error = PermissionError("no")
        error.code = 403
        raise error
    with log.stage("save", "fine"):
        log.node("check", "inside")
    with pytest.raises(ValueError):
        log.node("x", "y", parents=["n99999"])
    nodes, issues = log.tables(spark)
    assert rows(issues, "code", "detected_at", "stage") == [("AUTH_FAILED", "n00002", "search")]
    assert rows(nodes, "id", "status", "issue", "parents") == [("n00001", "failed", "e00001", []), ("n00002", "failed", "e00001", ["n00001"]), ("n00003", "success", None, []), ("n00004", "success", None, ["n00003"])]


# Chunks


def test_section_chunks(spark):
    schema = "parsed_path string, title string, source_note string, text string, pages array<struct<page:int,text:string>>, rows array<struct<k:int>>, tables array<struct<grid:array<array<struct<text:string>>>>>"
    docs = spark.createDataFrame([("p", "T", "note", "x" * 250, None, [(1,)], [([[("a",)], [("b",)]],)]), ("q", "T", None, "ignored", [(1, "one"), (2, "")], [], [])], schema)
    found = C.make_chunks(docs, 100)
    assert all(len(r.text) <= 100 for r in found.collect())
    assert rows(found.groupBy("parsed_path", "kind").count(), "parsed_path", "kind", "count") == [("p", "row", 1), ("p", "table", 2), ("p", "text", 3), ("q", "page", 1)]
    assert found.select("chunk_id").distinct().count() == 7 and found.select("document_version").distinct().count() == 2
    wide = docs.where("parsed_path = 'p'").withColumn("tables", F.expr(f"array(named_struct('grid', array(array(named_struct('text', repeat('w', 200))))))"))
    with pytest.raises(Exception, match="too wide"):
        C.make_chunks(wide, 100).collect()
    with pytest.raises(Exception, match="no room"):
        C.make_chunks(docs, 50).collect()


def test_versions_follow_parser_and_content(spark):
    d = spark.createDataFrame([(1, "t", "p", "r"), (2, "t", "p", "r"), (3, "u", "p", "r"), (4, "t", "q", "r"), (5, "t", "p", None)], "i long, text string, parser string, raw_sha256 string")
    got = dict(rows(d, "i", C.document_version(d)))
    assert got[1] == got[2] and len(set(got.values())) == 4
    assert C.document_version(d, "other") is not None and dict(rows(d, "i", C.document_version(d, "other")))[1] != got[1]


# Series


def series(spark, *changes):
    base = {"series_id": "s", "position": 0, "country": "VN", "iso3": "VNM", "indicator": "I", "expected_country": "VN", "expected_iso3": "VNM", "expected_indicator": "I", "date": "2020", "value": 1.0, "sourceid": "2", "lastupdated": "x"}
    two = [base, base | {"position": 1, "date": "2021"}]
    for k, change in changes:
        two[k] = two[k] | change
    return spark.createDataFrame([tuple(r.values()) for r in two], "series_id string, position int, country string, iso3 string, indicator string, expected_country string, expected_iso3 string, expected_indicator string, date string, value double, sourceid string, lastupdated string")


@pytest.mark.parametrize(
    ("changes", "want"),
    [
        ((), []),
        (((1, {"sourceid": "3"}), (0, {"country": "XX"})), [("WRONG_SOURCE", None)]),
        (((0, {"lastupdated": ""}), (1, {"lastupdated": ""})), [("NO_UPDATE_DATE", None)]),
        (((1, {"iso3": "XXX"}), (0, {"value": -1.0})), [("INVALID_VALUE", 0)]),
        (((1, {"date": "2020"}),), [("YEAR_OUT_OF_SCOPE_OR_REPEATED", 1)]),
        (((0, {"date": "MMXX"}),), [("INVALID_YEAR", 0)]),
        (((1, {"value": 1.5}),), [("NOT_INTEGER", 1)]),
        (((1, {"indicator": None}),), [("WRONG_INDICATOR", 1)]),
    ],
)
def test_pilot_gate(spark, changes, want):
    assert rows(D.pilot_gate(series(spark, *changes), 2020, 2021), "code", "position") == want
    assert rows(D.pilot_gate(series(spark), 2019, 2021), "code") == [("MISSING_YEARS",)]


def test_catalogue_needs_one_exact_metric(spark):
    c = spark.createDataFrame([("https://data.worldbank.org/x", "t", ["q"], 3, 0, False), ("https://e.org/", "t", ["r"], 3, 0, False)], "url string, title string, search_queries array<string>, relevance int, priority int, catalog_verified boolean")
    metrics = [("SP.POP", "Population, total", "2"), ("X", "Population, total", "57"), ("Y", "Population, male", "2")]
    m = spark.createDataFrame(metrics, "id string, name string, source_id string")
    out = D.expand_catalog(c, m, "population", "VN")
    assert rows(out.where("catalog_verified"), "url", "search_queries") == [("https://data.worldbank.org/indicator/SP.POP?locations=VN", ["q"])] and out.count() == 3
    twice = m.unionAll(spark.createDataFrame([("Z", "POPULATION, TOTAL", "2")], m.schema))
    for candidates, catalogue, topic, country in ((c, twice, "population", "VN"), (c.where("url like '%e.org%'"), m, "population", "VN"), (c, m, "GDP", "VN"), (c, m, "population", None)):
        assert D.expand_catalog(candidates, catalogue, topic, country).where("catalog_verified").count() == 0


# Runs and readers


def test_context_and_saved_evidence(spark, tmp_path):
    log = L.StageLog()
    manifest, chunk = log.node("index", "m"), log.node("chunk", "c")
    bundle = spark.createDataFrame([(1, "some evidence")], "i int, text string")
    node = U.persist_context(bundle, f"file://{tmp_path}", ["c"], [chunk["id"]], manifest["id"], log)
    assert [n["stage"] for n in log.nodes] == ["index", "chunk", "retrieval", "context", "context"] and log.nodes[3]["id"] == node and log.nodes[3]["parents"] == ["n00003", chunk["id"]]
    with pytest.raises(ValueError):
        U.persist_context(bundle, f"file://{tmp_path}", ["c"], [], manifest["id"], log, budget=2)
    U.save_evidence(bundle, f"file://{tmp_path}/last", "why?")
    now = spark.createDataFrame([(1, 1, "x")], "id long, revision long, sha256 string")
    assert rows(U.last_evidence(spark, f"file://{tmp_path}/last", now, now), "i", "question") == [(1, "why?")]
    with pytest.raises(RuntimeError):
        U.last_evidence(spark, f"file://{tmp_path}/last", now, now.withColumn("revision", F.lit(2).cast("long")))
    assert "scope" in U.missing_outputs(spark, f"file://{tmp_path}")


def test_changed_originals_stop_an_index(spark):
    docs = spark.createDataFrame([(1, "approved", "t", "a")], "doc_id long, status string, text string, source_sha256 string").withColumns({c: F.lit(None).cast("string") for c in ("parsed_text", "parser_evidence")} | {"edited": F.lit(False), "review_warnings": F.array().cast("array<string>"), "parse_warnings": F.array().cast("array<string>")})
    files = spark.createDataFrame([(1, bytearray(b"t"))], "doc_id long, content binary")
    with pytest.raises(Exception, match="changed original of 1"):
        U.index_input(docs, files).collect()
    assert U.index_input(docs.withColumn("source_sha256", F.sha2("text", 256)), files).count() == 1


def test_routes():
    models = [U.Model("m", "p", ("search",), ("g",)), U.Model("e", "p", ("embedding",), ("g",), 8)]
    defaults = {"search": "m", "embedding": "e"}
    assert U.routes(models, defaults, "g")["embedding"].dimensions == 8
    for group, chosen in (("g", {"search": "e"}), ("h", None), ("g", {"other": "m"})):
        with pytest.raises(ValueError):
            U.routes(models, defaults, group, chosen)


def test_parse_cache(spark):
    files = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2")), ("c", bytearray(b"3"))], "path string, content binary")
    keyed = files.select("path", readers.cache_key(F.col("content"), "{}", "w").alias("key"), F.lit("doc").alias("document"))
    cache = keyed.where("path <> 'c'").withColumn("sha256", F.when(F.col("path") == "a", F.sha2("document", 256)).otherwise("old"))
    assert rows(readers.cached_parses(files, cache, "{}", "w"), "path", "document", "state") == [("a", "doc", "hit"), ("b", None, "changed"), ("c", None, "miss")]
    assert rows(readers.cached_parses(files, cache, "{}", "w2"), "state") == [("miss",)] * 3


def test_postings_give_the_same_scores(spark, tmp_path):
    docs = spark.createDataFrame([(i, "needle " * (i % 3) + "hay " * i) for i in range(30)] + [(99, None)], "id long, text string")
    stats = S.write_postings(docs, "id", "text", f"file://{tmp_path}/p")
    one = dict(rows(S.bm25(docs, "id", "text", ["needle", "hay", "needle"]), "doc_id", "score"))
    two = dict(rows(S.bm25_index(spark.read.parquet(f"file://{tmp_path}/p"), stats["n"], stats["avgdl"], ["needle", "hay", "needle"]), "doc_id", "score"))
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k]) for k in one)
    assert S.bm25_index(spark.read.parquet(f"file://{tmp_path}/p"), 1, 1.0, []).count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(RuntimeError):
        folders.shared_folder(Session)


def test_small_tables_are_dealt_out(spark, tmp_path, monkeypatch):
    from evidra import session

    one, many = f"file://{tmp_path}/one", f"file://{tmp_path}/many"
    spark.range(100).coalesce(1).write.parquet(one)
    spark.range(100).repartition(2 * spark.sparkContext.defaultParallelism).write.parquet(many)
    plan = lambda path: session.dealt(spark.read.parquet(path))._jdf.queryExecution().toString()
    assert "RoundRobin" in plan(one) and "RoundRobin" not in plan(many)
    assert session.dealt(spark.read.parquet(one)).count() == 100
    monkeypatch.setattr(session, "SMALL", 1)
    assert "RoundRobin" not in plan(one)


def test_section_audit_finds_each_fault(spark):
    schema = "parsed_path string, title string, source_note string, text string, pages array<struct<page:int,text:string>>, rows array<struct<k:int>>, tables array<struct<grid:array<array<struct<text:string>>>>>"
    docs = spark.createDataFrame([("p", "T", None, "y" * 150, None, [(1,)], [])], schema)
    chunks = C.make_chunks(docs, 100)
    index = chunks.select("chunk_id", "text")
    failed = lambda c, i=index, d=docs: {r.check for r in C.audit_sections(c, i, d, 100).where("failed > 0").collect()}
    assert failed(chunks) == set()
    assert failed(chunks.withColumn("text", F.concat("text", F.lit("!")))) == {"span_equal", "id_recomputed", "index_equal", "within_limit"}
    assert failed(chunks.withColumn("kind", F.lit("figure"))) >= {"kind_known", "span_equal"}
    assert failed(chunks, index.limit(1)) == {"index_equal"}
    assert failed(chunks, index.unionByName(index.select(F.lit("x").alias("chunk_id"), "text").limit(1))) == {"index_known"}
    assert failed(chunks.unionAll(chunks.limit(1))) == {"unique_id"}
    assert failed(chunks, d=docs.withColumn("parsed_path", F.lit("q"))) >= {"document_found"}
    assert "version_equal" in failed(chunks, d=docs.withColumn("text", F.concat("text", F.lit("z"))))


def test_routes_of_files(spark):
    files = spark.createDataFrame([("a", bytearray(b"x"), "html"), ("b", bytearray(b"y"), "txt"), ("c", bytearray(b"z"), None)], "path string, content binary, kind string")
    same = lambda f: f.select("path", F.col("content").cast("string").alias("text"))
    assert rows(readers.routed(files, {"one": (("html",), same), "two": (("html", "txt"), same)}), "path", "route", "text") == [("a", "one", "x"), ("b", "two", "y"), ("c", None, None)]


def test_postings_are_counted_inside_their_row(spark):
    docs = spark.createDataFrame([(1, "b a b, B"), (2, ""), (3, None), (4, "a")], "id int, text string")
    found = S.postings(docs, "id", "text")
    assert sorted(map(tuple, found.collect())) == [(1, "a", 1, 4), (1, "b", 3, 4), (4, "a", 1, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("block", [1, 40, 1 << 20])
def test_posting_lists_are_postings_of_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK_WORDS", block)
    texts = ["b a b, B", "", None, "a", "Été ete Đ 中文 x1", "a " * 50, "İ K ǅ ß"] + [f"a b{i % 7} c{i}" for i in range(60)]
    docs = spark.createDataFrame([(f"d{i:02}", t) for i, t in enumerate(texts)], "id string, text string").coalesce(1)
    found = S.posting_lists(docs, "id", "text")
    flat = found.where(F.col("first") == F.col("doc_ids")[0]).select("term", F.explode(F.arrays_zip("doc_ids", "tfs", "dls")).alias("p")).select("p.doc_ids", "term", "p.tfs", "p.dls")
    assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, S.postings(docs, "id", "text").collect()))
    # A frequent term was a row for each document.
    assert found.where("term = 'a'").count() == 1 or block < 1 << 20
    assert S.posting_lists(docs.limit(0), "id", "text").collect() == []


def test_steps_are_taken_apart(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_WORDS", 40)
    docs = spark.createDataFrame([(i * i + (1 << 40) * (i % 2), f"a b{i % 7} b{i % 7} c{i}") for i in range(60)] + [(5, None)], "id long, text string").coalesce(1)
    got = S.unlisted(S.posting_lists(docs, "id", "text", steps=True))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, S.postings(docs, "id", "text").collect()))
    assert S.unlisted(S.posting_lists(docs.limit(0), "id", "text", steps=True)).collect() == []
