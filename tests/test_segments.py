"""The index that takes inserts and withdrawals, against one that is built anew."""

from __future__ import annotations

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from evidra.operators.search import bm25
from evidra.operators.segments import SegmentedIndex, Version
from evidra.sources.folders import folder

DOC = "doc_id long, text string"
TERMS = ["alpha", "beta", "alpha", "gone"]


def text(r):
    return " ".join(r.choice(["alpha", "beta", "Béta", "gamma", "delta", "x"]) for _ in range(r.randint(0, 15)))


def scores(df):
    return {r.doc_id: round(r.score, 9) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in rows], DOC).repartition(3)


@pytest.mark.parametrize("fan", [2, 3])
def test_equal_to_a_rebuild(spark, fan):
    r, now = random.Random(fan), {}
    index = SegmentedIndex(spark, folder(spark, "segments"), fan=fan)
    for step in range(5):
        inserts = {r.randrange(150): None if r.random() < 0.05 else text(r) for _ in range(60 if step != 2 else 0)}
        gone = [r.randrange(150) for _ in range(20 * step)]
        v = index.apply(frame(spark, inserts.items()), spark.createDataFrame([(i,) for i in gone], "doc_id long"))
        now = {i: t for i, t in now.items() if i not in gone} | inserts
        assert v.number == index.version().number and (v.rows, v.words) == (len(now), sum(len((t or "").split()) for t in now.values()))
        if step % 2:
            v = index.compact()
        assert sorted(x.doc_id for x in index.live().collect()) == sorted(now)
        assert scores(index.scores(TERMS)) == scores(bm25(frame(spark, now.items()), "doc_id", "text", TERMS))
    assert any(n.startswith("segment-") and int(n[8:]) > 2 for n, _ in index.version().segments)


def test_compaction_leaves_few_segments_and_no_bitmaps(spark):
    index = SegmentedIndex(spark, folder(spark, "segments"), fan=2)
    for k in range(4):
        index.apply(frame(spark, [(i, "alpha beta") for i in range(10 * k, 10 * k + 10)]), spark.createDataFrame([(10 * k - 1,)], "doc_id long"))
        index.compact()
    v = index.version()
    assert len(v.segments) <= 3 and v.rows == 37
    alone = index.compact() if len(v.segments) > 1 else v
    assert sorted(x.doc_id for x in index.live(alone).collect()) == [i for i in range(40) if i not in (9, 19, 29)]


def test_merging_everything_drops_dead_rows(spark):
    index = SegmentedIndex(spark, folder(spark, "segments"), fan=2)
    index.apply(frame(spark, [(i, "alpha") for i in range(8)]))
    index.apply(frame(spark, [(i, "beta") for i in range(4, 12)]), spark.createDataFrame([(0,), (1,)], "doc_id long"))
    v = index.compact()
    assert len(v.segments) == 1 and v.deletes == () and v.segments[0][1] == v.rows == 10
    assert index._read([v.segments[0][0]], "postings", "term string, born int, ord long, doc_id {id}, tf long, dl int").count() == 10
    assert scores(index.scores(["beta"])).keys() == set(range(4, 12))


def test_a_reader_keeps_its_version(spark):
    index = SegmentedIndex(spark, folder(spark, "segments"), fan=2)
    old = index.apply(frame(spark, [(1, "alpha"), (2, "alpha beta")]))
    want = scores(index.scores(TERMS, old))
    index.apply(frame(spark, [(3, "alpha")]), spark.createDataFrame([(1,)], "doc_id long"))
    index.compact()
    assert scores(index.scores(TERMS, old)) == want and scores(index.scores(TERMS)).keys() == {2, 3}


def test_awkward_rows(spark):
    index = SegmentedIndex(spark, folder(spark, "segments"))
    assert index.version() == Version() and index.scores(TERMS).collect() == [] and index.live().collect() == []
    none = spark.createDataFrame([], DOC)
    assert index.apply(none).rows == 0
    extra = spark.createDataFrame([(1, "alpha", "t", 9), (1, "beta", "t", 9), (None, "alpha", "t", 9), (2, None, "t", 9), (3, "", "t", 9), (4, "alpha " * 20_000, "t", 9)], f"{DOC}, term string, ord int")
    v = index.apply(extra, spark.createDataFrame([(None,), (77,)], "doc_id long"))
    assert (v.rows, v.words) == (4, 20_001)
    assert scores(index.scores(["alpha"])).keys() == {4} and scores(index.scores(["beta"])).keys() == {1}
    assert index.search(["alpha"], 5).collect()[0].rank == 1 and index.scores([]).collect() == []


def test_two_writers_of_one_version(spark):
    index = SegmentedIndex(spark, folder(spark, "segments"))
    index.apply(frame(spark, [(1, "alpha")]))
    other = SegmentedIndex(spark, index.path)
    other.version = lambda: Version()  # it hasn't seen the first one's version
    with pytest.raises(AnalysisException):
        other.apply(frame(spark, [(2, "alpha")]))
    assert scores(index.scores(["alpha"])).keys() == {1}


def test_changes_of_the_review(spark):
    index = SegmentedIndex(spark, folder(spark, "segments"))
    docs = frame(spark, [(i, f"alpha {i}") for i in range(6)])
    index.apply_changes(spark.createDataFrame([(0, "insert"), (1, "insert"), (2, "none")], "doc_id long, change string"), docs)
    index.apply_changes(spark.createDataFrame([(0, "delete"), (3, "insert")], "doc_id long, change string"), docs)
    assert sorted(r.doc_id for r in index.live().select(F.col("doc_id")).collect()) == [1, 3]


def test_ids_of_another_type(spark):
    index = SegmentedIndex(spark, folder(spark, "segments"), id_type="string")
    index.apply(spark.createDataFrame([("a", "alpha"), ("b", "beta")], "doc_id string, text string"))
    index.apply(spark.createDataFrame([("a", "beta")], "doc_id string, text string"))
    assert scores(index.scores(["beta"])).keys() == {"a", "b"}


def test_a_batch_counts_words_inside_their_row(spark, tmp_path, monkeypatch):
    plans, write = [], SegmentedIndex._write
    monkeypatch.setattr(SegmentedIndex, "_write", lambda self, name, docs, posted: plans.append(posted._jdf.queryExecution().executedPlan().toString()) or write(self, name, docs, posted))
    index = SegmentedIndex(spark, f"file://{tmp_path}/i")
    v = index.apply(spark.createDataFrame([(1, "b a b"), (2, "a"), (3, None)], "doc_id long, text string"))
    assert (v.rows, v.words) == (3, 4) and sorted(map(tuple, index.postings(["a", "b"]).collect())) == [(1, "a", 1, 3), (1, "b", 2, 3), (2, "a", 1, 1)]
    assert "Exchange" not in plans[0]
