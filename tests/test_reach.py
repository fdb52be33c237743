"""Reachability of many seeds by bitmaps, against a plain walk."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from evidra.operators import lineage as L


def _walk(edges, seed):
    seen, todo = {seed}, [seed]
    while todo:
        at = todo.pop()
        for a, b in edges:
            if a == at and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


@pytest.mark.parametrize("cyclic", [False, True])
def test_many_seeds_equal_a_walk(spark, cyclic):
    rng = random.Random(3)
    edges = [tuple(sorted((rng.randrange(30), rng.randrange(30)), reverse=cyclic and rng.random() < 0.3)) for _ in range(45)]
    graph = spark.createDataFrame([(str(a), str(b)) for a, b in edges], "parent string, child string")
    numbers = L.numbered(spark.createDataFrame([(str(i),) for i in range(0, 30, 2)] + [("2",), (None,)], "seed string"))
    got = {(r.seed, r.node) for r in L.pairs(L.reach_many(graph, numbers, "parent", "child"), numbers).collect()}
    assert got == {(str(i), str(n)) for i in range(0, 30, 2) for n in _walk(edges, i)}


def test_rows_grow_with_edges_and_buckets_are_kept_apart(spark):
    n = 40_000  # more than one bucket of seeds
    graph = spark.range(n).select(F.concat(F.lit("s"), "id").alias("parent"), F.lit("hub").alias("child")).unionByName(spark.createDataFrame([("hub", "end"), ("end", "hub")], "parent string, child string"))
    numbers = L.numbered(spark.range(n).coalesce(1).select(F.concat(F.lit("s"), "id").alias("seed")))
    reached = L.reach_many(graph, numbers, "parent", "child")
    assert reached.where("node in ('hub', 'end')").count() == 2 * numbers.select("bucket").distinct().count()
    assert reached.where("node = 'end'").agg(F.sum(F.bitmap_count("bits"))).first()[0] == n
    assert L.pairs(reached.where("node = 'end'"), numbers).distinct().count() == n


def test_affected_has_both_directions(spark):
    nodes = spark.createDataFrame([("a", []), ("b", ["a"]), ("c", ["a", "b"]), ("d", ["c", None]), ("x", [])], "id string, parents array<string>")
    issues = spark.createDataFrame([("e1", "c")], "id string, detected_at string")
    got = sorted(map(tuple, L.affected(nodes, spark.createDataFrame([("e1",), ("a",), ("x",), ("no",)], "id string"), issues).collect()))
    assert got == [("a", "b", "forward"), ("a", "c", "forward"), ("a", "d", "forward"), ("e1", "a", "backward"), ("e1", "b", "backward"), ("e1", "d", "forward")]
    assert L.affected(nodes, spark.createDataFrame([], "id string")).count() == 0


def test_a_node_of_one_seed_costs_a_short_row(spark):
    numbers = L.numbered(spark.range(200).coalesce(1).select(F.concat(F.lit("s"), "id").alias("seed")))
    graph = spark.createDataFrame([("s63", "a"), ("s64", "a"), ("s7", "b")], "parent string, child string")
    reached = L.reach_many(graph, numbers, "parent", "child")
    assert reached.agg(F.max(F.octet_length("bits"))).first()[0] <= 64
    got = {(r.seed, r.node) for r in L.pairs(reached, numbers).where("seed <> node").collect()}
    assert got == {("s63", "a"), ("s64", "a"), ("s7", "b")}


def test_too_many_rounds(spark):
    graph = spark.createDataFrame([(str(i), str(i + 1)) for i in range(9)], "parent string, child string")
    with pytest.raises(RuntimeError):
        L.reach_many(graph, L.numbered(spark.createDataFrame([("0",)], "seed string")), "parent", "child", rounds=3)
