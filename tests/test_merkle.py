"""Sealed tables: reads are proven, damage is an error for its own keys alone."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evidra.operators.merkle import Sealed, TornError, seal
from evidra.sources.folders import folder


@pytest.fixture(scope="module")
def words(spark):
    rows = [(f"w{i % 40:02d}" if i % 3 else "w07", i, i / 7 if i % 5 else None) for i in range(600)]
    return spark.createDataFrame(rows, "term string, doc long, x double").cache()


def _sealed(spark, words, leaves=7, fan=2):
    path = folder(spark, "sealed")
    return path, seal(words, path, ["term", "doc"], leaves, fan)


def test_reads_equal_a_filter(spark, words):
    path, root = _sealed(spark, words)
    table = Sealed(spark, path, root)
    for keys in (["w00"], ["w07", "w39", "none"], [], ["a", "z"]):
        got = sorted(map(tuple, table.read(keys).collect()), key=repr)
        assert got == sorted(map(tuple, words.where(F.col("term").isin(*keys) if keys else F.lit(False)).collect()), key=repr)
    assert table.read().count() == 600
    assert 0 < len(table.proven_leaves(["w00"])) < 7
    assert len(table.proven_leaves(["w07"])) >= 2  # a third of all rows is spread


def test_root_is_that_of_the_rows(spark, words):
    _, a = _sealed(spark, words.repartition(3))
    _, b = _sealed(spark, words.coalesce(1))
    assert a == b
    _, c = _sealed(spark, words.withColumn("x", F.when(F.col("doc") == 5, 0.0).otherwise(F.col("x"))))
    assert a != c


def _append(spark, folder_of_rows):
    spark.read.parquet(folder_of_rows).limit(1).write.mode("append").parquet(folder_of_rows)


def test_a_damaged_leaf_is_an_error_for_its_keys_alone(spark, words):
    path, root = _sealed(spark, words)
    table = Sealed(spark, path, root)
    bad = max(table.proven_leaves(["w39"]))
    _append(spark, f"{path}/rows/leaf={bad}")
    again = Sealed(spark, path, root)
    with pytest.raises(TornError, match=str(bad)):
        again.read(["w39"])
    with pytest.raises(TornError):
        again.read()
    assert again.read(["w00"]).count() == words.where("term = 'w00'").count()


def test_damaged_nodes_description_and_root(spark, words):
    path, root = _sealed(spark, words)
    with pytest.raises(TornError):
        Sealed(spark, path, "0" * 64).read(["w00"])
    for level in (0, 1):
        own, sealed = _sealed(spark, words)
        forged = Sealed(spark, own, sealed).level(level).withColumn("hi", F.when(F.col("node") == 0, "w00").otherwise(F.col("hi")))
        forged = spark.createDataFrame(forged.collect(), forged.schema)
        forged.write.mode("overwrite").parquet(f"{own}/tree/{level}")
        with pytest.raises(TornError, match=f"level {level + 1}"):
            Sealed(spark, own, sealed).read(["w02"])
    spark.createDataFrame([("{",)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    with pytest.raises(TornError):
        Sealed(spark, path, root)


def test_a_missing_leaf_is_an_error(spark, words):
    path, root = _sealed(spark, words)
    gone = min(Sealed(spark, path, root).proven_leaves(["w00"]))
    empty = spark.read.parquet(f"{path}/rows/leaf={gone}").limit(0)
    empty.write.mode("overwrite").parquet(f"{path}/rows/leaf={gone}")
    with pytest.raises(TornError):
        Sealed(spark, path, root).read(["w00"])


def test_empty_tables_and_null_keys(spark, words):
    path = folder(spark, "sealed")
    root = seal(words.where("false"), path, ["term"], 3)
    assert Sealed(spark, path, root).read(["w00"]).count() == 0 == Sealed(spark, path, root).read().count()
    path = folder(spark, "sealed")
    root = seal(spark.createDataFrame([(None, 1), ("a", 2)], "term string, doc long"), path, ["term"], 2)
    assert Sealed(spark, path, root).read().count() == 2
    assert [r.doc for r in Sealed(spark, path, root).read(["a"]).collect()] == [2]
    with pytest.raises(ValueError):
        seal(words.withColumn("leaf", F.lit(1)), folder(spark, "sealed"), ["term"])


def test_passes_hold_the_same_rows(spark, tmp_path):
    df = spark.range(500).select(F.when(F.col("id") % 50 > 0, F.concat(F.lit("k"), (F.col("id") % 90).cast("string"))).alias("k"), "id")
    for passes, name in ((1, "one"), (3, "three"), (600, "many")):
        path = f"file://{tmp_path}/{name}"
        table = Sealed(spark, path, seal(df, path, ["k", "id"], leaves=8, fan=2, passes=passes))
        assert sorted(map(tuple, table.read().collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
        assert sorted(r.id for r in table.read(["k7", "k88", "no"]).collect()) == [i for i in range(500) if i % 90 in (7, 88) and i % 50]
    for name in ("empty", "nulls"):
        path = f"file://{tmp_path}/{name}"
        own = df.where("k is null") if name == "nulls" else df.limit(0)
        assert Sealed(spark, path, seal(own, path, ["k", "id"], leaves=4, passes=3)).read().count() == own.count()
