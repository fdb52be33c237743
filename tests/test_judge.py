"""The judge: schema, repair, failed calls, equal tasks, null tasks."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from evidra.operators import judge as J

SCHEMA = {"type": "object", "properties": {"score": {"type": "integer", "minimum": 0, "maximum": 3}, "tags": {"type": "array", "items": {"type": "string"}}, "note": {"type": "string"}}, "optional": ["note"]}


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ({"score": 1, "tags": []}, None),
        ({"score": 1, "tags": ["a"], "note": "x"}, None),
        ({"score": True, "tags": []}, "answer.score isn't of type integer"),
        ({"score": 4, "tags": []}, "answer.score is out of range"),
        ({"score": 1, "tags": ["a", 2]}, "answer.tags[1] isn't of type string"),
        ({"score": 1}, "answer has other keys"),
        ({"score": 1, "tags": [], "more": 0}, "answer has other keys"),
        ([], "answer isn't of type object"),
    ],
)
def test_fault(value, want):
    assert J.fault(value, SCHEMA) == want


def _judge(tasks):
    if any("raises" in t for t in tasks) and not any("refused" in t for t in tasks):
        raise RuntimeError("down")
    again = "refused"

    def one(t):
        if "never" in t:
            return "no json"
        if "second" in t and again not in t:
            return json.dumps({"score": 9, "tags": []})
        return json.dumps({"score": len(t) % 4, "tags": []})

    return [one(t) for t in tasks]


def test_judged(spark):
    rows = [(1, "good"), (2, "second time"), (3, "never"), (4, None), (5, "good"), (6, ""), (7, "raises once")]
    items = spark.createDataFrame(rows, "id int, task string").repartition(3)
    got = {r.id: r for r in J.judged(items, _judge, SCHEMA, size=1).collect()}
    assert {k: (r.verdict, r.calls, r.faults) for k, r in got.items()} == {
        1: ("accepted", 1, []),
        2: ("repaired", 2, ["answer.score is out of range"]),
        3: ("rejected", 2, ["the answer isn't JSON"] * 2),
        4: ("rejected", 0, ["no task"]),
        5: ("accepted", 1, []),
        6: ("accepted", 1, []),
        7: ("repaired", 2, ["the call failed"]),
    }
    assert got[3].answer is None and json.loads(got[1].answer)["score"] == 0 and got[1].receipt == got[5].receipt
    assert J.judged(items.where("false"), _judge, SCHEMA).count() == 0


def test_check_sees_the_task_and_short_answers_fail(spark):
    items = spark.createDataFrame([("a 2020",), ("b",)], "task string")
    check = lambda task, value: None if "2020" in task else "no year"
    got = {r.task: r.verdict for r in J.judged(items, _judge, SCHEMA, check=check).collect()}
    assert got == {"a 2020": "accepted", "b": "rejected"}
    assert {r.verdict for r in J.judged(items, lambda tasks: [], SCHEMA).collect()} == {"rejected"}


def test_equal_tasks_are_asked_once(spark, tmp_path):
    log = tmp_path / "calls"

    def judge(tasks):
        with log.open("a") as f:
            f.write("x\n" * len(tasks))
        return _judge(tasks)

    found = J.judged(spark.range(500).select((F.col("id") % 5).cast("string").alias("task"), "id"), judge, SCHEMA)
    assert found.count() == 500 == found.where("verdict = 'accepted'").count()
    assert log.read_text().count("x") == 5


def test_bad_calls(spark):
    items = spark.createDataFrame([("a", 1)], "task string, verdict int")
    with pytest.raises(ValueError):
        J.judged(items, _judge, SCHEMA)
    with pytest.raises(ValueError):
        J.judged(items.select("task"), _judge, SCHEMA, size=0)
