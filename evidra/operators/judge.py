"""Asking a judge in batches, with one repair.

The judge is a callable from a list of texts to as many answers; what stands
behind it is the caller's affair.  Equal tasks are asked once.  Answers are
JSON that must fit a schema and pass a check; those that don't are asked for
once more, with the fault named, and are rejected if they fail again.

Answers are written to the shared folder before anything is joined to them, so
a later stage doesn't ask again; a task that is retried after its executor was
lost asks for its own rows again, and for no others.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.sources.folders import stored

Judge = Callable[[list[str]], list[str]]
Check = Callable[[str, dict], str | None]
ACCEPTED, REPAIRED, REJECTED = "accepted", "repaired", "rejected"
_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "integer": int, "number": (int, float), "null": type(None)}


def fault(value: object, schema: dict, at: str = "answer") -> str | None:
    """The first place where a value doesn't fit; null if it fits.

    ``schema`` has ``type`` (a name), ``enum``, ``minimum``, ``maximum``,
    ``items`` and ``properties``; an object has exactly the properties named,
    those in ``optional`` may be missing.
    """
    kind = schema.get("type")
    if kind and (not isinstance(value, _KINDS[kind]) or (isinstance(value, bool) and kind in ("integer", "number"))):
        return f"{at} isn't of type {kind}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at} isn't one of the values"
    if "minimum" in schema and value < schema["minimum"] or "maximum" in schema and value > schema["maximum"]:
        return f"{at} is out of range"
    if isinstance(value, list) and "items" in schema:
        return next((f for i, x in enumerate(value) if (f := fault(x, schema["items"], f"{at}[{i}]"))), None)
    if isinstance(value, dict) and "properties" in schema:
        wanted = schema["properties"]
        if set(value) - set(wanted) or set(wanted) - set(value) - set(schema.get("optional", ())):
            return f"{at} has other keys"
        return next((f for k, x in value.items() if (f := fault(x, wanted[k], f"{at}.{k}"))), None)
    return None


def _asked(judge: Judge, tasks: list[str], size: int) -> list[str | None]:
    """Answers in order; null where a call failed or gave another number of answers."""
    out: list[str | None] = []
    for i in range(0, len(tasks), size):
        part = tasks[i : i + size]
        try:
            got = list(judge(part))
        except Exception:  # noqa: BLE001 - whatever a judge raises is a failed call, which is recorded
            got = []
        out += got if len(got) == len(part) else [None] * len(part)
    return out


def _fault_of(task: str, answer: str | None, schema: dict, check: Check | None) -> str | None:
    if answer is None:
        return "the call failed"
    try:
        value = json.loads(answer)
    except (TypeError, ValueError):
        return "the answer isn't JSON"
    return fault(value, schema) or (check(task, value) if check else None)


def repair_task(task: str, fault: str) -> str:
    """What is asked the second time."""
    return f"{task}\n\nThe last answer was refused: {fault}. Answer again."


def judged(items: DataFrame, judge: Judge, schema: dict, task: str = "task", check: Check | None = None, size: int = 32) -> DataFrame:
    """Rows of ``items`` with ``answer, verdict, calls, faults, receipt``.

    ``verdict`` is accepted, repaired (at the second time) or rejected, and
    ``answer`` null unless it was taken.  ``calls`` counts how often the task
    was asked, 0 for a null task, which is rejected; ``faults`` lists why
    answers were refused; ``receipt`` is the digest of task and answer.
    ``judge`` gets ``size`` tasks at most.
    """
    clash = {"answer", "verdict", "calls", "faults", "receipt", "judged_key"} & set(items.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are the result's own")
    if size < 1:
        raise ValueError("a batch has one task at least")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tasks = pdf["task"].tolist()
            answers = _asked(judge, tasks, size)
            faults = [[f] if (f := _fault_of(t, a, schema, check)) else [] for t, a in zip(tasks, answers, strict=True)]
            again = [i for i, f in enumerate(faults) if f]
            for i, a in zip(again, _asked(judge, [repair_task(tasks[i], faults[i][0]) for i in again], size), strict=True):
                answers[i] = a
                if f := _fault_of(tasks[i], a, schema, check):
                    faults[i].append(f)
            verdicts = [ACCEPTED if not f else REPAIRED if len(f) == 1 else REJECTED for f in faults]
            kept = [None if v == REJECTED else a for v, a in zip(verdicts, answers, strict=True)]
            receipts = [hashlib.sha256(f"{t}\x1f{a or ''}".encode()).hexdigest() for t, a in zip(tasks, kept, strict=True)]
            yield pd.DataFrame({"judged_key": pdf["judged_key"], "answer": kept, "verdict": verdicts, "calls": [1 + bool(f) for f in faults], "faults": faults, "receipt": receipts})

    keyed = items.withColumn("judged_key", F.sha2(F.col(task), 256))
    once = keyed.where(F.col(task).isNotNull()).groupBy("judged_key").agg(F.first(task).alias("task"))
    answers = stored(once.mapInPandas(run, "judged_key string, answer string, verdict string, calls int, faults array<string>, receipt string"), "judged")
    none = {"verdict": F.lit(REJECTED), "calls": F.lit(0), "faults": F.array(F.lit("no task"))}
    return keyed.join(answers, "judged_key", "left").withColumns({c: F.coalesce(F.col(c), d) for c, d in none.items()}).select(*items.columns, "answer", "verdict", "calls", "faults", "receipt")
