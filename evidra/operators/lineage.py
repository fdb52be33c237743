"""Provenance graph."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidra.sources.folders import stored

#: The stage at which each kind of issue is taken up again.
RESTART = {
    "AUTH_FAILED": "search",
    "COUNTRY_MISMATCH": "discovery",
    "INDICATOR_MISMATCH": "discovery",
    "MISSING_YEARS": "discovery",
    "INVALID_VALUE": "parse",
    "DUPLICATE_YEAR": "parse",
    "OUT_OF_SCOPE_YEAR": "parse",
    "CROSSCHECK_MISMATCH": "parse",
    "SOURCE_REVISION": "check",
}
MAX_ATTEMPTS = 2


def edges(nodes: DataFrame) -> DataFrame:
    """``parent, child`` of ``nodes(id, parents)``."""
    return nodes.select(F.explode("parents").alias("parent"), F.col("id").alias("child"))


def dangling(nodes: DataFrame) -> DataFrame:
    """Edges whose parent isn't a node."""
    return edges(nodes).join(nodes.select(F.col("id").alias("parent")), "parent", "left_anti")


def reach(graph: DataFrame, seeds: DataFrame, source: str, target: str, rounds: int | None = None) -> DataFrame:
    """``seed, node`` reachable from ``seeds(seed)`` along ``source`` to ``target``, seeds included.

    A frontier moves one edge a round and forgets what it has seen, so
    diamonds cost nothing extra and cycles end.  Each round is written and read again.
    Rounds go on until nothing new is found; more than ``rounds`` are an error.
    """
    graph = graph.select(F.col(source).alias("node"), F.col(target).alias("next"))
    seen = seeds.select("seed", F.col("seed").alias("node")).distinct()
    front = seen
    for done in count():
        step = front.join(graph, "node").select("seed", F.col("next").alias("node")).distinct()
        front = step.join(seen, ["seed", "node"], "left_anti")
        front = stored(front, "front")
        if front.isEmpty():
            return seen
        if rounds is not None and done >= rounds:
            raise RuntimeError(f"the closure needs more than {rounds} rounds")
        seen = stored(seen.unionByName(front), "seen")


def ancestors(nodes: DataFrame, seeds: DataFrame, rounds: int | None = None) -> DataFrame:
    """G1: ``seed, node``: each seed and everything it was made from."""
    return reach(edges(nodes), seeds, "child", "parent", rounds)


def descendants(nodes: DataFrame, seeds: DataFrame, rounds: int | None = None) -> DataFrame:
    """``seed, node``: everything made from a seed, the seed left out."""
    return reach(edges(nodes), seeds, "parent", "child", rounds).where("seed <> node")


def numbered(seeds: DataFrame) -> DataFrame:
    """``seed, number, bucket, bit``: distinct seeds, numbered without gaps inside a task, and their place in bitmaps.

    Stored, so a number stays that of its seed.  Null seeds are left out.
    """
    found = seeds.select("seed").where(F.col("seed").isNotNull()).distinct().withColumn("number", F.monotonically_increasing_id())
    return stored(found.withColumns({"bucket": F.shiftright("number", 6), "bit": F.col("number").bitwiseAND(F.lit(63)).cast("int")}), "numbers")


def reach_many(graph: DataFrame, numbers: DataFrame, source: str, target: str, rounds: int | None = None) -> DataFrame:
    """``node, bucket, bits``: which of many seeds reach a node along ``source`` to ``target``, a bitmap for each 64 of them.

    ``numbers`` is that of :func:`numbered`; a seed reaches itself.  Bitmaps
    move along edges level by level and are united at each node, so a round
    writes a row for each node whose bitmap grew, not for each pair, and an
    edge is crossed again only when more seeds have come to its start.  What
    has been written isn't written again: a node's bitmap is the union of its
    rows.  Diamonds and cycles end; edges to nulls are left out.  More than
    ``rounds`` are an error.

    A bitmap is one number, so a node that a single seed reaches costs a short
    row, and unions need neither sorts nor buffers of a bitmap's size.
    """
    graph = graph.select(F.col(source).alias("node"), F.col(target).alias("next")).where(F.col("next").isNotNull()).distinct()
    union = F.bit_or("bits").alias("bits")
    front = stored(numbers.select(F.col("seed").alias("node"), "bucket", F.expr("shiftleft(1L, bit)").alias("bits")), "front")
    written = front
    for done in count():
        came = front.join(graph, "node").select(F.col("next").alias("node"), "bucket", "bits").groupBy("node", "bucket").agg(union)
        old = written.join(came.select("node", "bucket"), ["node", "bucket"], "left_semi").groupBy("node", "bucket").agg(F.bit_or("bits").alias("old"))
        grown = came.join(old, ["node", "bucket"], "left").withColumn("bits", F.col("bits").bitwiseOR(F.coalesce("old", F.lit(0).cast("long"))))
        front = stored(grown.where(F.col("old").isNull() | (F.col("bits") != F.col("old"))).drop("old"), "front")
        if front.isEmpty():
            return written.groupBy("node", "bucket").agg(F.unhex(F.lpad(F.hex(F.bit_or("bits")), 16, "0")).alias("bits"))
        if rounds is not None and done >= rounds:
            raise RuntimeError(f"the closure needs more than {rounds} rounds")
        written = written.unionByName(front)


def pairs(reached: DataFrame, numbers: DataFrame) -> DataFrame:
    """``seed, node`` of the bitmaps of :func:`reach_many`."""
    word = F.conv(F.hex("bits"), 16, -10).cast("long")
    each = reached.select("node", "bucket", word.alias("word")).select("node", "bucket", F.explode(F.expr("filter(sequence(0, 63), k -> getbit(word, k) = 1)")).alias("bit"))
    return each.join(numbers.select("seed", "bucket", "bit"), ["bucket", "bit"]).select("seed", "node")


def affected(nodes: DataFrame, targets: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """``target, node, direction`` of many targets: what each was made from (backward) and what was made from it (forward).

    ``targets(id)``: nodes, or issues of ``issues(id, detected_at)``, that
    stand for the node where they were found; unknown ones give no row, and a
    target's own node is in neither direction.
    """
    starts = targets.select(F.col("id").alias("target")).distinct().withColumn("seed", F.col("target"))
    if issues is not None:
        found = issues.groupBy(F.col("id").alias("target")).agg(F.min("detected_at").alias("at"))
        starts = starts.join(found, "target", "left").select("target", F.coalesce("at", "seed").alias("seed"))
    starts = starts.join(nodes.select(F.col("id").alias("seed")), "seed", "left_semi")
    graph, numbers = edges(nodes), numbered(starts)
    out = None
    for direction, source, target in (("backward", "child", "parent"), ("forward", "parent", "child")):
        own = pairs(reach_many(graph, numbers, source, target), numbers).where("seed <> node").withColumn("direction", F.lit(direction))
        out = own if out is None else out.unionByName(own)
    return starts.join(out, "seed").select("target", "node", "direction")


def preorder(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """G1, C20: ``seed, node, place``: the backward trace of each start, depth first, parents in their order, each node once.

    A node's place is that of the least path of parent numbers among the paths
    over which a depth-first walk reaches it first.  Paths are kept as arrays,
    one for each node and seed, and are settled level by level: a node visited
    through a smaller path stays where it is.
    """
    step = nodes.select(F.col("id").alias("node"), F.posexplode("parents").alias("k", "next"))
    found = starts.select("seed", F.col("node"), F.array().cast("array<int>").alias("path")).distinct()
    front = found
    while True:
        more = front.join(step, "node").select("seed", F.col("next").alias("node"), F.concat("path", F.array("k")).alias("path"))
        best = found.unionByName(more).groupBy("seed", "node").agg(F.min("path").alias("path"))
        front = stored(best.join(found, ["seed", "node", "path"], "left_anti"), "front")
        if front.isEmpty():
            break
        found = stored(best, "paths")
    order = Window.partitionBy("seed").orderBy("path")
    return found.select("seed", "node", (F.row_number().over(order) - 1).alias("place"))


def explain(nodes: DataFrame, issues: DataFrame, targets: DataFrame, files: DataFrame) -> DataFrame:
    """``target, issue, node, place, intact`` of each target's backward trace.

    A target is a node, or an issue of ``issues(id, detected_at)``, whose
    trace begins where it was found; an unknown target gives no row.  ``intact``
    tells whether a node's file is the recorded one, null without a file.
    """
    known = targets.select(F.col("id").alias("target"))
    of_issue = known.join(issues.select(F.col("id").alias("target"), F.col("detected_at").alias("node")), "target")
    of_node = known.join(issues.select(F.col("id").alias("target")), "target", "left_anti").withColumn("node", F.col("target"))
    starts = of_issue.withColumn("issue", F.col("target")).unionByName(of_node.withColumn("issue", F.lit(None).cast("string")))
    starts = starts.join(nodes.select(F.col("id").alias("node")), "node", "left_semi")
    walked = preorder(nodes, starts.select(F.col("node").alias("seed"), "node").distinct())
    trace = starts.select("target", "issue", F.col("node").alias("seed")).join(walked, "seed")
    return trace.join(integrity(nodes, files).withColumnRenamed("id", "node"), "node", "left").select("target", "issue", "node", "place", "intact")


class StageLog:
    """Nodes and issues of a run, written by the driver as its stages begin and end.

    A stage is running, then success or failed.  Of an error that unwinds
    through several stages only the deepest makes an issue; codes 401 and 403
    are ``AUTH_FAILED``.
    """

    def __init__(self) -> None:
        self.nodes: list[dict] = []
        self.issues: list[dict] = []
        self.open: list[str] = []

    def node(self, stage: str, label: str, parents: list[str] | None = None, path: str | None = None, sha256: str | None = None, status: str = "success") -> dict:
        """A node under ``parents``, or under the open stage; each parent must exist."""
        own = list(dict.fromkeys(self.open[-1:] if parents is None else parents))
        if not set(own) <= {n["id"] for n in self.nodes}:
            raise ValueError("a parent isn't in the log")
        made = {"id": f"n{len(self.nodes) + 1:05d}", "stage": stage, "label": label, "parents": own, "path": path, "sha256": sha256, "status": status, "issue": None}
        self.nodes.append(made)
        return made

    @contextmanager
    def stage(self, stage: str, label: str, parents: list[str] | None = None) -> Iterator[dict]:
        made = self.node(stage, label, parents, status="running")
        self.open.append(made["id"])
        try:
            yield made
            made["status"] = "success"
        except Exception as error:
            made["status"] = "failed"
            known = next((i["id"] for i in self.issues if i["error"] is error), None)
            if known is None:
                code = getattr(error, "code", "STAGE_ERROR")
                known = f"e{len(self.issues) + 1:05d}"
                self.issues.append({"id": known, "code": "AUTH_FAILED" if code in (401, 403) else str(code), "detected_at": made["id"], "stage": stage, "message": str(error), "error": error})
            made["issue"] = known
            raise
        finally:
            self.open.pop()

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """Nodes and issues as tables."""
        names = ["id", "stage", "label", "parents", "path", "sha256", "status", "issue"]
        nodes = spark.createDataFrame([tuple(n[c] for c in names) for n in self.nodes], "id string, stage string, label string, parents array<string>, path string, sha256 string, status string, issue string")
        kept = ["id", "code", "detected_at", "stage", "message"]
        return nodes, spark.createDataFrame([tuple(i[c] for c in kept) for i in self.issues], ", ".join(f"{c} string" for c in kept))


def remediation(issues: DataFrame) -> DataFrame:
    """Issues with ``restart_from``, ``max_attempts`` and ``auto_modify_facts``; unknown codes restart where they were found."""
    table = F.create_map(*[F.lit(x) for kv in RESTART.items() for x in kv])
    return issues.withColumns({"restart_from": F.coalesce(F.try_element_at(table, "code"), "stage"), "max_attempts": F.lit(MAX_ATTEMPTS), "auto_modify_facts": F.lit(False)})


def integrity(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """``id, intact``: whether the file's digest is the recorded one; null for nodes without a file."""
    digests = files.select("path", F.sha2("content", 256).alias("found"))
    joined = nodes.join(digests, "path", "left")
    return joined.select("id", F.when(F.col("path").isNotNull(), F.coalesce(F.col("found") == F.col("sha256"), F.lit(False))).alias("intact"))


def latest_artifact(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """``documents(path, sha256)`` with ``provenance``: intact, changed, or missing, against the last node of the path."""
    last = nodes.where(F.col("sha256").isNotNull()).groupBy("path").agg(F.max_by("sha256", "seq").alias("recorded"))
    state = F.when(F.col("recorded").isNull(), "missing").when(F.col("recorded") == F.col("sha256"), "intact").otherwise("changed")
    return documents.join(last, "path", "left").withColumn("provenance", state).drop("recorded")


def recursive_ancestors(spark: SparkSession, view: str, seed: str, depth: int = 20) -> DataFrame:
    """G1 in SQL over a view ``(parent, child)``, for small graphs of bounded depth."""
    return spark.sql(
        f"WITH RECURSIVE up(node, depth) AS (SELECT :seed, 0 UNION ALL SELECT e.parent, u.depth + 1 FROM up u JOIN {view} e ON e.child = u.node WHERE u.depth < {depth}) SELECT DISTINCT node FROM up",
        args={"seed": seed},
    )
