"""Runs: trace view, context, saved evidence, folders, counts, model routes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions.text import redact_secrets
from evidra.functions.urls import safe_url
from evidra.operators.review import currency
from evidra.sources import sinks

#: How many nodes and issues a trace view shows, and the names of stages in it.
NODES_SHOWN, ISSUES_SHOWN = 500, 100
STAGES = {"scope": "Scope", "search": "Search", "discovery": "Discovery", "crawl": "Crawl", "parse": "Parse", "save": "Save", "check": "Check", "chunk": "Chunk", "embedding": "Embedding", "index": "Index", "retrieval": "Retrieval", "context": "Context"}
#: The files and folders of a run.
LAYOUT = {
    "scope": "scope.json", "report": "report.json", "raw": "raw", "parsed": "parsed", "lineage": "lineage", "feedback": "feedback", "chunks": "data/chunks", "index": "data/index",
    "receipts": "data/embedding-receipts", "manifest": "data/manifest", "llm_input": "data/llm-input", "artifacts": "data/artifacts",
}


def layout(run: str) -> dict[str, str]:
    """Where each output of a run lies."""
    return {name: f"{run}/{path}" for name, path in LAYOUT.items()}


def missing_outputs(spark: SparkSession, run: str) -> list[str]:
    """Outputs of the layout that the run's folder lacks."""
    fs, _ = sinks._fs(spark.range(0), run)
    path = spark._jvm.org.apache.hadoop.fs.Path
    return [name for name, where in layout(run).items() if not fs.exists(path(where))]


def _label(stage: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv]), stage), stage)


def trace_view(nodes: DataFrame, issues: DataFrame, documents: DataFrame, secrets: tuple[str, ...] = ()) -> DataFrame:
    """``kind, seq, id, stage, stage_label, label, status, url, issue``: what a reader of a run is shown.

    The last 500 of ``nodes(seq, id, stage, label, status, url, issue)`` and
    the last 100 of ``issues(seq, id, code, detected_at, stage, message)``,
    then the imported ``documents(seq, doc_id, title, status, source_url)``.
    Texts are cleaned of secrets and URLs of credentials.
    """
    none = F.lit(None).cast("string")
    clean = lambda c: redact_secrets(F.col(c), secrets)
    shown = nodes.orderBy(F.desc("seq")).limit(NODES_SHOWN)
    found = issues.orderBy(F.desc("seq")).limit(ISSUES_SHOWN)
    one = shown.select(F.lit("node").alias("kind"), "seq", clean("id").alias("id"), "stage", _label(F.col("stage")).alias("stage_label"), clean("label").alias("label"), "status", safe_url("url", secrets).alias("url"), "issue")
    two = found.select(F.lit("issue").alias("kind"), "seq", clean("id").alias("id"), "stage", _label(F.col("stage")).alias("stage_label"), clean("message").alias("label"), clean("code").alias("status"), none.alias("url"), F.col("detected_at").alias("issue"))
    three = documents.select(F.lit("import").alias("kind"), "seq", F.concat(F.lit("import-"), F.col("seq").cast("string")).alias("id"), F.lit("human-review").alias("stage"), F.lit("Queued for review").alias("stage_label"), clean("title").alias("label"), "status", safe_url("source_url", secrets).alias("url"), none.alias("issue"))
    return one.unionByName(two).unionByName(three)


def current_node(nodes: DataFrame) -> DataFrame:
    """The last running node, none for a run that has ended."""
    return nodes.where("status = 'running'").orderBy(F.desc("seq")).limit(1)


def persist_context(bundle: DataFrame, folder: str, selected: list[str], traces: list[str], manifest_node: str, log, budget: int = 6000, cost: Column | None = None) -> str:  # noqa: ANN001
    """Writes a bundle of evidence once its final cost fits, and logs how it was made; returns the context's node.

    ``log`` is a :class:`~evidra.operators.lineage.StageLog` that holds
    ``manifest_node`` and ``traces``, the nodes of the chosen chunks.
    """
    text = F.to_json(F.struct(*bundle.columns))
    spent = bundle.select((cost if cost is not None else F.size(F.regexp_extract_all(text, F.lit(r"(?U)(\w+|[^\w\s])"), 1))).alias("c")).agg(F.sum("c").alias("c")).first().c
    if (spent or 0) > budget:
        raise ValueError("the final context exceeds its budget")
    chosen = log.node("retrieval", "context of " + ",".join(selected), parents=[manifest_node])
    context = log.node("context", "evidence within its budget", parents=[chosen["id"], *traces])
    path = f"{folder}/context-{context['id']}"
    bundle.write.mode("errorifexists").json(path)
    written = bundle.sparkSession.read.schema(bundle.schema).json(path)
    digest = sinks.manifest(written.select(F.to_json(F.struct(*bundle.columns)).alias("row")), ["row"]).first().digest
    log.node("context", path, parents=[context["id"]], path=path, sha256=digest)
    return context["id"]


def save_evidence(bundle: DataFrame, path: str, question: str) -> None:
    """The last answer's evidence, published in place of the one before."""
    sinks.publish(bundle.withColumn("question", F.lit(question)), path)


def last_evidence(spark: SparkSession, path: str, snapshot: DataFrame, now: DataFrame) -> DataFrame:
    """Saved evidence, served only while the documents that the index was built from are unchanged."""
    if not currency(snapshot, now).isEmpty():
        raise RuntimeError("documents have changed since the index was built")
    return spark.read.parquet(path)


def review_counts(docs: DataFrame) -> DataFrame:
    """One row: documents approved automatically, approved by people, and left to people, of ``docs(status, approval_mode)``."""
    approved = F.col("status") == "approved"
    auto = F.coalesce(F.col("approval_mode") == "automatic", F.lit(False))
    return docs.agg(F.count_if(approved & auto).alias("automatic"), F.count_if(approved & ~auto).alias("human"), F.count_if(F.col("status") == "pending").alias("left"))


def index_input(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Approved documents whose stored bytes are those that were reviewed; changed ones are an error, not left out."""
    from evidra.operators.documents import original_intact, snapshot

    state = docs.join(original_intact(docs, files), "doc_id")
    checked = F.when(F.col("intact"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("changed original of "), F.col("doc_id").cast("string"))).cast("boolean"))
    return snapshot(state).where(checked).drop("intact")


def not_reviewed(docs: DataFrame, done: DataFrame) -> DataFrame:
    """Documents that no automatic review has looked at, so that it can be run again: ``done(doc_id, revision)``."""
    return docs.join(done.select("doc_id", "revision"), ["doc_id", "revision"], "left_anti")


@dataclass(frozen=True)
class Model:
    id: str
    provider: str
    stages: tuple[str, ...]
    groups: tuple[str, ...]
    dimensions: int | None = None


def routes(models: list[Model], defaults: dict[str, str], group: str, chosen: dict[str, str] | None = None) -> dict[str, Model]:
    """The model of each stage: the chosen or the default one, which must offer the stage in the group.

    A choice for a stage that doesn't exist, and a model that doesn't offer
    its stage, are errors.
    """
    chosen = chosen or {}
    unknown = sorted(chosen.keys() - defaults.keys())
    if unknown:
        raise ValueError(f"no such stages: {unknown}")
    out = {}
    for stage, name in (defaults | chosen).items():
        fits = [m for m in models if m.id == name and stage in m.stages and group in m.groups]
        if not fits:
            raise ValueError(f"{name} doesn't offer {stage} to {group}")
        out[stage] = fits[0]
    return out


def unsupported(asked: Column, offered: Column) -> Column:
    """Stages asked for that aren't offered."""
    return F.array_sort(F.array_except(asked, offered))
