"""The training-data pipeline: five stages over ``documents``.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``.
All but the last return the columns of ``documents``: ``doc_id, text, lang,
source, n_chars``.  Columns that ``docs`` has beside these are dropped;
columns it lacks are null.  Null and empty texts, repeated rows and empty
tables pass every stage: each stage's operator states what it makes of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm.bpe import default_path
from evidra.llm.decontaminate import contamination
from evidra.llm.minhash import MinHashParams, near_duplicates
from evidra.llm.packing import PackParams, pack
from evidra.llm.pii import find_pii, redacted
from evidra.llm.quality import fit_quality, score_quality
from evidra.llm.scratch import stored
from evidra.session import table

COLUMNS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
QUALITY_THRESHOLD = 0.3


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*[(F.col(f"`{c}`") if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score is under the threshold.

    The classifier learns from every labelled document of ``docs``; each row
    is judged by its own text.
    """
    docs = _documents(docs)
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).where(F.col("quality_score") >= QUALITY_THRESHOLD).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest ``doc_id`` of each group of near copies: five words, similarity 0.8.

    Rows that share a ``doc_id`` stay or go together; rows without one stay.
    """
    docs = _documents(docs)
    gone = near_duplicates(docs, MinHashParams(words=5, percent=80)).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or all of a shorter one.

    Rows that share a ``doc_id`` go together; rows without one stay.
    """
    docs = _documents(docs)
    gone = contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id").where("doc_id is not null").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in texts by its kind in angle brackets and counts ``n_chars`` anew; drops nothing."""
    found = find_pii(_documents(docs))
    text = F.when(F.size("spans") > 0, redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 2048 tokens: one row for each piece, with its ids."""
    return pack(_documents(docs), PackParams(default_path(), end_id=1, capacity=2048))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("redact_pii", redact_pii),
    ("packing", packing),
]

#: Trained models and token ids aren't expressible in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
