"""Streaming forms of the review fold and the embedding cache.

The batch operators define the semantics; these run them continuously.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evidra.operators import embedding as E
from evidra.operators.review import step


def review_stream(events: DataFrame) -> DataFrame:
    """L1, L2, L5 over a stream of ``(doc_id, seq, revision, action, actor, note)``: each event's outcome.

    State is one status and revision a document.  Events of one micro-batch
    are taken in ``seq`` order; across batches they count in order of arrival.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, revision = state.get if state.exists else ("pending", 1)
        rows = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            seen = None if pd.isna(r.revision) else int(r.revision)
            status, revision, outcome = step(status, revision, (seen, r.action, r.actor, r.note))
            rows.append((key[0], r.seq, status, revision, outcome))
        state.update((status, revision))
        yield pd.DataFrame(rows, columns=["doc_id", "seq", "status", "revision", "outcome"])

    cols = events.select("doc_id", "seq", "revision", "action", "actor", "note")
    return cols.groupBy("doc_id").applyInPandasWithState(run, "doc_id long, seq long, status string, revision long, outcome string", "status string, revision long", "append", GroupStateTimeout.NoTimeout)


def embed_stream(chunks: DataFrame, cache_path: str, checkpoint: str, model: str, dims: int, embedder: Callable[[list[str]], np.ndarray]) -> StreamingQuery:
    """L10 over a stream of ``(chunk_id, seq, text)``: each micro-batch embeds what the cache lacks and appends it.

    A batch writes under its own number, so a repeated batch replaces itself.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        cache = spark.read.schema("cache_key string, vector array<double>, batch long").parquet(cache_path).where(F.col("batch") != number)
        planned = E.plan(batch, cache, model, dims)
        E.embed_misses(planned, embedder).write.mode("overwrite").parquet(f"{cache_path}/batch={number}")

    spark = chunks.sparkSession
    spark.createDataFrame([], "cache_key string, vector array<double>").write.mode("append").parquet(f"{cache_path}/batch=-1")
    return chunks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_activity(events: DataFrame, watermark: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Event counts and sums by window and type, with late events dropped beyond the watermark."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
