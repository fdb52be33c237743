"""Intermediate tables in the folder that all executors share.

A written table cuts lineage and survives the loss of an executor, which a
local checkpoint doesn't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidra.sources.folders import stored

__all__ = ["drop", "stored"]


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Deletes a table that :func:`stored` made, when nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
