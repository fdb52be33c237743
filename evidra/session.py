"""Session helpers shared by all queries."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Arrow batches of at most this many bytes, so a worker's memory doesn't follow the length of texts.
BATCH_BYTES = 8 << 20
_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20
ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from the place it is installed in, and bounds Arrow batches.

    A batch size that the session's user has chosen stays.
    """
    # With a default of None, a setting that nobody has set is told as None.
    if spark.conf.get(_BATCH_KEY) in (f"{_BATCH_DEFAULT}b", str(_BATCH_DEFAULT)):
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table that is dealt out again if it comes in fewer files than there are cores.
SMALL = 256 << 20


def dealt(df: DataFrame) -> DataFrame:
    """A small table over all cores, for work that costs far more than moving its rows.

    A file of one row group is read by one task, whatever the cluster.  Tables
    over ``SMALL`` bytes, and those with a file for each core, stay as they are.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size <= SMALL and len(df.inputFiles()) < cores else df


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, for queries that read their texts."""
    return dealt(table(spark, sf_dir, "documents"))
