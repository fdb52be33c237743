"""Sinks: staged publishing, upserts, frozen artifacts, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class AuditError(RuntimeError):
    """A staged table fails its checks and isn't published."""


def _fs(df: DataFrame, path: str):  # noqa: ANN202
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def publish(df: DataFrame, path: str, checks: dict[str, Column] | None = None, fmt: str = "parquet", **options: str) -> dict[str, int]:
    """K1, K3, K8: writes to a staging folder, audits what was written, and renames it into place.

    ``checks`` are conditions that every written row must meet.  On a failure
    nothing is published and the staging folder is removed; readers see the
    old folder or the new one.  Returns the row count and failed rows a check.
    """
    fs, target = _fs(df, path)
    staged = f"{path}.staging-{uuid.uuid4().hex}"
    try:
        df.write.format(fmt).options(**options).save(staged)
        written = df.sparkSession.read.format(fmt).schema(df.schema).load(staged)
        counts = [F.count("*").alias("rows"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in (checks or {}).items()]]
        found = written.agg(*counts).first().asDict()
        failed = {n: v for n, v in found.items() if n != "rows" and v}
        if failed:
            raise AuditError(f"rows fail: {failed}")
        fs, source = _fs(df, staged)
        old = None
        if fs.exists(target):
            _, old = _fs(df, f"{path}.old-{uuid.uuid4().hex}")
            fs.rename(target, old)
        if not fs.rename(source, target):
            if old is not None:
                fs.rename(old, target)
            raise AuditError("the staged folder can't be renamed")
        if old is not None:
            fs.delete(old, True)
        return found
    finally:
        fs, source = _fs(df, staged)
        fs.delete(source, True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """K4: the next snapshot: old rows without a new one, and all new rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """K5: the row with the greatest ``order`` of each key, nulls below all; combined before the shuffle, so a hot key is no burden.

    Of rows that tie, any one.
    """
    place = F.struct(F.col(order).isNotNull(), F.col(order))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), place).alias("_row")).select("_row.*")


def freeze(df: DataFrame, store: str, content: str) -> DataFrame:
    """K2, K9: writes the contents whose digest the store lacks, once each; returns the digests written."""
    keyed = df.withColumn("sha256", F.sha2(content, 256)).dropDuplicates(["sha256"])
    fs, path = _fs(df, store)
    if fs.exists(path):
        keyed = keyed.join(df.sparkSession.read.parquet(store).select("sha256").distinct(), "sha256", "left_anti")
    batch = uuid.uuid4().hex
    keyed.withColumn("prefix", F.substring("sha256", 1, 2)).withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("prefix").parquet(store)
    return df.sparkSession.read.parquet(store).where(F.col("batch") == batch).select("sha256")


def observations_csv(df: DataFrame, path: str) -> bool:
    """K6: a CSV with a header, only if there are rows."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").option("header", True).csv(path)
    return True


def export(docs: DataFrame, as_of: str, path: str) -> None:
    """Approved documents in effect, tagged with the export's schema."""
    from evidra.operators.review import eligible

    eligible(docs, F.lit(as_of).cast("date")).withColumn("schema", F.lit("review-export-v1")).write.mode("overwrite").json(path)


def manifest(df: DataFrame, keys: list[str]) -> DataFrame:
    """K7: one row: count and digest of the rows, whatever their order."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys]), 256)
    parts = df.select(row.alias("h"))
    # The sum of the digests' parts doesn't depend on the order of rows and needs no gathering.
    sums = [F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(8)]
    return parts.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws("|", *sums), 256).alias("digest"))
