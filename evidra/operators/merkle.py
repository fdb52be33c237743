"""Tables of which a reader proves just the part that it reads.

A sealed table is dealt out by ranges of a key into leaves, each a folder of
its own.  A leaf's digest is that of its rows, whatever their order; a node's
digest covers its ``fan`` children with their digests, ranges and row counts.
The root digest covers all and is kept elsewhere, in a manifest.

A reader of some keys goes down from the root: the children of a node are
proven against the digest their parent was proven with before their ranges are
believed, then those whose range holds a key are followed.  The rows of the
leaves it arrives at are digested anew.  So a damaged leaf is an error for the
keys in its range alone, and a damaged or forged node for those below it.

The number of leaves is the number of folders; the driver sees only nodes on
the way to what is read.  A key that holds many rows is spread over several
leaves by the further columns of ``by``.  Sums of digests find damage, torn
and stale files; they aren't meant against somebody who can search for
collisions of sums.  Rows whose key is null are covered and never found by a key.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class TornError(RuntimeError):
    """A part of a sealed table isn't what was sealed."""


def _row_digest(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"}), 256)


def _leaves(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    """``node, digest, lo, hi, rows`` of each leaf; sums of digest parts are combined before the shuffle.

    A row's digest goes into four 64-bit hashes, whose halves are summed: 32
    bits each, so the sums of two thousand million rows fit.
    """
    digest = rows.select("leaf", F.col(key).alias("k"), _row_digest(columns).alias("h"))
    hashed = digest.select("leaf", "k", *[F.xxhash64(F.lit(i), "h").alias(f"h{i}") for i in range(4)])
    halves = [half for i in range(4) for half in (F.shiftrightunsigned(f"h{i}", 32), F.col(f"h{i}").bitwiseAND(F.lit(0xFFFFFFFF)))]
    found = hashed.groupBy("leaf").agg(F.count("*").alias("rows"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.concat_ws("|", *[F.sum(h).cast("string") for h in halves]).alias("sums"))
    return found.select(F.col("leaf").alias("node"), F.sha2(F.concat_ws(":", "leaf", "rows", "sums"), 256).alias("digest"), "lo", "hi", "rows")


def _parents(level: DataFrame, fan: int) -> DataFrame:
    """The level above, with the ``children`` of each node, ``fan`` of them at most."""
    child = F.struct("node", "digest", "lo", "hi", "rows")
    up = level.groupBy(F.floor(F.col("node") / fan).cast("int").alias("parent")).agg(F.sort_array(F.collect_list(child)).alias("children"))
    return up.select(F.col("parent").alias("node"), F.sha2(F.to_json("children", {"ignoreNullFields": "false"}), 256).alias("digest"), F.array_min("children.lo").alias("lo"), F.array_max("children.hi").alias("hi"), F.aggregate("children", F.lit(0).cast("long"), lambda s, c: s + c["rows"]).alias("rows"), "children")


#: Rows of whose keys the limits of passes are taken.
_LOOKED_AT = 4096


def _ranges(df: DataFrame, by: list[str], passes: int) -> list[DataFrame]:
    """All of ``df`` in at most ``passes`` ranges of its key with about as many rows each; the first has the nulls."""
    key = F.col(by[0])
    looked = sorted(r[0] for r in df.where(key.isNotNull()).orderBy(F.xxhash64(*by)).select(by[0]).limit(_LOOKED_AT).collect())
    limits = sorted({looked[len(looked) * i // passes] for i in range(1, passes)} - set(looked[:1])) if looked else []
    if not limits:
        return [df]
    inner = [df.where((key >= F.lit(a)) & (key < F.lit(b))) for a, b in zip(limits, limits[1:], strict=False)]
    return [df.where(key.isNull() | (key < F.lit(limits[0]))), *inner, df.where(key >= F.lit(limits[-1]))]


def seal(df: DataFrame, path: str, by: list[str], leaves: int | None = None, fan: int = 16, passes: int = 1, **options: str) -> str:
    """Writes ``df`` as a sealed table in ``path``; ``by[0]`` is its key.  Returns the root digest.

    An empty table can be sealed; a folder that exists is an error.  With
    several ``passes`` a range of keys is dealt out after the other, each over
    its part of the leaves, so a shuffle holds that part of the rows only;
    ``df`` is read for each.
    """
    if fan < 2:
        raise ValueError("fan must be 2 at least")
    if "leaf" in df.columns:
        raise ValueError("the column leaf is the table's own")
    spark, key = df.sparkSession, by[0]
    n = leaves or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = [df] if passes == 1 else _ranges(df, by, passes)
    each = -(-n // len(parts))
    n = each * len(parts)
    for i, part in enumerate(parts):
        held = part.repartitionByRange(each, *by).withColumn("leaf", F.spark_partition_id() + F.lit(i * each)).sortWithinPartitions("leaf", *by)
        held.write.mode("append" if i else "error").options(**options).partitionBy("leaf").parquet(f"{path}/rows")
    levels = 1
    while fan**levels < n:
        levels += 1
    meta = {"key": key, "fan": fan, "levels": levels, "columns": [[f.name, f.dataType.simpleString()] for f in df.schema.fields]}
    table = Sealed(spark, path, "", meta)
    _leaves(table.rows(), df.columns, key).write.parquet(f"{path}/tree/0")
    for k in range(1, levels + 1):
        _parents(table.level(k - 1), fan).drop("children").write.parquet(f"{path}/tree/{k}")
    text = json.dumps(meta, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/meta")
    top = table.level(levels).first()
    return _root(text, top.digest if top else "")


def _root(meta: str, top: str) -> str:
    return hashlib.sha256(f"{meta}\n{top}".encode()).hexdigest()


class Sealed:
    """A sealed table, read against the root digest that its manifest holds."""

    def __init__(self, spark: SparkSession, path: str, root: str, meta: dict | None = None) -> None:
        self.spark, self.path, self.root = spark, path, root
        self.meta = meta or self._opened()

    def _opened(self) -> dict:
        lines = self.spark.read.text(f"{self.path}/meta").collect()
        if len(lines) != 1:
            raise TornError("the description of the table is damaged")
        self.text = lines[0][0]
        try:
            return json.loads(self.text)
        except json.JSONDecodeError:
            raise TornError("the description of the table is damaged") from None

    def _key_type(self) -> str:
        return dict(map(tuple, self.meta["columns"]))[self.meta["key"]]

    def rows(self) -> DataFrame:
        """All rows with their leaf, unproven."""
        schema = ", ".join(f"`{c}` {t}" for c, t in self.meta["columns"]) + ", leaf int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows")

    def level(self, k: int) -> DataFrame:
        t = self._key_type()
        return self.spark.read.schema(f"node int, digest string, lo {t}, hi {t}, rows long").parquet(f"{self.path}/tree/{k}")

    def proven_leaves(self, keys: list | None = None) -> dict[int, str]:
        """Leaves whose range holds one of ``keys``, or all, with their proven digests."""
        levels, fan = self.meta["levels"], self.meta["fan"]
        top = self.level(levels).collect()
        if len(top) > 1 or _root(self.text, top[0].digest if top else "") != self.root:
            raise TornError("the root isn't the one that was sealed")
        wanted = None if keys is None else sorted(set(keys))

        def holds(lo: object, hi: object) -> bool:
            if wanted is None:
                return True
            if lo is None:
                return False
            i = bisect_left(wanted, lo)
            return i < len(wanted) and wanted[i] <= hi

        at = {r.node: r.digest for r in top}
        for k in range(levels, 0, -1):
            if not at:
                return {}
            below = self.level(k - 1).where(F.floor(F.col("node") / fan).isin(*at))
            found = {r.node: r for r in _parents(below, fan).collect()}
            for node, digest in at.items():
                if node not in found or found[node].digest != digest:
                    raise TornError(f"node {node} of level {k} isn't what was sealed")
            at = {c.node: c.digest for r in found.values() for c in r.children if holds(c.lo, c.hi)}
        return at

    def read(self, keys: list | None = None) -> DataFrame:
        """The rows of ``keys``, or all rows, proven before they are returned; the leaves read are pruned by folder."""
        at = self.proven_leaves(keys)
        columns, key = [c for c, _ in self.meta["columns"]], self.meta["key"]
        rows = self.rows().where(F.col("leaf").isin(*at) if at else F.lit(False))
        if at:
            found = {r.node: r.digest for r in _leaves(rows, columns, key).select("node", "digest").collect()}
            torn = sorted(n for n, d in at.items() if found.get(n) != d)
            if torn:
                raise TornError(f"leaves {torn} aren't what was sealed")
        return (rows if keys is None else rows.where(F.col(key).isin(*set(keys)) if keys else F.lit(False))).select(*columns)
