"""A lexical index that takes inserts, replacements and withdrawals.

A batch writes one immutable segment: postings by ranges of terms, and the
length of each document.  What a batch withdraws or replaces is a table of
delete bitmaps, a 64-bit number for each block of 64 rows that were born in one
batch; nothing that is written is changed again.  A version is a small file
that names the segments and bitmaps which belong to it and carries the merged
statistics, so a reader keeps the version it has opened while writers go on,
and a batch that fails leaves no trace in any version.

Segments of about one size are merged, without their dead rows, when there are
``fan`` of them, so a search opens few files and a row is rewritten about
log(rows) times in its life.  Rows keep the place they were born with; no
bitmap is renumbered, and those that no segment needs any more are left out.

A search reads the postings of its terms in all segments, leaves out those
whose bit is set, and scores with the statistics of what is alive: its scores
are those of an index built anew.

One writer at a time; a second one that writes the same version fails.  Of
several rows of one document in a batch the one with the greatest text counts,
null first; rows without an id are left out; a null text has no words.  In one
batch withdrawals come before inserts.  An empty batch makes a version too.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import text as T
from evidra.operators.search import bm25_index, ranked
from evidra.sources.folders import stored

_DOCS = "born int, ord long, doc_id {id}, dl int"
_POSTINGS = "term string, born int, ord long, doc_id {id}, tf long, dl int"
_BITS = "born int, block long, bits long"


@dataclass(frozen=True)
class Version:
    number: int = 0
    #: Name and rows alive when it was written, of each segment.
    segments: tuple[tuple[str, int], ...] = ()
    deletes: tuple[str, ...] = ()
    rows: int = 0
    words: int = 0


class SegmentedIndex:
    """The index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "long", fan: int = 4) -> None:
        if fan < 2:
            raise ValueError("fan must be 2 at least")
        self.spark, self.path, self.id_type, self.fan = spark, path.rstrip("/"), id_type, fan

    def version(self) -> Version:
        """The newest version; an index that nothing was written to is empty."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        # A version counts from the moment its writer has finished it.
        found = [int(s.getPath().getName()) for s in fs.listStatus(folder) if fs.exists(self._marker(s.getPath()))] if fs.exists(folder) else []
        if not found:
            return Version()
        given = json.loads(self.spark.read.text(f"{self.path}/versions/{max(found)}").first()[0])
        return Version(given["number"], tuple(map(tuple, given["segments"])), tuple(given["deletes"]), given["rows"], given["words"])

    def _marker(self, folder):  # noqa: ANN001, ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")

    def _publish(self, v: Version) -> Version:
        text = json.dumps({"number": v.number, "segments": v.segments, "deletes": v.deletes, "rows": v.rows, "words": v.words})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{self.path}/versions/{v.number}")
        return v

    def _read(self, names: list[str], kind: str, schema: str) -> DataFrame:
        schema = schema.format(id=self.id_type)
        paths = [f"{self.path}/{n}/{kind}" for n in names]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _dead(self, deletes: tuple[str, ...]) -> DataFrame:
        """The bitmaps of all batches, united by block."""
        rows = self._read(list(deletes), "bits", _BITS)
        return rows.groupBy("born", "block").agg(F.expr("bit_or(bits)").alias("bits")) if len(deletes) > 1 else rows

    def _alive(self, rows: DataFrame, deletes: tuple[str, ...]) -> DataFrame:
        if not deletes:
            return rows
        held = rows.withColumn("block", _block()).join(self._dead(deletes), ["born", "block"], "left")
        return held.where(F.col("bits").isNull() | (F.call_function("getbit", F.coalesce("bits", F.lit(0).cast("long")), _bit()) == 0)).drop("block", "bits")

    def live(self, v: Version | None = None) -> DataFrame:
        """``born, ord, doc_id, dl`` of the documents alive."""
        v = v or self.version()
        return self._alive(self._read([n for n, _ in v.segments], "docs", _DOCS), v.deletes)

    def postings(self, terms: list[str], v: Version | None = None) -> DataFrame:
        """``doc_id, term, tf, dl`` of the documents alive; a term's range of the files is read."""
        v = v or self.version()
        rows = self._read([n for n, _ in v.segments], "postings", _POSTINGS)
        return self._alive(rows.where(F.col("term").isin(*terms)) if terms else rows.where("false"), v.deletes).select("doc_id", "term", "tf", "dl")

    def apply(self, inserts: DataFrame, withdrawals: DataFrame | None = None) -> Version:
        """A new version with ``inserts(doc_id, text)``, which replace what has their ids, and without ``withdrawals(doc_id)``."""
        v = self.version()
        number = v.number + 1
        once = inserts.where("doc_id is not null").select("doc_id", "text").groupBy("doc_id").agg(F.max("text").alias("text"))
        words = F.coalesce(T.words(T.fold(F.col("text"))), F.array().cast("array<string>"))
        batch = stored(once.select(F.lit(number).alias("born"), F.monotonically_increasing_id().alias("ord"), F.col("doc_id").cast(self.id_type), words.alias("w")), "batch")
        gone = batch.select("doc_id")
        if withdrawals is not None:
            gone = gone.unionByName(withdrawals.select(F.col("doc_id").cast(self.id_type))).where("doc_id is not null").distinct()
        # What dies was alive so far, so each row is taken from the statistics once.
        dying = stored(self.live(v).join(gone, "doc_id", "left_semi"), "dying")
        lost = dying.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        deletes = v.deletes
        if lost[0]:
            bits = dying.groupBy("born", _block().alias("block")).agg(F.expr("bit_or(shiftleft(1L, cast(ord & 63 as int)))").alias("bits"))
            bits.write.parquet(f"{self.path}/deletes-{number}/bits")
            deletes = (*deletes, f"deletes-{number}")
        docs = batch.select("born", "ord", "doc_id", F.size("w").alias("dl"))
        # Words are counted inside their row; the outer form infers no filter, which would count them again.
        posted = batch.select("born", "ord", "doc_id", F.size("w").alias("dl"), F.explode_outer(T.word_counts(F.col("w"))).alias("p")).where("p.term is not null")
        new = self._write(f"segment-{number}", docs, posted.select("p.term", "born", "ord", "doc_id", "p.tf", "dl"))
        segments = (*v.segments, (f"segment-{number}", new[0])) if new[0] else v.segments
        return self._publish(Version(number, segments, deletes, v.rows - lost[0] + new[0], v.words - lost[1] + new[1]))

    def _write(self, name: str, docs: DataFrame, posted: DataFrame) -> tuple[int, int]:
        """Stores a segment; its rows and words."""
        docs.write.parquet(f"{self.path}/{name}/docs")
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        columns = ["term", "born", "ord", "doc_id", "tf", "dl"]
        # Ranges by document as well, so a frequent term's postings are in several files.
        posted.select(*columns).repartitionByRange(n, "term", "ord").sortWithinPartitions("term", "ord").write.parquet(f"{self.path}/{name}/postings")
        found = self._read([name], "docs", _DOCS).agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return found[0], found[1]

    def compact(self) -> Version:
        """Merges the segments of each size of which there are ``fan``; the version stays the same if there is none."""
        v = self.version()
        tiers: dict[int, list[tuple[str, int]]] = {}
        for name, rows in v.segments:
            tiers.setdefault(int(math.log(max(rows, 1), self.fan)), []).append((name, rows))
        merged = [s for own in tiers.values() if len(own) >= self.fan for s in own]
        if not merged:
            return v
        names, number = [n for n, _ in merged], v.number + 1
        docs = self._alive(self._read(names, "docs", _DOCS), v.deletes)
        rows, _ = self._write(f"segment-{number}", docs, self._alive(self._read(names, "postings", _POSTINGS), v.deletes))
        left = tuple(s for s in v.segments if s not in merged)
        segments = (*left, (f"segment-{number}", rows)) if rows else left
        # Without older segments no dead row is left anywhere.
        return self._publish(Version(number, segments, v.deletes if left else (), v.rows, v.words))

    def scores(self, terms: list[str], v: Version | None = None) -> DataFrame:
        """``doc_id, score`` of the documents alive that hold a term."""
        v = v or self.version()
        return bm25_index(self.postings(sorted(set(terms)), v), v.rows, v.words / v.rows if v.rows else 0.0, terms)

    def search(self, terms: list[str], k: int = 20, v: Version | None = None) -> DataFrame:
        """``doc_id, score, rank`` of the best documents; ties by ``doc_id``."""
        return ranked(self.scores(terms, v).withColumn("score", F.round("score", 6)), "score", [F.asc("doc_id")], k)

    def apply_changes(self, changes: DataFrame, docs: DataFrame) -> Version:
        """The evidence after ``changes(doc_id, change)`` of the review: ``insert`` takes the text of ``docs``, ``delete`` withdraws."""
        inserts = docs.join(changes.where("change = 'insert'").select("doc_id"), "doc_id", "left_semi")
        return self.apply(inserts, changes.where("change = 'delete'").select("doc_id"))


def _block() -> Column:
    return F.shiftright("ord", 6)


def _bit() -> Column:
    return F.col("ord").bitwiseAND(F.lit(63)).cast("int")
