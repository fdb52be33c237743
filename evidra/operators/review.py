"""Review lifecycle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The state machine.
MOVES = {("pending", "approve"): "approved", ("pending", "reject"): "rejected", ("rejected", "reopen"): "pending", ("approved", "withdraw"): "withdrawn"}
NEEDS_NOTE = ("reject", "withdraw")
ACTOR_CHARS, NOTE_CHARS = 120, 3000


def step(status: str, revision: int, event: tuple) -> tuple[str, int, str]:
    """State after an event ``(revision, action, actor, note)`` and its outcome: applied, invalid, stale or conflict."""
    seen, action, actor, note = event
    actor, note = actor or "", note or ""
    if action not in {a for _, a in MOVES} or not actor.strip() or len(actor) > ACTOR_CHARS or len(note) > NOTE_CHARS or (action in NEEDS_NOTE and not note.strip()):
        return status, revision, "invalid"
    if seen != revision:
        return status, revision, "stale"
    after = MOVES.get((status, action))
    return (after, revision + 1, "applied") if after else (status, revision, "conflict")


_FOLDED = "doc_id long, seq long, status string, revision long, outcome string"


def fold_events(events: DataFrame) -> DataFrame:
    """``doc_id, seq, status, revision, outcome`` after each event, in ``seq`` order per document.

    ``events(doc_id, seq, revision, action, actor, note)``; a document begins
    pending at revision 1.  Rows are dealt by document, sorted, and folded
    with one state at a time, so a long history isn't gathered.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, status, revision = None, "pending", 1
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if doc is None or r.doc_id != doc:
                    doc, status, revision = r.doc_id, "pending", 1
                seen = None if pd.isna(r.revision) else int(r.revision)
                status, revision, outcome = step(status, revision, (seen, r.action, r.actor, r.note))
                out.append((r.doc_id, r.seq, status, revision, outcome))
            yield pd.DataFrame(out, columns=["doc_id", "seq", "status", "revision", "outcome"])

    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = events.select("doc_id", "seq", "revision", "action", "actor", "note").where("doc_id is not null")
    return cols.repartition(n, "doc_id").sortWithinPartitions("doc_id", "seq").mapInPandas(run, _FOLDED)


#: Who may approve automatically, and the parser of a text that a person wrote.
AUTOMATIC = "auto-review-v1"
EDITED_PARSER = "human-edited-text-v1"
LOW, HIGH = "0001-01-01", "9999-12-31"
_STATE = ["collection", "source_id", "document_version", "effective_from", "effective_to", "digest", "n_chunks", "text_error", "text_warning", "partial", "n_warnings", "duplicate", "time_sensitive", "proven"]
_EVENT = ["action", "revision", "actor", "note", "acknowledge", "mode"]
_CHANGE = ["digest", "n_chunks", "text_error", "text_warning", "source_id", "document_version", "effective_from", "effective_to"]
_GATED = "doc_id long, seq long, status string, revision long, outcome string, digest string, parser string"


def valid_interval(start: Column, end: Column) -> Column:
    """DT3: an end needs a start and comes after it."""
    return F.coalesce(end.isNull() | (start.isNotNull() & (end > start)), F.lit(False))


def local_today(now: Column, zone: str = "Asia/Ho_Chi_Minh") -> Column:
    """DT2: the day that a UTC time falls on in a fixed zone."""
    return F.from_utc_timestamp(now, zone).cast("date")


def newest_first(rows: DataFrame, order: str, limit: int) -> DataFrame:
    """The ``limit`` newest rows, the latest first."""
    return rows.orderBy(F.desc(order)).limit(limit)


class Ledger:
    """The documents of one key and what is approved among them; events are applied in order."""

    def __init__(self) -> None:
        self.docs: dict[int, dict] = {}
        self.approved: dict[tuple, dict[int, dict]] = {}

    def _keys(self, d: dict) -> tuple[tuple, tuple]:
        return ("source", d["collection"], d["source_id"]), ("digest", d["collection"], d["digest"])

    def _conflict(self, doc_id: int, d: dict) -> str | None:
        """The first approved document, by id, that has the source's version or days, or the text."""
        source, digest = self._keys(d)
        others = {**self.approved.get(source, {}), **self.approved.get(digest, {})}
        for _, o in sorted((i, o) for i, o in others.items() if i != doc_id):
            if o["source_id"] == d["source_id"]:
                if o["document_version"] == d["document_version"]:
                    return "version_exists"
                if (d["effective_from"] or LOW) < (o["effective_to"] or HIGH) and (o["effective_from"] or LOW) < (d["effective_to"] or HIGH):
                    return "period_overlaps"
            if o["digest"] == d["digest"]:
                return "content_exists"
        return None

    def apply(self, doc_id: int, given: dict, event: dict) -> tuple[str, int, str, str, str]:
        """Status, revision, outcome, digest and parser after an event; ``given`` is the document as imported."""
        d = self.docs.setdefault(doc_id, {**given, "status": "pending", "revision": 1, "parser": "imported"})
        outcome = self._edit(d, event) if event["action"] == "edit" else self._decide(doc_id, d, event)
        return d["status"], d["revision"], outcome, d["digest"], d["parser"]

    def _edit(self, d: dict, event: dict) -> str:
        """L4: only a pending document; another text takes the place of a partial one and of its parser's evidence."""
        if event["revision"] != d["revision"]:
            return "stale"
        if d["status"] != "pending":
            return "conflict"
        new = {**d, **{k: event["new_" + k] for k in _CHANGE if event["new_" + k] is not None}}
        if new["effective_to"] and (not new["effective_from"] or new["effective_to"] <= new["effective_from"]):
            return "invalid"
        if new["digest"] != d["digest"]:
            new["parser"] = EDITED_PARSER
            if d["partial"]:
                new["partial"], new["n_warnings"] = False, d["n_warnings"] + 1
        else:
            new |= {k: d[k] for k in ("n_chunks", "text_error", "text_warning")}
        d.update(new, revision=d["revision"] + 1)
        return "applied"

    def _decide(self, doc_id: int, d: dict, event: dict) -> str:
        """The state machine, and for an approval its gate."""
        status, revision, outcome = step(d["status"], d["revision"], (event["revision"], event["action"], event["actor"], event["note"]))
        if outcome != "applied":
            return outcome
        if event["action"] == "approve":
            error = d["text_error"] or d["partial"] or (d["time_sensitive"] and not d["effective_from"])
            warning = d["text_warning"] or d["n_warnings"] > 0 or d["duplicate"]
            if event["mode"] == "automatic" and (event["actor"] != AUTOMATIC or d["revision"] != 1 or not d["n_chunks"] or error or warning or not d["proven"]):
                return "not_eligible"
            if not d["n_chunks"] or error:
                return "blocked"
            if warning and event["acknowledge"] is not True:
                return "not_acknowledged"
            found = self._conflict(doc_id, d)
            if found:
                return found
        for key in self._keys(d):
            if event["action"] == "approve":
                self.approved.setdefault(key, {})[doc_id] = d
            elif event["action"] == "withdraw":
                self.approved.get(key, {}).pop(doc_id, None)
        d["status"], d["revision"] = status, revision
        return "applied"


def gate(docs: DataFrame, events: DataFrame) -> DataFrame:
    """``doc_id, seq, status, revision, outcome, digest, parser`` after each event, in ``seq`` order.

    ``docs`` has ``doc_id`` and the columns of ``_STATE``, with dates as
    strings; ``events(doc_id, seq, action, revision, actor, note, acknowledge,
    mode)`` and, for edits, ``new_…`` columns of what changes, null for what
    stays.  An approval needs chunks and no errors, a confirmation of
    warnings, and no approved document of the collection with the same
    source's version or days, or the same text.

    Only documents that share a source or a text within their collection, now
    or after an edit, can stand in each other's way, so the others are dealt
    one by one, and these by collection; a task keeps the state of the
    documents of one such collection at a time.
    """
    keep = {c: "string" for c in _STATE} | dict.fromkeys(("text_error", "text_warning", "partial", "duplicate", "time_sensitive", "proven"), "boolean") | dict.fromkeys(("n_chunks", "n_warnings"), "int")
    for c in _CHANGE:
        if "new_" + c not in events.columns:
            events = events.withColumn("new_" + c, F.lit(None).cast(keep[c]))
    e = events.select("doc_id", "seq", *_EVENT, *["new_" + c for c in _CHANGE])
    marks = docs.select("doc_id", "collection", F.explode(F.array(F.concat(F.lit("s"), "source_id"), F.concat(F.lit("d"), "digest"))).alias("mark"))
    later = e.join(docs.select("doc_id", "collection"), "doc_id").select("doc_id", "collection", F.explode(F.array(F.concat(F.lit("s"), "new_source_id"), F.concat(F.lit("d"), "new_digest"))).alias("mark"))
    every = marks.unionByName(later).where("mark is not null").distinct()
    shared = every.groupBy("collection", "mark").agg(F.count_distinct("doc_id").alias("n")).where("n > 1")
    near = every.join(shared, ["collection", "mark"], "left_semi").select("doc_id").distinct().withColumn("near", F.lit(True))
    rows = e.join(docs.select("doc_id", *[F.col(c).cast(t).alias(c) for c, t in keep.items()]), "doc_id").join(near, "doc_id", "left")
    rows = rows.withColumn("key", F.when(F.col("near"), F.concat(F.lit("c"), "collection")).otherwise(F.concat(F.lit("i"), F.col("doc_id").cast("string")))).drop("near")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ledger = None, Ledger()
        for pdf in batches:
            out = []
            for r in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
                if r["key"] != now:
                    now, ledger = r["key"], Ledger()
                given = {c: r[c] for c in _STATE}
                out.append((r["doc_id"], r["seq"], *ledger.apply(r["doc_id"], given, r)))
            yield pd.DataFrame(out, columns=["doc_id", "seq", "status", "revision", "outcome", "digest", "parser"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key").sortWithinPartitions("key", "seq", "doc_id").mapInPandas(run, _GATED)


def evidence_changes(gated: DataFrame) -> DataFrame:
    """``doc_id, change``: what the last applied event of each document does to the evidence: insert, delete, or none."""
    done = gated.where("outcome = 'applied'")
    return done.groupBy("doc_id").agg(F.max_by("status", "seq").alias("status")).select("doc_id", F.when(F.col("status") == "approved", "insert").when(F.col("status") == "withdrawn", "delete").otherwise("none").alias("change"))


def current(folded: DataFrame) -> DataFrame:
    """Last state of each document."""
    return folded.groupBy("doc_id").agg(F.max_by("status", "seq").alias("status"), F.max_by("revision", "seq").alias("revision"))


def eligible(docs: DataFrame, as_of: Column, collection: str | None = None) -> DataFrame:
    """approved documents in effect on a day, from their first day to the day before their last."""
    on = (F.col("status") == "approved") & (F.col("effective_from").isNull() | (F.col("effective_from") <= as_of)) & (F.col("effective_to").isNull() | (as_of < F.col("effective_to")))
    return docs.where(on if collection is None else on & (F.col("collection") == collection))


def overlaps(docs: DataFrame) -> DataFrame:
    """Approved documents of one collection and source whose periods overlap an earlier one's, or that repeat a version.

    Sorted by start, a period overlaps an earlier one if it begins before the
    latest end so far, so no pair is formed.  ``doc_id, conflict``.
    """
    low, high = F.lit("0001-01-01").cast("date"), F.lit("9999-12-31").cast("date")
    d = docs.where("status = 'approved'").select("doc_id", "collection", "source_id", "document_version", F.coalesce("effective_from", low).alias("a"), F.coalesce("effective_to", high).alias("b"))
    key = Window.partitionBy("collection", "source_id")
    earlier = key.orderBy("a", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    later = key.orderBy("a", "doc_id").rowsBetween(1, Window.unboundedFollowing)
    version = F.count("*").over(Window.partitionBy("collection", "source_id", "document_version")) > 1
    crosses = F.coalesce((F.col("a") < F.max("b").over(earlier)), F.lit(False)) | F.coalesce(F.min("a").over(later) < F.col("b"), F.lit(False))
    kind = F.when(version, "version").when(crosses & (F.col("a") < F.col("b")), "period")
    return d.withColumn("conflict", kind).where(F.col("conflict").isNotNull()).select("doc_id", "conflict")


#: Imports of one digest that a task puts in order.
BLOCK = 1 << 16


def duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, duplicate_of``: the newest earlier document of the collection with the same source digest.

    A digest with many copies is ordered in blocks of ``BLOCK`` consecutive
    ``seq``; the first copy of a block takes the last one of the block before.
    """
    key = ["collection", "source_sha256"]
    rows = docs.select(*key, "doc_id", "seq", F.floor(F.col("seq") / BLOCK).alias("block"))
    inside = rows.withColumn("before", F.lag("doc_id").over(Window.partitionBy(*key, "block").orderBy("seq", "doc_id")))
    last = rows.groupBy(*key, "block").agg(F.max_by("doc_id", F.struct("seq", "doc_id")).alias("last"))
    last = last.withColumn("last", F.lag("last").over(Window.partitionBy(*key).orderBy("block")))
    found = inside.join(last, [*key, "block"]).select("doc_id", F.coalesce("before", "last").alias("duplicate_of"))
    return found.where(F.col("duplicate_of").isNotNull())


def currency(snapshot: DataFrame, now: DataFrame) -> DataFrame:
    """Versions ``(id, revision, sha256)`` that only one of two sets holds; none means the index is current."""
    keys = ["id", "revision", "sha256"]
    gone = snapshot.select(*keys).exceptAll(now.select(*keys)).withColumn("side", F.lit("snapshot_only"))
    return gone.unionByName(now.select(*keys).exceptAll(snapshot.select(*keys)).withColumn("side", F.lit("current_only")))


def approval_mode(events: DataFrame) -> DataFrame:
    """Mode of the latest approval of each document; manual unless it says automatic."""
    latest = events.where("action = 'approve'").groupBy("doc_id").agg(F.max_by("mode", "seq").alias("m"))
    return latest.select("doc_id", F.when(F.col("m") == "automatic", "automatic").otherwise("manual").alias("approval_mode"))


def factual_confidence(mode: Column) -> Column:
    """What an approval says of a passage: no mode stands for checked facts."""
    return F.when(mode == "automatic", "automatically_approved_not_fact_verified").otherwise("human_reviewed_not_guaranteed")
