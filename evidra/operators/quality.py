"""Extraction quality and automatic review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns, severities and penalties of the findings.
DAMAGED = "\\x{FFFD}|[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"
DIRECTIVE = r"(?iu)ignore\s+(all\s+)?(previous|prior)\s+instructions|bỏ qua.{0,25}(chỉ dẫn|hướng dẫn)|system\s*prompt"
SENSITIVE = r"(?iu)-----BEGIN [A-Z ]*PRIVATE KEY-----|\b(?:api[_ -]?key|password|mật khẩu)\s*[:=]\s*\S+"
SHORT_WORDS = 30
SCHEMA = "struct<code:string,severity:string,penalty:int,start:int,end:int,message:string,snippet:string>"
#: What a reviewer is told; a parser's warning speaks for itself.
MESSAGES = {
    "empty": "No text was extracted; a scan needs OCR or a checked transcript.",
    "short": "Very short; see whether parts of the source are missing.",
    "partial": "Only a part of the source was parsed; a whole version is needed before approval.",
    "encoding": "Damaged or control characters; compare with the original.",
    "instruction": "Reads like an instruction to a model; it is data, and a person must look at it.",
    "sensitive": "May hold sensitive data; confirm the right to use it and remove secrets before approval.",
    "duplicate": "Same content as another document.",
    "effective_date": "Depends on time, but has no first day of effect.",
    "source_verification": "No public address to check the source at.",
    "factual_review": "Facts weren't checked.",
}
#: Characters shown before and after a match.
AROUND = {"encoding": (35, 50), "instruction": (30, 80)}
HIDDEN = "[not shown again]"


#: Words that a match of the two long patterns holds, in the form of :func:`_plain`.
DIRECTIVE_WORDS = ("instructions", "bỏ qua", "prompt")
SENSITIVE_WORDS = ("private key", "key", "password", "mật khẩu")


def _plain(text: Column) -> Column:
    """Lower case, with the letters that patterns without case take for ASCII ones."""
    return F.translate(F.lower(text), "ſı\u0307", "si")


def _holds(plain: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(plain, F.lit(w))
    return found


def _finding(when: Column, code: str, severity: str, penalty: int, pattern: str | None = None, message: Column | None = None) -> Column:
    """A finding where ``when`` holds; with a pattern, the place of its first match, which is looked for only there.

    A snippet shows what stands around the match, but a sensitive match never.
    """
    null = F.lit(None).cast("int")
    # What stands before is split off; its length counts code points, while regexp_instr counts UTF-16 units.
    start = F.length(F.get(F.split("text", pattern or "x", 2), F.lit(0)))
    end = start + F.length(F.regexp_extract("text", pattern or "x", 0))
    before, after = AROUND.get(code, (0, 0))
    first = F.greatest(F.lit(0), start - before)
    shown = F.substring("text", first + 1, end - first + after) if code in AROUND else F.lit(HIDDEN if pattern else "")
    fields = {"code": F.lit(code), "severity": F.lit(severity), "penalty": F.lit(penalty), "start": start if pattern else null, "end": end if pattern else null}
    fields |= {"message": F.lit(MESSAGES[code]) if message is None else message, "snippet": shown}
    return F.when(when, F.struct(*[c.alias(n) for n, c in fields.items()]))


def assess(docs: DataFrame) -> DataFrame:
    """``docs`` with ``findings``, ``score`` and ``label``.

    Reads ``text, partial, parser_warnings, duplicate_of, time_sensitive,
    effective_from, source_url``; those that are absent count as null.  A null
    text is an empty one.  Offsets are code points.
    """
    have = {c: F.col(c) for c in docs.columns}
    null = F.lit(None)
    text = F.coalesce(F.col("text"), F.lit(""))
    blank = ~text.rlike(r"(?U)\S")
    # The pattern stops at the thirtieth word.
    short = ~text.rlike(rf"(?U)^\s*+(?:\S++\s++){{{SHORT_WORDS - 1}}}\S")
    plain = _plain(text)
    truth = lambda c: F.coalesce(have.get(c, null).cast("boolean"), F.lit(False))
    given = lambda c: F.coalesce(have.get(c, null).cast("string"), F.lit("")) != ""
    one = [
        _finding(blank, "empty", "error", 100),
        _finding(~blank & short, "short", "warning", 15),
        _finding(truth("partial"), "partial", "error", 40),
    ]
    warnings = F.transform(F.coalesce(have.get("parser_warnings", null).cast("array<string>"), F.array().cast("array<string>")), lambda w: _finding(F.lit(True), "parser_warning", "warning", 5, message=w))
    two = [
        _finding(text.rlike(DAMAGED), "encoding", "warning", 25, DAMAGED),
        _finding(_holds(plain, DIRECTIVE_WORDS) & text.rlike(DIRECTIVE), "instruction", "warning", 10, DIRECTIVE),
        _finding(_holds(plain, SENSITIVE_WORDS) & text.rlike(SENSITIVE), "sensitive", "warning", 20, SENSITIVE),
        _finding(given("duplicate_of"), "duplicate", "warning", 10),
        _finding(truth("time_sensitive") & ~given("effective_from"), "effective_date", "error", 25),
        _finding(~given("source_url"), "source_verification", "info", 0),
        _finding(F.lit(True), "factual_review", "info", 0),
    ]
    found = F.array_compact(F.concat(F.array(*one), warnings, F.array(*two)))
    out = docs.withColumn("text", text).withColumn("findings", found)
    score = F.greatest(F.lit(0), 100 - F.aggregate("findings", F.lit(0), lambda s, f: s + f["penalty"]))
    out = out.withColumn("score", score)
    return out.withColumn("label", label(F.col("findings")))


def label(findings: Column) -> Column:
    """O18."""
    has = lambda s: F.exists(findings, lambda f: f["severity"] == s)
    return F.when(has("error"), "needs_repair").when(has("warning"), "needs_check").otherwise("ready_for_review")


def blockers(docs: DataFrame) -> DataFrame:
    """``docs`` of :func:`assess` with ``blockers``, the reasons against automatic approval; none means eligible.

    Reads ``status, revision, n_chunks, source_kind, source_url`` and the
    struct ``assessment(status, subject_match, country_gate_required,
    geography_match, verification, evidence_quotes, parse_partial,
    input_truncated)``.
    """
    a = F.col("assessment")
    yes = lambda c: F.coalesce(a[c], F.lit(False))
    state = ~F.coalesce((F.col("status") == "pending") & (F.col("revision") == 1), F.lit(False))
    poor = (F.coalesce(F.col("n_chunks"), F.lit(0)) == 0) | (F.col("score") < 90)
    flagged = F.exists("findings", lambda f: f["severity"].isin("warning", "error"))
    unproven = (
        (F.coalesce(F.col("source_kind"), F.lit("")) != "web")
        | (F.coalesce(F.col("source_url"), F.lit("")) == "")
        | (F.coalesce(a["status"], F.lit("")) != "review")
        | ~yes("subject_match")
        | (yes("country_gate_required") & ~yes("geography_match"))
        | (F.coalesce(a["verification"], F.lit("")) != "model_assessed_quotes_checked_not_fact_verified")
        | (F.coalesce(F.size(a["evidence_quotes"]), F.lit(0)) <= 0)
        | yes("parse_partial")
        | yes("input_truncated")
    )
    reasons = [F.when(c, F.lit(r)) for c, r in ((state, "state"), (poor, "quality"), (flagged, "findings"), (unproven, "assessment"))]
    return docs.withColumn("blockers", F.array_compact(F.array(*reasons)))


def severity_counts(assessed: DataFrame) -> DataFrame:
    """Number of findings and of documents by code and severity."""
    long = assessed.select("doc_id", F.explode_outer("findings").alias("f")).select("doc_id", "f.code", "f.severity")
    return long.groupBy("code", "severity").agg(F.count("*").alias("n_findings"), F.count_distinct("doc_id").alias("n_docs"))
