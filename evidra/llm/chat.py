"""Chat formatting from a declarative template.

A template gives each role the text before and after its turns, whether its
text counts for the loss, and the roles that may come before it.  The table of
allowed predecessors is a finite-state machine over roles whose state is the
last role; it accepts a conversation whose every step it allows.  Turns become
segments, each with a loss flag, and control strings inside texts are escaped
so that reading the segments back returns the turns.

Scale.  Rows are dealt by conversation and sorted by turn, and the machine
keeps one state; a conversation of any length passes through row by row and is
never gathered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = "start"


@dataclass(frozen=True)
class Role:
    before: str
    after: str
    loss: bool
    follows: frozenset[str]


@dataclass(frozen=True)
class Template:
    """``other`` formats roles without an entry; its ``before`` holds the role's escaped name at ``{}``.
    ``final`` are the roles that may end a conversation."""

    roles: dict[str, Role]
    other: Role
    final: frozenset[str]
    control: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        marks = {x.strip() for r in (*self.roles.values(), self.other) for part in (r.before, r.after) for x in part.split("{}") if x.strip()}
        object.__setattr__(self, "control", tuple(sorted(marks, key=lambda x: (-len(x), x))))
        object.__setattr__(self, "pattern", re.compile("|".join(["\\\\", *(re.escape(x) for x in self.control)])))

    def escape(self, text: str) -> str:
        """Doubles each backslash and puts one after the first character of each control string."""
        return self.pattern.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def parts(self, role: str) -> tuple[str, str, bool]:
        known = self.roles.get(role)
        if known is not None:
            return known.before, known.after, known.loss
        return self.other.before.replace("{}", self.escape(role)), self.other.after, self.other.loss

    def parse(self, formatted: str) -> Iterator[tuple[str, str]]:
        """Turns of a formatted conversation."""
        reader = Reader(self)
        yield from reader.feed(formatted)
        reader.end()


class Reader:
    """Reads turns from the text of a conversation that comes in pieces of any length; it keeps the turn that isn't whole."""

    def __init__(self, template: Template) -> None:
        self.template, self.held = template, ""
        self.name_from, self.name_to = template.other.before.split("{}")

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        held, at, t = self.held + text, 0, self.template
        while at < len(held):
            for role, r in t.roles.items():
                if held.startswith(r.before, at):
                    start, after = at + len(r.before), r.after
                    break
            else:
                end = held.find(self.name_to, at)
                if not held.startswith(self.name_from, at) or end < 0:
                    break
                role, start, after = t.unescape(held[at + len(self.name_from) : end]), end + len(self.name_to), t.other.after
            end = held.find(after, start)
            if end < 0:
                break
            yield role, t.unescape(held[start:end])
            at = end + len(after)
        self.held = held[at:]

    def end(self) -> None:
        if self.held:
            raise ValueError("the conversation doesn't end with a turn")


DEFAULT = Template(
    roles={
        "system": Role("<<SYS>> ", " <</SYS>>", False, frozenset({START})),
        "user": Role("[INST] ", " [/INST]", False, frozenset({START, "system", "assistant"})),
        "assistant": Role("<s>", "</s>", True, frozenset({"user"})),
    },
    other=Role("[ROLE] {} [NAME] ", " [/ROLE]", False, frozenset()),
    final=frozenset({"assistant"}),
)

_SEGMENTS = "conv_id long, place long, turn long, role string, seq int, segment string, loss boolean, step_ok boolean"


def format_chat(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Segments of ``conversations(conv_id, turn, role, text)``, three a turn: opening, text, closing.

    ``place`` numbers a conversation's turns and ``seq`` a turn's segments; ``loss`` marks the text of roles that
    count; ``step_ok`` tells whether the machine allows the role after the one
    before it.  Turns that it doesn't allow are formatted all the same.  Rows
    with equal ``turn`` go by role, then text, and repeated rows are turns of
    their own; null turns come first.  A null text or role is an empty one; a
    role that the template lacks takes its ``other`` entry.  Rows with a null
    ``conv_id`` are one conversation.  Segments of a conversation follow each
    other in one partition.  An empty table gives none; other columns are not
    read.
    """
    t = template

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: object = batches  # no conversation yet
        state, place = START, 0
        for batch in batches:
            out: list[tuple] = []
            for conv_id, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv_id != conv:
                    conv, state, place = conv_id, START, 0
                before, after, loss = t.parts(role)
                known = t.roles.get(role, t.other)
                ok = state in known.follows
                state = role
                for seq, (segment, flag) in enumerate(((before, False), (t.escape(text), loss), (after, False))):
                    out.append((conv_id, place, turn, role, seq, segment, flag, ok))
                place += 1
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]
                names = [x.split()[0] for x in _SEGMENTS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, _SEGMENTS)


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_chat(segments: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row for each conversation of :func:`format_chat` segments, in any order, read back from their text.

    The segments of a conversation are laid end to end, and turns are parsed
    from that text alone.  ``turns_sha256`` digests role, newline, text,
    newline of each turn; ``loss_*`` the text under the loss flags, unescaped;
    ``valid`` tells whether the machine accepts the conversation.
    """
    t = template

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: object = batches
        state: list = []
        out: list[tuple] = []

        def close() -> None:
            if state:
                turns, loss, n, chars, size, valid, role, reader = state
                reader.end()
                out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, valid and role in t.final))

        for batch in batches:
            for conv_id, segment, loss, ok in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not state or conv_id != conv:
                    close()
                    conv, state = conv_id, [hashlib.sha256(), hashlib.sha256(), 0, 0, 0, True, "", Reader(t)]
                state[4] += len(segment)
                state[5] = state[5] and ok
                if loss:
                    text = t.unescape(segment)
                    state[1].update(text.encode())
                    state[3] += len(text)
                for role, text in state[7].feed(segment):
                    state[0].update(f"{role}\n{text}\n".encode())
                    state[2], state[6] = state[2] + 1, role
            if out:
                yield _rows(out)
                out.clear()
        close()
        if out:
            yield _rows(out)

    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = segments.repartition(n, "conv_id").sortWithinPartitions("conv_id", "place", "seq")
    return rows.select("conv_id", "segment", "loss", "step_ok").mapInArrow(run, _READ)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in _READ.split(", ")])
