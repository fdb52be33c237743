"""Personal data in whole texts: exact patterns, and a linear-chain conditional random field.

Four kinds have exact rules: email, ip, card, phone.  Spans of these always
stay.  The field tags what has no fixed pattern: ``secret`` (credentials),
``ssn`` (national ids in groups), ``iban`` and ``local`` (telephone numbers
without a country code).  It is trained on a small labelled table made from a
seed, sees word shapes, word beginnings, the word before and what stands
between words, and is decoded by Viterbi over lines, many lines at a time.  A
line of more than ``crf.LONGEST`` words is read in pieces of that length.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.llm import blocks as B
from evidra.llm import crf

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("secret", "ssn", "iban", "local")
KINDS = BASE_KINDS + ADDED_KINDS
LABELS = ("O", *(f"{x}-{k}" for k in ADDED_KINDS for x in "BI"))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans ``(kind number, start, end)`` of the exact rules, by kind and start; linear in the text's length.

    Per kind the leftmost matches that don't overlap; a match that fails its
    check is dropped and the search goes on behind it.
    """
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def training_table(seed: int = 17, rows: int = 900) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The labelled table: lines and their spans, the same for equal arguments."""
    rng = random.Random(seed)
    pick = rng.choice
    hexa, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    mixed = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz0123456789"

    def some(alphabet: str, n: int) -> str:
        return "".join(pick(alphabet) for _ in range(n))

    def word() -> str:
        w = "".join(pick("bcdfghklmnprstvwz") + pick("aeiouéöíè") for _ in range(rng.randint(1, 4))) + pick(["", "n", "s", "r", "th"])
        return pick([w, w, w, w, w.capitalize(), w.upper(), w + ",", w + ".", w + "!!", w + "$$$", "**" + w, w + " |"])

    def number(n: int) -> str:
        return pick("123456789") + some("0123456789", n - 1)

    def secret() -> tuple[str, str]:
        s = pick([some(hexa, rng.randint(10, 16)), some(hexa, pick([16, 20, 24, 32, 40, 40, 64])), some(mixed, rng.randint(12, 40))])
        if not any(c.isdigit() for c in s):
            s = s[:3] + number(2) + s[5:]
        name = pick(["password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "access_token", "Password", "TOKEN", "contraseña", "Passwort"])
        quote = pick(['"', "'", ""])
        return name + pick(["=", " = ", ": ", ":", "="]) + quote, s + "\0" + quote

    def iban() -> str:
        body = some("0123456789", pick([16, 18, 20]))
        head = pick(["DE", "FR", "ES", "GB", "NL", "IT"]) + number(2)
        return pick([head + body, " ".join([head, *(body[i : i + 4] for i in range(0, len(body), 4))])])

    def ssn() -> str:
        return f"{number(3)}-{number(2)}-{number(4)}"

    def local() -> str:
        return pick([f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}"])

    def plain() -> str:
        return pick(
            [
                lambda: number(rng.randint(1, 7)), lambda: f"{number(1)}.{number(1)}", lambda: f"20{number(2)}-0{number(1)}-{number(2)}", lambda: number(4), lambda: number(16), lambda: f"{number(4)} {number(4)} {number(4)} {number(4)}",
                lambda: f"{number(3)}.{number(2)}.{number(2)}.{number(1)}", lambda: f"+{number(1)} ({number(3)}) 555-{number(4)}", lambda: "Version 2.0.", lambda: "version 3.", lambda: pick(["decade", "facade", "beef", "deed", "added"]),
                lambda: word().strip(",.") + pick("0123456789"), lambda: pick(["B2B", "A4", "H2O", "mp3", "COVID-19", "x86"]), lambda: f"{word()}@{word()}.org", lambda: f"§ {number(2)}", lambda: f"http://www.example.org/{number(3)}", lambda: f"{number(1)},{number(3)}.{number(2)}",
                lambda: "token of " + word(), lambda: "the password is lost", lambda: "secret: " + word(), lambda: f"{number(2)}:{number(2)}", lambda: "x = " + number(2), lambda: word() + " = " + word(),
            ]
        )()

    table = []
    for _ in range(rows):
        text, spans = "", []
        for _ in range(rng.randint(2, 14)):
            turn = rng.random()
            if turn < 0.8:
                piece, kind, before, after = word(), "", "", ""
            elif turn < 0.88:
                piece, kind, before, after = plain(), "", "", ""
            elif turn < 0.93:
                before, rest = secret()
                piece, after = rest.split("\0")
                kind = "secret"
            elif turn < 0.95:
                piece, kind, before, after = "AKIA" + some(upper, 16), "secret", "", ""
            elif turn < 0.96:
                piece, kind, before, after = pick(["ghp_", "sk_live_", "xoxb-", "glpat-"]) + some(mixed, 30) + number(2), "secret", pick(["", "Bearer "]), ""
            elif turn < 0.975:
                piece, kind, before, after = ssn(), "ssn", pick(["", "SSN ", "SSN: "]), ""
            elif turn < 0.985:
                piece, kind, before, after = iban(), "iban", pick(["", "IBAN ", "IBAN: "]), ""
            else:
                piece, kind, before, after = local(), "local", pick(["", "tel ", "phone: "]), ""
            text += (" " if text else "") + before
            if kind:
                spans.append((len(text), len(text) + len(piece), kind))
            text += piece + after
        table.append((text, spans))
    return table


_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[95] = True
_WORD[128:] = True
_BITS = np.zeros(256, np.uint8)
_BITS[97:123] = _BITS[128:] = 1
_BITS[65:91] = 2
_BITS[48:58] = 4
_BITS[95] = 8
_HEX = np.zeros(256, bool)
_HEX[48:58] = _HEX[97:103] = True
_SIZES = np.array([1, 2, 3, 4, 5, 8, 10, 13, 16, 17, 20, 21, 24, 32, 40, 41])


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple:
    """Words, their feature keys, and the lines that are chains."""
    start, end, doc = B.segment(data, offs, _WORD)
    if not len(start):
        none = np.zeros(0, np.int64)
        return start, end, doc, [np.zeros(0, np.uint64)] * 9, none, none
    line = np.concatenate(([0], np.cumsum(data == 10)))
    new = crf.limited(np.concatenate(([True], (doc[1:] != doc[:-1]) | (line[start[1:]] != line[end[:-1]]))))
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(start)))
    size = end - start
    bits = _BITS[data]
    shape = np.zeros(len(start), np.uint64)
    for bit in (1, 2, 4, 8):
        n = np.concatenate(([0], np.cumsum((bits & bit) > 0)))
        shape |= ((n[end] > n[start]) * bit).astype(np.uint64)
    turns = np.concatenate(([0, 0], np.cumsum(bits[1:] != bits[:-1])))
    switch = turns[end] - turns[start + 1]
    hexa = np.concatenate(([0], np.cumsum(_HEX[data])))
    shape |= (hexa[end] - hexa[start] == size).astype(np.uint64) << np.uint64(4)
    shape |= np.minimum(switch, 4).astype(np.uint64) << np.uint64(5)
    shape |= np.searchsorted(_SIZES, size, "right").astype(np.uint64) << np.uint64(8)
    sums = B.prefix_sums(data, B.byte_values(lower=True))
    whole = B.fingerprints(sums, start, end)
    stem = B.fingerprints(sums, start, np.minimum(end, start + 4))
    gap = np.zeros(len(start), np.uint64)
    before = np.maximum(start - 4, np.concatenate(([0], end[:-1])))
    inner = ~new
    gap[inner] = B.fingerprints(sums, before[inner], start[inner])

    def shifted(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(x)
        if by > 0:
            out[1:] = np.where(new[1:], 0, x[:-1])
        else:
            out[:-1] = np.where(new[1:], 0, x[1:])
        return out

    last = shifted(whole, 1)
    step = np.uint64(0x9FB21C651E98DF25)
    keys = [shape, shifted(shape, 1) + np.uint64(1 << 20), shifted(shape, -1) + np.uint64(1 << 20), last, gap, shifted(gap, -1), stem, B.mix(shape * step + gap), B.mix(last * step + gap)]
    return start, end, doc, keys, first, length


@lru_cache(maxsize=1)
def default_model() -> crf.Crf:
    """The field trained on :func:`training_table`; a few seconds on the driver."""
    table = training_table()
    texts = [t for t, _ in table]
    data, offs = B.utf8(pa.array(texts, pa.string()))
    start, end, doc, keys, first, length = _tokens(data, offs)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    gold = np.zeros(len(start), np.int64)
    spans = [s for _, s in table]
    for t in range(len(start)):
        a = points[start[t]] - points[offs[doc[t]]]
        for x, y, kind in spans[doc[t]]:
            if x <= a < y:
                opens = t == 0 or doc[t - 1] != doc[t] or points[start[t - 1]] - points[offs[doc[t]]] < x
                gold[t] = LABELS.index(("B-" if opens else "I-") + kind)
    forbid = tuple((x, y) for y in LABELS if y[0] == "I" for x in LABELS if x[2:] != y[2:])
    model = crf.train(LABELS, keys, gold, first, length, rounds=80, l2=0.1, least=2, forbid=forbid)
    model.start[[LABELS.index(y) for y in LABELS if y[0] == "I"]] = -30
    return model


def added_spans(model: crf.Crf, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Spans ``(document, kind number, start, end)`` of the field, in code points, for texts end to end."""
    start, end, doc, keys, first, length = _tokens(data, offs)
    if not len(start):
        return []
    best = crf.viterbi(model, model.emissions(model.columns(keys)), first, length)
    at = np.flatnonzero(best)
    if not len(at):
        return []
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    out: list[list[int]] = []
    for t in at.tolist():
        label, d = LABELS[best[t]], int(doc[t])
        kind = len(BASE_KINDS) + ADDED_KINDS.index(label[2:])
        a, b = int(points[start[t]] - points[offs[d]]), int(points[end[t]] - points[offs[d]])
        if label[0] == "I" and out and out[-1][0] == d and out[-1][1] == kind:
            out[-1][3] = b
        else:
            out.append([d, kind, a, b])
    return [tuple(x) for x in out]


_FOUND = "spans array<struct<kind:string,start:long,end:long>>"


def find_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``spans`` of all personal data in ``text``, by kind as in ``KINDS``, then start.

    Offsets are code points, end exclusive.  Null and empty texts have none.
    Other columns pass through, but for one named ``spans`` in any case, which
    is replaced.  Repeated rows get equal results; an empty table gives an empty
    table.
    """
    model = default_model()
    rest = [c for c in docs.columns if c.lower() != "spans"]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = B.utf8(batch.column(0))
            for i, j in B.slices(offs):
                own, bounds = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                found: list[list[tuple[int, int, int]]] = [[] for _ in range(j - i)]
                marks = np.concatenate(([0], np.cumsum(((own >= 48) & (own < 58)) | (own == 64))))
                for d in np.flatnonzero(marks[bounds[1:]] > marks[bounds[:-1]]).tolist():
                    found[d] = base_spans(own[bounds[d] : bounds[d + 1]].tobytes().decode())
                for d, k, a, b in added_spans(model, own, bounds):
                    found[d].append((k, a, b))
                spans = [[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(x)] for x in found]
                cols = [batch.column(c).slice(i, j - i) for c in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(spans, kind)], [*rest, "spans"])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest] + [_FOUND])
    return docs.select(F.col("text").cast("string").alias("searched text"), *[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in angle brackets; spans that overlap count as the first of them."""
    order = F.array_sort(spans, lambda x, y: F.when(x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(F.signum(y["end"] - x["end"])).cast("int"))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        out = F.when(new, F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("<"), s["kind"], F.lit(">"))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    return F.aggregate(order, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
