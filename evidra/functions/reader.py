"""A whole HTML page as one document whose parts know their place in its text.

One parse gives everything.  The main content is found by the text and link
density of the tree: a block's prose is its own characters, less four times
those inside links; from the root the search goes down to the child that holds
over half of the prose of its parent, as long as there is one.  An element that
is marked as an article is taken instead if the main content misses over half
of its prose.

Text is written a line for each block.  Formulas, headings, table cells and
leads are marked while it is written; leads that lie elsewhere are put before
it and formulas behind it, and :func:`rebase` moves the marks.  Offsets count
code points, end exclusive.
"""

from __future__ import annotations

import codecs
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column

from evidra.functions import markup as M
from evidra.functions.text import decomposed
from evidra.functions.udf import batched

# Marks of challenge pages, sizes, and the line before added formulas.
CHALLENGES = ("cf-chl-", "verify you are human", "captcha-container")
MIN_TEXT = 150
MAX_TEXT = 600_000
SUPPLEMENT = "\n\nCông thức MathML bổ sung từ trang gốc (cần đối chiếu XPath):\n"
DATES = frozenset({"article:published_time", "datepublished", "date", "dc.date", "dcterms.created"})

_HEADINGS = frozenset({"h1", "h2", "h3"})
_CELLS = frozenset({"td", "th"})
_INNER = frozenset({"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "figcaption", "tr", "td", "th", "br", "table", "thead", "tbody", "tfoot"})
_HIDDEN = M.NOISE | {"head", "title"}


def _hidden(node: M.Node) -> bool:
    return node.tag in _HIDDEN or bool(node.names() & M.NOISE_NAMES)


def rebase(spans: list[tuple[int, int]], inserted: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of a text after ``inserted(position, length)``, positions in the old text and ascending.

    What is inserted at a span's start comes before the span, at its end behind it.
    An empty span stays empty.
    """
    at = [p for p, _ in inserted]
    shift = [0, *accumulate(n for _, n in inserted)]
    moved = []
    for start, end in spans:
        first = start + shift[bisect_right(at, start)]
        moved.append((first, first if end == start else end + shift[bisect_left(at, end)]))
    return moved


class Lines:
    """Text of elements, white space collapsed, a line for each block, with the spans of marked elements."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.gap = self.broken = False
        self.waiting: list[int] = []
        self.marks: list[list] = []

    def write(self, text: str) -> None:
        """Adds text; a line end inside it ends the line too."""
        for k, line in enumerate(text.split("\n")):
            if k:
                self.edge()
            self._piece(line)

    def _piece(self, text: str) -> None:
        words = text.split()
        if not words:
            self.gap |= bool(text)
            return
        before = "" if not self.size else "\n" if self.broken else " " if self.gap or text[0].isspace() else ""
        piece = " ".join(words)
        for k in self.waiting:
            self.marks[k][1] = self.size + len(before)
        self.waiting.clear()
        self.parts += (before, piece)
        self.size += len(before) + len(piece)
        self.gap, self.broken = text[-1].isspace(), False

    def edge(self) -> None:
        self.broken, self.gap = True, False

    def open(self, what: object) -> int:
        self.waiting.append(len(self.marks))
        self.marks.append([what, -1, -1])
        return len(self.marks) - 1

    def shut(self, k: int) -> None:
        """Ends a mark; one without text takes no place."""
        if self.marks[k][1] < 0:
            self.waiting.remove(k)
        else:
            self.marks[k][2] = self.size

    def text(self) -> str:
        return "".join(self.parts)


def _prose(root: M.Node) -> dict[int, int]:
    """Prose of every element by its identity: that of the blocks in it, without noise."""
    own: dict[int, list[int]] = {id(root): [0, 0]}
    order: list[M.Node] = []
    stack: list[tuple[M.Node, int, bool]] = [(root, id(root), False)]
    while stack:
        node, block, linked = stack.pop()
        order.append(node)
        for c in node.children:
            if isinstance(c, str):
                n = sum(map(len, c.split()))
                own[block][0] += n
                own[block][1] += n if linked else 0
            elif not _hidden(c):
                inside = block
                if c.tag in M.BLOCKS or c.tag in M.SCOPE:
                    inside = id(c)
                    own[inside] = [0, 0]
                stack.append((c, inside, linked or c.tag == "a"))
    total = {id(n): max(0, own[id(n)][0] - 4 * own[id(n)][1]) if id(n) in own else 0 for n in order}
    for n in reversed(order):
        if n.parent is not None and n is not root:
            total[id(n.parent)] += total[id(n)]
    return total


def main_content(root: M.Node) -> M.Node:
    """The smallest container that is reached by steps which keep over half of the prose."""
    prose = _prose(root)
    at = root
    while True:
        down = next((c for c in at.children if isinstance(c, M.Node) and c.tag not in _INNER and 2 * prose.get(id(c), 0) > prose[id(at)]), None)
        if down is None:
            return at
        at = down


def write(node: M.Node, lines: Lines, formulas: dict[int, str], leads: set[int]) -> None:
    """An element's text into ``lines``; formulas as their linear text."""
    stack: list[tuple[str, object]] = [("visit", node)]
    while stack:
        step, x = stack.pop()
        if step == "shut":
            lines.shut(x)
        elif step == "edge":
            lines.edge()
        elif isinstance(x, str):
            lines.write(x)
        elif id(x) in formulas:
            k = lines.open(("formula", x))
            lines.write(formulas[id(x)])
            lines.shut(k)
        elif not _hidden(x):
            edges = x.tag in M.BLOCKS
            if edges:
                lines.edge()
                stack.append(("edge", None))
            if id(x) in leads or x.tag in _HEADINGS or x.tag in _CELLS:
                kind = "lead" if id(x) in leads else "heading" if x.tag in _HEADINGS else "cell"
                stack.append(("shut", lines.open((kind, x))))
            stack.extend(("visit", c) for c in reversed(x.children))


def _fold(text: str) -> str:
    return " ".join(decomposed(pd.Series([text], dtype="string"), "NFKD").iloc[0].split())


def _meta(root: M.Node) -> str | None:
    for n in root.walk():
        if n.tag == "meta" and (n.attrs.get("property") or n.attrs.get("name") or n.attrs.get("itemprop") or "").lower() in DATES and n.attrs.get("content", "").strip():
            return n.attrs["content"].strip()
    return None


def read(html: str, least: int = MIN_TEXT) -> dict:
    """The document of a page; ``error`` tells why there is none, and all else is null then.

    A main content of fewer than ``least`` characters without a useful table is an error.
    """
    lower = html.lower()
    if any(m in lower for m in CHALLENGES):
        return {"error": "challenge page"}
    root = M.parse(html)
    try:
        formulas = M.formulas(root)
        leads = M.leads(root)
        links, published, title = M.links(root), _meta(root), M.title(root)
        tables = M.tables(root)
    except M.MarkupError as e:
        return {"error": str(e)}
    # Places are those in the page, so they are taken before noise leaves the tree.
    marked = {n.path(): n for n in root.walk() if n.tag in _HEADINGS | _CELLS | {"math"} or M.LEAD_NAMES & set(re.split(r"[\s_-]+", n.attrs.get("class", "").lower()))}
    paths = {id(n): p for p, n in marked.items()}
    inline = {id(marked[f["locator"]]): f["text"] for f in formulas}
    lead_nodes = {id(marked[x["locator"]]) for x in leads}

    def written(node: M.Node) -> Lines:
        lines = Lines()
        write(node, lines, inline, lead_nodes)
        return lines

    lines = written(main_content(root))
    article = M.article_body(root, lines.text())
    if article is not None:
        lines = written(article)
    text = lines.text()
    useful = any(t["row_count"] >= 2 and t["column_count"] >= 2 for t in tables)
    if not text and useful:
        text = "\n".join("\n".join([t["caption"], *(c["text"] for c in t["cells"])]) for t in tables)
    if not text:
        return {"error": "no content"}
    if len(text.strip()) < least and not useful:
        return {"error": "content is too short"}

    marks = [(kind, paths[id(node)], start, end) for (kind, node), start, end in lines.marks if start >= 0]
    folded = _fold(text)
    before = [x for x in leads if _fold(x["text"]) not in folded]
    prefix = "".join(x["text"] + "\n\n" for x in before)
    moved = rebase([(s, e) for *_, s, e in marks], [(0, len(prefix))] if prefix else [])
    spans = [{"kind": k, "locator": p, "start": s, "end": e} for (k, p, *_), (s, e) in zip(marks, moved, strict=True)]
    text = prefix + text
    at = 0
    for x in before:
        spans.append({"kind": "lead", "locator": x["locator"], "start": at, "end": at + len(x["text"])})
        at += len(x["text"]) + 2
    missing = [f for f in formulas if f["text"] not in text]
    if missing:
        text += SUPPLEMENT
        for f in missing:
            spans.append({"kind": "formula", "locator": f["locator"], "start": len(text), "end": len(text) + len(f["text"])})
            text += f"{f['text']} [{f['locator']}]\n"
    if len(text) > MAX_TEXT:
        return {"error": "text is too long"}
    place = {(s["kind"], s["locator"]): (s["start"], s["end"]) for s in spans}

    def placed(kind: str, found: list[dict]) -> list[dict]:
        """With the place of each part whose very string stands there."""
        out = []
        for x in found:
            start, end = place.get((kind, x["locator"]), (None, None))
            same = start is not None and text[start:end] == x["text"]
            out.append(x | {"start": start if same else None, "end": end if same else None})
        return out

    spans.sort(key=lambda s: (s["start"], s["end"], s["kind"]))
    return {"title": title, "text": text, "published_at": published, "links": links, "tables": tables, "leads": placed("lead", leads), "formulas": placed("formula", formulas), "spans": spans, "error": None}


DOCUMENT = (
    f"struct<title:string,text:string,published_at:string,links:array<struct<href:string,title:string,css:string>>,tables:array<{M.TABLE}>,"
    "leads:array<struct<text:string,locator:string,start:int,end:int>>,formulas:array<struct<text:string,locator:string,mathml:string,start:int,end:int>>,"
    "spans:array<struct<kind:string,locator:string,start:int,end:int>>,error:string>"
)
_FIELDS = ("title", "text", "published_at", "links", "tables", "leads", "formulas", "spans", "error")


def charset(body: bytes, declared: str | None) -> str:
    """Name of a body's charset: by its byte order mark, its declared type, its own meta element, else UTF-8."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if body.startswith(mark):
            return name
    given = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", declared or "", re.I)
    if given:
        return given[1]
    inside = re.search(rb"<meta[^>]+charset\s*=\s*[\"']?([\w.:-]+)", body[:2048], re.I)
    return inside[1].decode("ascii", "replace") if inside else "utf-8"


def read_body(body: bytes | None, declared: str | None, least: int = MIN_TEXT) -> dict | None:
    """The document of a page's bytes; those that aren't of the charset become U+FFFD.  Null without a body."""
    if body is None:
        return None
    try:
        text = body.decode(charset(body, declared), errors="replace")
    except LookupError:
        return dict.fromkeys(_FIELDS) | {"error": "unknown charset"}
    return dict.fromkeys(_FIELDS) | read(text, least)


def html_document(body: Column, declared: Column, least: int = MIN_TEXT) -> Column:
    """The whole reader over ``body`` (bytes) and ``declared`` (its media type), a struct ``DOCUMENT``."""

    @batched(DOCUMENT)
    def run(body: pd.Series, declared: pd.Series) -> pd.Series:
        return pd.Series([read_body(b, d, least) for b, d in zip(body, declared, strict=True)], dtype=object)

    return run(body, declared)
