"""HTML extraction on a small tree built with the standard library."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from evidra.functions.udf import batched

# Element and class names, and size limits.
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
CLOSED_BY = {"p": frozenset({"p", "div", "table", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "section", "article", "address", "aside", "dl", "fieldset", "figcaption", "figure", "footer", "form", "header", "hr", "main", "nav"}), "li": frozenset({"li"}), "tr": frozenset({"tr", "tbody", "thead", "tfoot"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option"})}
SCOPE = frozenset({"table", "ul", "ol", "article", "section", "div", "body", "html"})
NOISE = frozenset({"script", "style", "noscript", "svg", "nav", "footer", "aside", "form"})
NOISE_NAMES = frozenset({"related", "related-articles", "related-posts", "recommended", "comments", "share", "social-share", "sharing"})
BODY_NAMES = frozenset({"article-body", "article-content", "story-body", "entry-content", "post-content", "content-detail"})
LEAD_NAMES = frozenset({"lead", "brief", "sapo", "summary"})
BLOCKS = frozenset({"article", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "figure", "figcaption", "table", "tr", "br", "td", "th"})
CHALLENGES = ("captcha", "cf-challenge", "are you a robot", "enable javascript and cookies to continue")


class MarkupError(ValueError):
    """Markup that exceeds a limit or contradicts itself."""


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """This element and those below it, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def above(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def pieces(self, skip: frozenset[str] = frozenset({"script", "style", "noscript"})) -> Iterator[str]:
        stack: list[Node | str] = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            elif x.tag not in skip:
                stack.extend(reversed(x.children))

    def text(self) -> str:
        return " ".join("".join(self.pieces()).split())

    def names(self) -> set[str]:
        return {x.replace("_", "-") for x in f"{self.attrs.get('class', '')} {self.attrs.get('id', '')}".lower().split()}

    def path(self) -> str:
        """XPath-like place: element names, numbered where siblings share one."""
        parts = []
        node: Node | None = self
        while node is not None and node.parent is not None:
            same = [c for c in node.parent.children if isinstance(c, Node) and c.tag == node.tag]
            parts.append(node.tag + (f"[{same.index(node) + 1}]" if len(same) > 1 else ""))
            node = node.parent
        return "/" + "/".join(reversed(parts))


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None)
        self.at = self.root

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._imply(tag)
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def _imply(self, tag: str) -> None:
        """Ends the elements that the new one can't be inside."""
        node: Node | None = self.at
        while node is not None and node.tag:
            if tag in CLOSED_BY.get(node.tag, ()):
                self.at = node.parent or self.root
            elif node.tag in SCOPE:
                break
            node = node.parent

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent or self.root

    def handle_endtag(self, tag: str) -> None:
        for node in (self.at, *self.at.above()):
            if node.tag == tag:
                self.at = node.parent or self.root
                return

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(markup: str) -> Node:
    builder = _Builder()
    builder.feed(markup)
    builder.close()
    return builder.root


def _without(root: Node, bad: Callable[[Node], bool]) -> Node:
    for node in list(root.walk()):
        if node.parent is not None and bad(node):
            node.parent.children = [c for c in node.parent.children if c is not node]
    return root


def title(root: Node) -> str:
    return next((n.text() for n in root.walk() if n.tag == "title"), "")


def links(root: Node) -> list[dict]:
    """H5: anchors with a target, in order."""
    return [{"href": n.attrs["href"], "title": n.text(), "css": n.attrs.get("class", "")} for n in root.walk() if n.tag == "a" and n.attrs.get("href")]


def article_text(root: Node, known: str = "") -> str | None:
    """H1: the text of :func:`article_body`; null if there is none."""
    found = article_body(root, known)
    return None if found is None else "\n".join(block_lines(found))


def article_body(root: Node, known: str = "") -> Node | None:
    """H1: the best article element whose prose ``known`` doesn't hold already.  Noise elements leave the tree.

    An article has two paragraphs of 80 characters at least, 200 together, and
    a quarter of its text in links at most.
    """
    root = _without(root, lambda n: n.tag in NOISE or bool(n.names() & NOISE_NAMES))
    known = " ".join(known.split())
    best: tuple[int, int, Node] | None = None
    for n in root.walk():
        if not (n.tag == "article" or "articleBody" in n.attrs.get("itemprop", "").split() or n.names() & BODY_NAMES):
            continue
        prose = [t for t in (p.text() for p in n.walk() if p.tag == "p") if len(t) >= 80]
        size = sum(map(len, prose))
        whole = len(n.text())
        linked = sum(len(a.text()) for a in n.walk() if a.tag == "a")
        covered = sum(len(t) for t in prose if t in known)
        if len(prose) >= 2 and size >= 200 and 4 * linked <= whole and 2 * covered < size and (best is None or (size, whole) > best[:2]):
            best = (size, whole, n)
    return None if best is None else best[2]


def block_lines(node: Node) -> list[str]:
    """The element's text, one line for each block."""
    out: list[str] = []
    stack: list[Node | str] = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        edge = ["\n"] if x.tag in BLOCKS else []
        stack.extend([*edge, *reversed(x.children), *edge])
    return [line for line in (" ".join(s.split()) for s in "".join(out).split("\n")) if line]


def leads(root: Node, most: int = 3) -> list[dict]:
    """H2: lead blocks inside articles, 60 to 2000 characters, different ones, with their place."""
    found: dict[str, str] = {}
    for n in _without(root, lambda x: x.tag in ("script", "style", "noscript", "svg")).walk():
        if len(found) < most and n.attrs.get("class") and any(a.tag == "article" for a in n.above()):
            t = n.text()
            if set(re.split(r"[\s_-]+", n.attrs["class"].lower())) & LEAD_NAMES and 60 <= len(t) <= 2000:
                found.setdefault(t, n.path())
    return [{"text": t, "locator": p} for t, p in found.items()]


_LEAF = frozenset({"mi", "mn", "mo", "mtext"})
_SCRIPTS = {"msup": ("{0}^{{{1}}}", 2), "msub": ("{0}_{{{1}}}", 2), "msubsup": ("{0}_{{{1}}}^{{{2}}}", 3), "mfrac": ("({0})/({1})", 2), "mroot": ("root({0},{1})", 2)}
_JOINS = {"msqrt": ("sqrt(", "", ")"), "mtr": ("[", ", ", "]"), "mtable": ("", "; ", "")}


def _formula(node: Node, depth: int = 0) -> str:
    if depth > 24:
        raise MarkupError("formula is nested too deep")
    tag = node.tag.rsplit(":", 1)[-1]
    if tag in _LEAF:
        return node.text()
    parts = [c for c in node.children if isinstance(c, Node) and not c.tag.endswith("annotation-xml")]
    if tag == "semantics":
        return _formula(parts[0], depth + 1) if parts else ""
    if tag == "mspace":
        return " "
    values = [_formula(c, depth + 1) for c in parts]
    form, needs = _SCRIPTS.get(tag, ("", 1 << 30))
    if len(values) >= needs:
        return form.format(*values)
    before, between, behind = _JOINS.get(tag, ("", "", ""))
    return before + between.join(values) + behind


def _source(node: Node) -> str:
    inner = "".join(escape(c, quote=False) if isinstance(c, str) else _source(c) for c in node.children)
    attrs = "".join(f' {k}="{escape(v)}"' for k, v in node.attrs.items())
    return f"<{node.tag}{attrs}>{inner}</{node.tag}>"


def formulas(root: Node) -> list[dict]:
    """H3: outermost formulas as linear text, with place and markup."""
    found = [n for n in root.walk() if n.tag == "math" and not any(a.tag == "math" for a in n.above())]
    if len(found) > 300:
        raise MarkupError("more than 300 formulas")
    out = []
    for n in found:
        markup, text = _source(n), " ".join(_formula(n).split())
        if len(markup) > 8000 or not 1 <= len(text) <= 500:
            raise MarkupError("formula is too long or empty")
        out.append({"text": text, "locator": n.path(), "mathml": markup})
    return out


def place_cells(rows: list[list[tuple[int, int]]], groups: list[int]) -> tuple[list[tuple[int, int, int, int]], list[list[int | None]]]:
    """R2: grid of cells given as rows of ``(rowspan, colspan)``; ``groups`` is the row behind each row's group.

    Gives ``(row, column, rowspan, colspan)`` of each cell and the grid of
    cell numbers, null where no cell lies.  A rowspan of 0 reaches to the end
    of the group.  Overlaps and spans beyond the limits are errors.
    """
    taken: dict[tuple[int, int], int] = {}
    cells: list[tuple[int, int, int, int]] = []
    for r, row in enumerate(rows):
        c = 0
        for down, across in row:
            while (r, c) in taken:
                c += 1
            down = down or groups[r] - r
            if not (1 <= down <= 100 and 1 <= across <= 100 and c + across <= 100 and r + down <= len(rows)):
                raise MarkupError("span beyond the table or the limits")
            for y in range(r, r + down):
                for x in range(c, c + across):
                    if taken.setdefault((y, x), len(cells)) != len(cells):
                        raise MarkupError("cells overlap")
            cells.append((r, c, down, across))
            c += across
    width = 1 + max((x for _, x in taken), default=-1)
    return cells, [[taken.get((y, x)) for x in range(width)] for y in range(len(rows))]


def tables(root: Node) -> list[dict]:
    """H4: outermost tables outside navigation, with caption, section heading, cells and grid."""
    root = _without(root, lambda n: n.tag in ("script", "style", "noscript"))
    out, heading = [], ""
    wrapped = frozenset({"table", "nav", "footer", "aside"})
    for n in root.walk():
        if n.tag in ("h1", "h2", "h3"):
            heading = n.text()
        if n.tag != "table" or any(a.tag in wrapped for a in n.above()):
            continue
        if len(out) >= 100:
            raise MarkupError("more than 100 tables")
        trs: list[Node] = []
        groups: list[int] = []
        for child in n.children:
            if isinstance(child, Node) and child.tag in ("tr", "thead", "tbody", "tfoot"):
                own = [child] if child.tag == "tr" else [c for c in child.children if isinstance(c, Node) and c.tag == "tr"]
                trs += own
                groups += [len(trs)] * len(own) if child.tag != "tr" else [-1]
        groups = [len(trs) if g < 0 else g for g in groups]
        fields = [[c for c in tr.children if isinstance(c, Node) and c.tag in ("td", "th")] for tr in trs]
        if len(trs) > 1000 or sum(map(len, fields)) > 10_000:
            raise MarkupError("table is too large")
        try:
            spans = [[(int(c.attrs.get("rowspan") or 1), int(c.attrs.get("colspan") or 1)) for c in row] for row in fields]
        except ValueError:
            raise MarkupError("span isn't a number") from None
        cells, grid = place_cells(spans, groups)
        if not cells:
            continue
        flat = [c for row in fields for c in row]
        caption = next((c.text() for c in n.children if isinstance(c, Node) and c.tag == "caption"), "")
        out.append(
            {
                "caption": caption,
                "section": heading,
                "locator": n.path(),
                "cells": [{"row": r, "column": c, "text": f.text(), "rowspan": d, "colspan": a, "header": f.tag == "th", "locator": f.path()} for (r, c, d, a), f in zip(cells, flat, strict=True)],
                "grid": grid,
                "row_count": len(trs),
                "column_count": len(grid[0]) if grid else 0,
            }
        )
    return out


def missing_places(grid: Column) -> Column:
    """Positions without a cell, as ``array<struct<row,column>>``."""
    return F.flatten(F.transform(grid, lambda row, r: F.transform(F.filter(F.transform(row, lambda x, c: F.struct(r.alias("row"), c.alias("column"), x.isNull().alias("gone"))), lambda p: p["gone"]), lambda p: F.struct(p["row"].alias("row"), p["column"].alias("column")))))


def useful_table(tables_: Column) -> Column:
    """whether a table has two rows and two columns at least."""
    return F.coalesce(F.exists(tables_, lambda t: (t["row_count"] >= 2) & (t["column_count"] >= 2)), F.lit(False))


def challenge(html: Column) -> Column:
    """whether a page is a challenge and no content."""
    found = F.lit(False)
    for m in CHALLENGES:
        found = found | F.contains(F.lower(html), F.lit(m))
    return F.coalesce(found, F.lit(False))


_CELL = "struct<row:int,column:int,text:string,rowspan:int,colspan:int,header:boolean,locator:string>"
TABLE = f"struct<caption:string,section:string,locator:string,cells:array<{_CELL}>,grid:array<array<int>>,row_count:int,column_count:int>"


def _udf(kind: str, f: Callable[[Node], object]):  # noqa: ANN202
    @batched(kind)
    def run(html: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else f(parse(x)) for x in html], dtype=object)

    return run


def _guarded(f: Callable[[Node], list[dict]]) -> Callable[[Node], dict]:
    def run(root: Node) -> dict:
        try:
            return {"found": f(root), "error": None}
        except MarkupError as e:
            return {"found": [], "error": str(e)}

    return run


def closed_references(html: Column) -> Column:
    """Markup in which only character references that end in a semicolon count; the ampersands of others, cut ones for instance, stay as text."""
    return F.regexp_replace(html, r"&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)", "&amp;")


page_title = _udf("string", title)
page_links = _udf("array<struct<href:string,title:string,css:string>>", links)
page_article = _udf("string", article_text)
page_leads = _udf("array<struct<text:string,locator:string>>", leads)
page_formulas = _udf("struct<found:array<struct<text:string,locator:string,mathml:string>>,error:string>", _guarded(formulas))
page_tables = _udf(f"struct<found:array<{TABLE}>,error:string>", _guarded(tables))


@batched("string")
def page_text(html: pd.Series) -> pd.Series:
    """H7's place: all text outside noise elements, one line for each block."""
    return html.map(lambda x: "\n".join(block_lines(_without(parse(x), lambda n: n.tag in NOISE or n.tag in ("head", "title")))), na_action="ignore")


def search_results(html: Column) -> Column:
    """Result anchors of a search page, redirects unwrapped, as ``array<struct<url,title>>``."""
    hits = F.filter(page_links(html), lambda a: F.arrays_overlap(F.split(a["css"], " "), F.array(F.lit("result-link"), F.lit("result__a"))))
    return F.transform(hits, lambda a: F.struct(F.coalesce(F.try_url_decode(F.nullif(F.regexp_extract(a["href"], r"[?&]uddg=([^&]+)", 1), F.lit(""))), a["href"]).alias("url"), a["title"].alias("title")))


def assemble(text: Column, leads_: Column) -> Column:
    """H6: ``text`` after the leads that it doesn't hold."""
    new = F.filter(F.transform(leads_, lambda x: x["text"]), lambda t: ~F.contains(text, t))
    return F.array_join(F.concat(new, F.array(text)), "\n")
