"""The composite HTML reader: main content, offsets, errors, charsets."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidra.functions import markup as M
from evidra.functions import reader as R

PROSE = "A sentence that is long enough to count as prose because it has over eighty characters here, and some more. "
LEAD = "The lead of this story is a text of sixty characters and of a few more."
MATH = "<math><msup><mi>a</mi><mn>2</mn></msup></math>"


def page(inner: str, around: str = "") -> str:
    return f"<html><head><title>T</title></head><body><div class=menu><a href=a>{PROSE}</a></div>{around}<div id=main>{inner}</div></body></html>"


def test_main_content_leaves_links_and_asides():
    found = R.read(page(f"<h2>Head</h2><p>{PROSE}<p>{PROSE}<div class=related>{PROSE * 3}</div>", f"<div>{PROSE[:60]}</div>"))
    assert found["error"] is None and found["title"] == "T"
    assert found["text"] == "\n".join(["Head", PROSE.strip(), PROSE.strip()])


def test_every_offset_cuts_out_its_own_string():
    table = "<table><tr><th>Year<th>Rain</tr><tr><td>2020<td>1 <b>mm</b></tr></table>"
    html = page(f"<article><aside class=lead>{LEAD}</aside><h1>One 🌧 head</h1><p>Of {MATH} and<br>{PROSE}</p><p class=sapo>Second: {LEAD[4:]}</p>{table}</article>", f"<footer>{MATH.replace('>a<', '>z<')}</footer>")
    d = R.read(html)
    text, tree = d["text"], M.parse(html)
    nodes = {n.path(): n for n in tree.walk()}
    assert text.startswith(LEAD + "\n\nOne 🌧 head\nOf a^{2} and\n")
    assert text.endswith("z^{2} [/html/body/footer/math]\n") and R.SUPPLEMENT in text
    assert [(x["text"], text[x["start"] : x["end"]]) for x in d["leads"]] == [(LEAD, LEAD), ("Second: " + LEAD[4:],) * 2]
    assert [text[x["start"] : x["end"]] for x in d["formulas"]] == ["z^{2}", "a^{2}"] == [x["text"] for x in d["formulas"]]
    cells = [s for s in d["spans"] if s["kind"] in ("cell", "heading")]
    assert len(cells) == 5
    assert all(text[s["start"] : s["end"]] == nodes[s["locator"]].text() for s in cells)
    assert {c["locator"] for t in d["tables"] for c in t["cells"]} == {s["locator"] for s in cells if s["kind"] == "cell"}


def test_places_are_those_of_the_page():
    d = R.read(page(f"<p>{PROSE}<p>{PROSE}<form><h2>gone</h2></form><section><h2>stays</h2></section>", "<form><p>x</p></form>"))
    assert [(s["kind"], s["locator"]) for s in d["spans"]] == [("heading", "/html/body/div[2]/section/h2")]


@pytest.mark.parametrize(
    ("html", "error"),
    [
        ("<p>Please verify you are HUMAN</p>" + PROSE * 3, "challenge page"),
        ("", "no content"),
        ("<nav>" + PROSE * 3 + "</nav>", "no content"),
        ("<p>short</p>", "content is too short"),
        ("<p>" + "a" * 600_001 + "</p>", "text is too long"),
        ("<p>" + PROSE * 3 + "<math></math>", "formula is too long or empty"),
        ("<p>" + PROSE * 3 + "<table><tr><td rowspan=7>x</table>", "span beyond the table or the limits"),
    ],
)
def test_errors(html, error):
    assert R.read(html)["error"] == error


def test_a_useful_table_makes_up_for_little_text():
    d = R.read("<p>short</p><table><caption>Cap</caption><tr><th>a<th>b<tr><td>1<td>2</table>")
    assert d["error"] is None and "short" in d["text"] and d["tables"][0]["row_count"] == 2
    hidden = R.read("<table><tr class=share><th>a<th>b<tr class=share><td>1<td>2</table>")
    assert hidden["text"] == "\na\nb\n1\n2"


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=20), st.lists(st.tuples(st.integers(0, 20), st.integers(1, 3)), max_size=4), st.tuples(st.integers(0, 20), st.integers(0, 20)))
def test_rebase_keeps_what_a_span_cuts(text, inserted, span):
    inserted = sorted((min(p, len(text)), n) for p, n in inserted)
    start, end = sorted(min(x, len(text)) for x in span)
    out, at = "", 0
    for p, n in inserted:
        out += text[at:p] + "#" * n
        at = p
    out += text[at:]
    ((s, e),) = R.rebase([(start, end)], inserted)
    assert out[s:e].replace("#", "") == text[start:end]
    assert start == end or "#" not in (out[s], out[e - 1])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", " b ", "<p>", "</p>", "<b>", "</b>", "<br>", "<div>", "</div>", "<td>", "\n", "&amp;"]), max_size=30))
def test_lines_are_those_of_the_block_writer(parts):
    tree = M.parse("".join(parts))
    lines = R.Lines()
    R.write(tree, lines, {}, set())
    assert lines.text() == "\n".join(M.block_lines(tree))


def test_charsets(spark):
    html = f"<meta charset=windows-1252><p>{PROSE}{PROSE}é</p>"
    rows = [
        (1, html.encode("cp1252"), "text/html"),
        (2, html.encode("utf-8"), "text/html; charset=utf-8"),
        (3, "﻿".encode() + html.encode(), "text/html"),
        (4, html.encode("utf-16"), None),
        (5, html.encode(), "text/html; charset=no-such"),
        (6, None, "text/html"),
        (7, html.encode("cp1252"), "text/html; charset=utf-8"),
    ]
    df = spark.createDataFrame(rows, "id int, body binary, declared string")
    got = {r["id"]: r["d"] for r in df.select("id", R.html_document("body", "declared").alias("d")).collect()}
    assert [got[k]["text"][-1] for k in (1, 2, 3, 4)] == ["é"] * 4 and got[7]["text"][-1] == "�"
    assert got[5]["error"] == "unknown charset" and got[6] is None
    assert df.where("false").select(F.length(R.html_document("body", "declared")["text"])).count() == 0


def compared(spark, folder, name, pages):
    """Rows of a query over these pages, and those of its SQL."""
    import duckdb

    import __spark_entry__ as entry

    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
        expected = con.sql(entry.oracle_sql()[name]).fetchall()
    return sorted(map(tuple, entry.queries()[name](spark, str(folder)).collect())), sorted(expected)


def test_offsets_of_a_short_page(spark, tmp_path):
    html = "<html><head><title>Éaux.</title></head><body><div class=\"ad\">No.</div><article><h1>Éaux.</h1></article><footer>f</footer></body></html>"
    got, expected = compared(spark, tmp_path, "html_offsets", [(7, html)])
    assert len(got) == 5 and got == expected
    assert R.read(html)["error"] == "content is too short"


def test_titles_with_cut_references(spark, tmp_path):
    titles = ["a &amp;&amp", "b &am", "c &lt;&quot", "d &amp;lt; &", "e &#x27;&#x2", "f &#x27", "g &amp;amp"]
    got, expected = compared(spark, tmp_path, "page_title", [(i, f"<title>{t}</title><p>x</p>") for i, t in enumerate(titles)])
    assert got == expected and got[0] == (0, "a &&amp")
