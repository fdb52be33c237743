"""Text, URL, vector and markup functions."""

from __future__ import annotations

import math
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidra.functions import markup as M
from evidra.functions import text as T
from evidra.functions import urls as U
from evidra.functions import vectors as V
from evidra.operators import chunks as C
from evidra.plans.text_plans import redact_text


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def one(spark, column, text):
    return values(spark, column, [(text,)], "x string")[0]


def test_fold_equals_decomposition(spark):
    texts = ["Dân số Việt Nam ĐẾN năm", "ÀÉÎõü ß ñ", "ﬁ ①", "Ελλάδα ёй", "á \n b", ""]

    def plain(x):
        return "".join(c for c in unicodedata.normalize("NFD", x.lower().replace("đ", "d")) if unicodedata.category(c) != "Mn")

    rows = [(t,) for t in texts]
    assert values(spark, T.fold(F.col("x")), rows, "x string") == [plain(t) for t in texts]
    assert values(spark, T.fold_exact(F.col("x")), rows, "x string") == [plain(t) for t in texts]
    assert one(spark, T.fold_exact(F.col("x")), None) is None
    assert one(spark, T.fold_compat(F.col("x")), " ﬁ   ① Đ ") == "fi 1 d"


def test_terms_and_years(spark):
    assert one(spark, T.query_terms(F.col("x")), "a_b c c") == ["a_b", "c", "c"]
    assert one(spark, T.query_terms(F.col("x"), 24, distinct=True), "c a c") == ["c", "a"]
    assert len(one(spark, T.query_terms(F.col("x")), "w " * 50)) == 40
    assert one(spark, T.plan_terms(F.col("x")), "thu thap so lieu dan so viet nam dan") == ["dan", "viet"]
    assert one(spark, T.years(F.col("x")), "2020, 1999-2020 and 12020 or 2100x 1800") == [1999, 2020]


@pytest.mark.parametrize(("text", "score"), [("drug offences", 10), ("doanh nghiep viet nam", 0), ("crime only", 5), ("", 0)])
def test_concept_score(spark, text, score):
    assert one(spark, T.concept_score(F.col("x"), [["toi pham", "crime", "offences"], ["ma tuy", "drug"]]), text) == score


def test_concept_score_rounds_half_to_even(spark):
    groups = [["a1"], ["b1"], ["c1"], ["d1"]]
    assert one(spark, T.concept_score(F.col("x"), groups), "a1") == 2
    assert one(spark, T.concept_score(F.col("x"), groups), "a1 b1 c1") == 8


def test_relevance_and_detection(spark):
    text = "dan so viet nam 2020"
    assert one(spark, T.relevance(F.col("x"), "population", "VN", ["dan", "viet", "xyz"]), text) == 9
    assert one(spark, T.first_key(F.col("x"), T.TOPICS), text) == "population"
    assert one(spark, T.first_key(F.col("x"), T.COUNTRIES), "nowhere") is None


def test_redaction_of_whole_texts(spark, tmp_path):
    """Secrets far behind the 40th character are masked, and what follows them stays up to the result's limit."""
    far = "x " * 300
    rows = [(1, 0, "hello"), (1, 1, far + "password: p4ss, then api_key=K9 end"), (2, 0, far + "y" * 2000), (2, 1, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): r.masked for r in redact_text(spark, str(tmp_path)).collect()}
    begin = "token=[MASKED] Bearer [MASKED] said "
    assert got == {(1, 0): begin + "hello", (1, 1): begin + far + "password: [MASKED], then api_key=[MASKED] end", (2, 0): (begin + far + "y" * 2000)[:1200], (2, 1): None}


def test_redaction_and_dates(spark):
    assert one(spark, T.redact_secrets(F.col("x"), ("s3cret",)), "Bearer abc; key s3cret password: p1, ok") == "Bearer [MASKED]; key [MASKED] password: [MASKED], ok"
    assert len(one(spark, T.redact_secrets(F.col("x")), "a" * 2000)) == 1200
    for bad in ("20260101", "2026-W01-1", "2026-1-1", "2026-02-30", ""):
        assert one(spark, T.canonical_date(F.col("x")), bad) is None
    assert str(one(spark, T.canonical_date(F.col("x")), "2026-02-28")) == "2026-02-28"
    assert one(spark, T.normalise_relative_date(F.col("x"), 2026), "từ 2016 đến nay") == "từ 2016 đến năm 2026"


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://example.com/data?locations=VN&date=2024&utm_source=x#top", "https://example.com/data?date=2024&locations=VN"),
        ("HTTPS://EXAMPLE.com", "https://example.com/"),
        ("https://e.org/a?b=&amp;FBCLID=1&a=2", "https://e.org/a?a=2&b="),
        ("file:///etc/passwd", None),
        ("javascript:alert(1)", None),
        ("https://u:p@e.org/", None),
        (None, None),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, U.canonical_url("x"), url) == want


@pytest.mark.parametrize(("url", "score"), [("https://data.worldbank.org/x", 4), ("https://worldbank.org.evil.example", 0), ("https://fakegov.vn", 0), ("https://www.gso.gov.vn", 4), ("https://who.int", 3), ("nonsense", 0)])
def test_source_priority(spark, url, score):
    assert one(spark, U.source_priority(F.col("x")), url) == score


def test_url_gates(spark):
    ok = U.public_url(F.col("x"))
    assert [one(spark, ok, u) for u in ("https://a.org/", "http://a.org:80/x", "https://a.org:9000/", "https://u@a.org/", "ftp://a.org/", "x")] == [True, True, False, False, False, False]
    api = U.allowed_api_url(F.col("x"), ("api.worldbank.org",))
    assert [one(spark, api, u) for u in ("https://api.worldbank.org/v2/c", "http://api.worldbank.org/v2/c", "https://api.worldbank.org/v1/c", "https://x.org/v2/")] == [True, False, False, False]
    assert one(spark, U.indicator_id(F.col("x")), "https://data.worldbank.org/indicator/SP.POP.TOTL?locations=VN") == "SP.POP.TOTL"
    assert one(spark, U.safe_url("x"), "https://e.org/a?k=1&api_key=zz") == "https://e.org/a?k=1&api_key=%5BMASKED%5D"


@pytest.mark.parametrize("bad", [[0.0, 0.0], [math.nan, 1.0], [1.0], [math.inf, 1.0], [1e308, 1e308], None, [None, 1.0]])
def test_invalid_vectors(spark, bad):
    assert values(spark, V.valid_vector(F.col("v"), 2), [(bad,)], "v array<double>") == [False]


def test_cosine(spark):
    got = values(spark, V.cosine(F.col("v"), F.array(F.lit(1.0), F.lit(1.0))), [([1.0, 0.0],)], "v array<double>")[0]
    assert got == pytest.approx(1 / math.sqrt(2))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n🌧️ế", max_size=200), st.integers(1, 30), st.sampled_from([C.characters, C.word_pieces]))
def test_spans_cover_and_fit(text, limit, count):
    spans = C.split(text, limit, count)
    assert "".join(text[a:b] for a, b in spans) == text
    assert all(count(text[a:b]) <= limit for a, b in spans)


def test_spans_prefer_newline():
    assert C.split("abcdef\nghij", 10) == [(0, 7), (7, 11)]
    assert C.split("a\nbcdefghij", 10) == [(0, 10), (10, 11)]


def test_article_and_links():
    prose = "A sentence that is long enough to count as prose because it has over eighty characters here, and some more. "
    page = f"<html><head><title> T &amp; x </title></head><body><nav><p>{prose}</p></nav><article><p>{prose}A<p>{prose}B<sup>2</sup></p><div class=related>{prose}</div></article></body></html>"
    text = M.article_text(M.parse(page))
    assert text.count("A sentence") == 2 and "B2" in text
    assert M.title(M.parse(page)) == "T & x"
    assert M.article_text(M.parse(page), known=prose + "A " + prose + "B2") is None
    linked = f"<article><p><a href=x>{prose}</a></p><p><a href=y>{prose}{prose}</a></p></article>"
    assert M.article_text(M.parse(linked)) is None
    assert [x["href"] for x in M.links(M.parse(linked))] == ["x", "y"]


def test_tables():
    page = "<table><tr><th rowspan=2>Y<th colspan=2>R</tr><tr><td>1<td>2</tr><tr><td>100.987.686<td>b<td></tr></table><nav><table><tr><td>no</table></nav>"
    found = M.tables(M.parse(page))
    assert len(found) == 1
    assert found[0]["grid"] == [[0, 1, 1], [0, 2, 3], [4, 5, 6]]
    assert found[0]["cells"][4]["text"] == "100.987.686" and found[0]["cells"][6]["text"] == ""
    assert found[0]["cells"][5]["locator"] == "/table/tr[3]/td[2]"


@pytest.mark.parametrize("cell", ["<td rowspan=x>", "<td rowspan=9>", "<td colspan=101>", "<td colspan=-1>"])
def test_bad_spans(cell):
    with pytest.raises(M.MarkupError):
        M.tables(M.parse(f"<table><tr>{cell}a</td></tr></table>"))


def test_overlapping_cells():
    with pytest.raises(M.MarkupError):
        M.place_cells([[(1, 1), (2, 1)], [(1, 2)]], [2, 2])
    cells, grid = M.place_cells([[(0, 1), (1, 1)], [(1, 1)]], [2, 2])
    assert grid == [[0, 1], [0, 2]]
    assert M.place_cells([[(1, 1)], []], [2, 2])[1] == [[0], [None]]


def test_formulas():
    page = "<p><math><msup><mi>a</mi><mn>2</mn></msup><mo>+</mo><msup><mi>b</mi><mn>2</mn></msup><mo>=</mo><msup><mi>c</mi><mn>2</mn></msup></math></p>"
    assert M.formulas(M.parse(page))[0]["text"] == "a^{2}+b^{2}=c^{2}"
    with pytest.raises(M.MarkupError):
        M.formulas(M.parse("<math>" + "<mrow>" * 30 + "<mi>x</mi>" + "</mrow>" * 30 + "</math>"))
    with pytest.raises(M.MarkupError):
        M.formulas(M.parse("<math></math>"))


def test_batches_are_bounded(spark):
    from evidra.functions import udf
    from evidra.session import BATCH_BYTES, ship

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        spark.conf.unset(key)
        assert ship(spark).conf.get(key) == str(BATCH_BYTES)
        spark.conf.set(key, "1234567")
        assert ship(spark).conf.get(key) == "1234567"
    finally:
        spark.conf.unset(key)
    seen = udf.batched("int")(lambda x: x * 0 + len(x))
    most = spark.range(0, 1000, 1, 1).select(seen("id").alias("n")).groupBy("n").count().collect()
    assert {r.n: r["count"] for r in most} == {256: 768, 232: 232}
