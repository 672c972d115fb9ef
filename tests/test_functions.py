"""Golden rows of the column functions."""

import pytest
from pyspark.sql import functions as F

from quirefold.functions import layout as L
from quirefold.functions import net as N
from quirefold.functions import pages as G
from quirefold.functions import text as X


def one(spark, column, **values):
    names = list(values) or ["x"]
    df = spark.createDataFrame([tuple(values.values()) or (0,)], ", ".join(f"{n} {'long' if isinstance(values.get(n, 0), int) else 'double' if isinstance(values.get(n), float) else 'string'}" for n in names))
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text, want", [("#### 颜序", "颜序"), ("# 新聞學", "新聞學"), ("**重点**", "重点"), ("a\r\n> b", "a\nb"), ("***", "*"), ("****", ""), ("", "")])
def test_clean_block_text(spark, text, want):
    assert one(spark, X.clean_block_text(F.col("t")), t=text) == want


@pytest.mark.parametrize("text, want", [("新聞\n\n之\n\n採\n\n集", "新聞之採集"), ("第一章\n\n新聞學之性質與重要", "第一章\n\n新聞學之性質與重要"), ("甲", "甲")])
def test_repair_short_lines(spark, text, want):
    assert one(spark, X.repair_short_lines(F.col("t")), t=text) == want


def test_html(spark):
    table = "<table><tr><td>A&nbsp;1</td><td>B&amp;2</td></tr><tr><td>C</td><td>D</td></tr></table>"
    assert one(spark, X.html_table_text(F.col("t")), t=table) == "A 1 | B&2\nC | D"
    assert one(spark, X.strip_html(F.col("t")), t="a <b <c> d> e　f> g") == "a e f g"
    assert one(spark, X.decode_entities(F.col("t")), t="&amp;lt;") == "<"
    assert one(spark, X.img_src(F.col("t")), t='<div><img src="imgs/photo.jpg" /></div>') == "imgs/photo.jpg"


def test_image_placeholder(spark):
    url = "https://example.test/assets/input_img_0.jpg?authorization=secret"
    assert one(spark, X.image_placeholder(F.col("t")), t=url) == "[image: not embedded: input_img_0.jpg]"
    assert one(spark, X.image_placeholder(F.col("t")), t=" ") == "[image: not embedded]"
    assert len(one(spark, X.shown_reference(F.col("t")), t="x" * 90)) == 80


@pytest.mark.parametrize("text, want", [("[1]", "[1]"), ("```json\n[1]\n```", "[1]"), ("so: [1] and [2].", "[1] and [2]"), ("none", None), ("] [", None)])
def test_json_array(spark, text, want):
    assert one(spark, X.json_array_in(F.col("t")), t=text) == want


@pytest.mark.parametrize("text, needle, want", [("哈哈哈", "哈哈", False), ("abcab", "ca", True), ("abc", "x", False)])
def test_occurs_once(spark, text, needle, want):
    assert one(spark, X.occurs_once(F.col("n"), F.col("t")), t=text, n=needle) is want


@pytest.mark.parametrize(
    "label, want",
    [("doc_title", "DocTitle"), ("paragraph_title", "Heading"), ("vertical_text", "Body"), ("number", "PageNumber"), ("header_image", "Header"), ("vision_footnote", "Footnote"), ("table", "Table"), (" Table_Title ", "FigureCaption"), ("figure", "Image")],
)
def test_roles(spark, label, want):
    assert one(spark, L.role(F.col("t")), t=label) == want


@pytest.mark.parametrize(
    "raw, total, pages, error",
    [("   ", 4, [1, 2, 3, 4], None), ("8-10, 1-5, 10, 6, 12", 20, [1, 2, 3, 4, 5, 6, 8, 9, 10, 12], None), ("0,1", 10, None, "zero"), ("9-3", 10, None, "reversed"), ("1-11", 10, None, "exceeds"), ("1;2", 10, None, "charset"), ("1,,2", 10, None, "emptySegment"), ("-3", 10, None, "negative"), ("1-2-3", 10, None, "format")],
)
def test_page_ranges(spark, raw, total, pages, error):
    assert one(spark, G.range_pages(F.col("r"), F.col("n")), r=raw, n=total) == pages
    assert one(spark, G.range_error(F.col("r"), F.col("n")), r=raw, n=total) == error


@pytest.mark.parametrize("size, n, target, most, want", [(10 * 1024, 10, 4 * 1024, 3, 3), (20 << 20, 10, 4 << 20, 100, 2), (0, 0, 1024, 2, 2), (100 << 20, 10, 1024, 100, 1)])
def test_chunk_size(spark, size, n, target, most, want):
    assert one(spark, G.chunk_size(F.col("s"), F.col("n"), target, most), s=size, n=n) == want


@pytest.mark.parametrize(
    "url, want",
    [("https://api.example.org/v1", "ok"), ("ftp://a.example.org", "scheme"), ("https://k@a.example.org", "userinfo"), ("http://a.example.org", "https"), ("https://localhost/", "internal"), ("https://10.0.0.1", "internal"), ("https://100.64.1.1", "internal"), ("https://[::1]/", "internal"), ("https://[::ffff:10.0.0.1]/", "internal"), ("https://8.8.8.8", "ok"), ("nonsense", "invalid"), ("https://ollama:11434", "internal")],
)
def test_url_guard(spark, url, want):
    assert one(spark, N.url_verdict(F.col("u")), u=url) == want
    assert one(spark, N.url_verdict(F.lit("http://ollama:11434/x"), allowed=("ollama:11434",))) == "ok"


def test_canvas_mapping(spark):
    at = lambda approx, h: one(spark, L.canvas_mapping(F.lit(1000.0), F.lit(1500.0), F.lit(2000.0), F.lit(h), F.lit(approx)))
    assert tuple(at(False, 3000.0)) == (2.0, 2.0)
    assert at(False, 3300.0) is None
    assert tuple(at(True, 3300.0)) == (2.0, 2.0)
    assert at(False, 0.0) is None
