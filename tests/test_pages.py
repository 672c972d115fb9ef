"""Edited pages, errors, removed files."""

import json

from pyspark.sql import functions as F

from quirefold.functions import net
from quirefold.operators import editing, validation


def test_errors(spark):
    forms = [
        ({"kind": "Ocr", "data": {"message": "m", "retryable": True, "provider": "p"}}, ("Ocr", "m", True, "p")),
        ({"kind": "Ocr", "data": {"message": "m"}}, ("Ocr", "m", False, None)),
        ({"kind": "Ocr", "data": {"message": "m", "retryable": 1}}, ("Ocr", "m", True, None)),
        ({"kind": "Ocr", "data": {"message": "m", "retryable": None}}, ("Ocr", "m", False, None)),
        ({"kind": "Ocr", "data": "plain"}, ("Ocr", "plain", False, None)),
        ({"kind": "Network", "data": "down"}, ("Network", "down", True, None)),
        ({"kind": "Config", "data": "bad"}, ("Config", "bad", False, None)),
        ("text", ("Internal", "text", False, None)),
    ]
    rows = [(i, json.dumps(v)) for i, (v, _) in enumerate(forms)] + [(90, "no json"), (91, '{"kind": 5, "data": "x"}'), (92, None), (93, "")]
    got = {r.i: tuple(r.e) for r in spark.createDataFrame(rows, "i int, p string").select("i", net.parsed_error(F.col("p")).alias("e")).collect()}
    assert {i: got[i] for i in range(len(forms))} == {i: want for i, (_, want) in enumerate(forms)}
    assert [got[i] for i in (90, 91, 92, 93)] == [("Internal", "no json", False, None), ("Internal", '{"kind": 5, "data": "x"}', False, None), ("Internal", None, False, None), ("Internal", "", False, None)]


def test_edited_pages(spark):
    pages = spark.createDataFrame([(1, 10, 20, "new", True), (2, 10, 20, " \n", True), (3, 10, 20, "kept", False), (4, None, None, "x", True), (5, 10, 20, None, True), (6, 10, 20, "x", None)], "page long, width long, height long, text string, edited boolean")
    blocks = spark.createDataFrame([(p, 0, "header", f"old {p}", 1.0, 2.0, 3.0, 4.0, 7) for p in range(1, 8)], "page long, pos long, label string, text string, x0 double, y0 double, x1 double, y1 double, ord int")
    got = {r.page: tuple(r)[1:] for r in editing.edited_layout(pages, blocks, ["page"]).collect()}
    old = lambda p: (0, "header", f"old {p}", 1.0, 2.0, 3.0, 4.0, 7)
    assert got == {1: (0, "text", "new", 0.0, 0.0, 10.0, 20.0, 1), 3: old(3), 6: old(6)}


def test_removed_files(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "file string, n int")
    left = editing.cascade({"x": (rows, "file"), "y": (rows.withColumnRenamed("file", "of"), "of")}, spark.createDataFrame([("a",), ("a",), ("z",)], "gone string"), "gone")
    assert {k: sorted(r.n for r in df.collect()) for k, df in left.items()} == {"x": [2, 3], "y": [2, 3]}
    assert left["y"].columns == ["of", "n"]


def test_endpoints(spark):
    urls = [("a", ""), ("b", None), ("c", "https://api.example.org/v1"), ("d", "http://api.example.org"), ("e", "https://127.0.0.1/"), ("f", "ftp://x.example.org")]
    own = spark.createDataFrame([(j, "openai_compatible", "m", "p", u) for j, u in urls] + [("g", "openai", "m", "p", "")], "job string, provider string, model string, prompt string, base_url string")
    units = own.select("job", F.lit("page:1").alias("key"), F.lit("t").alias("text"))
    none = spark.createDataFrame([], "job string, data string")
    got = {r.job: r.fault for r in validation.proofread_faults(own, units, none).collect()}
    assert got == {"a": "no endpoint", "b": "no endpoint", "c": None, "d": "endpoint", "e": "endpoint", "f": "endpoint", "g": None}
