"""Layout JSON: files larger than a split, files that are neither JSON nor lines, odd values."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from quirefold.plans import imports
from quirefold.plans.registry import ORACLES
from quirefold.sources import layout_json as J

SF = "/root/testdata/sf0.001"


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_files_larger_than_a_split(spark, small_splits):
    at = imports.written(spark, SF)
    text = spark.read.text(at).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    assert text.distinct().groupBy("f").count().agg(F.max("count")).first()[0] > 3
    pages = J.read_json(spark, at)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    for name, got in (("json_sizes", J.sizes(pages, J.blocks(pages))), ("json_texts", J.page_texts(pages, J.blocks(pages)))):
        want = con.sql(ORACLES[name])
        cols = list(want.columns)
        assert sorted(map(str, (tuple(r[c] for c in cols) for r in imports._by_volume(got).collect()))) == sorted(map(str, want.fetchall()))


def test_lines_are_pages_in_their_order(spark, tmp_path, small_splits):
    many = [{"parsing_res_list": [{"block_label": "text", "block_content": f"{i} " + "x" * (i * 37 % 700)}]} for i in range(300)]
    (tmp_path / "a.jsonl").write_text("\n\n".join(map(json.dumps, many)) + "\n")
    (tmp_path / "b.json").write_text(json.dumps(many, indent=1))
    pages = J.read_json(spark, str(tmp_path))
    texts = {(r.doc_id.rpartition("/")[2], r.page): int(r.text.split()[0]) for r in J.page_texts(pages, J.blocks(pages)).collect()}
    assert texts == {(name, i + 1): i for name in ("a.jsonl", "b.json") for i in range(300)}


def test_lines_keep_their_envelopes_unless_unwrapped(spark, tmp_path):
    page = lambda t: {"prunedResult": {"parsing_res_list": [{"block_label": "text", "block_content": t}]}, "markdown": {"text": f"md {t}"}}
    rows = [{"result": {"layoutParsingResults": [page("a"), page("b")]}}, {"result": {"layoutParsingResults": [page("c")], "dataInfo": {"width": 5, "height": 6}}}, {"pages": []}]
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, rows)))
    closed, opened = J.read_json(spark, str(tmp_path)), J.read_json(spark, str(tmp_path), unwrap=True)
    found = J.blocks(closed)
    # Items of a line are blocks: what they hold under prunedResult is lost, their Markdown isn't.
    assert sorted((r.page, r.label, r.text) for r in found.collect()) == [(1, "text", "md a"), (1, "text", "md b"), (2, "text", "md c")]
    assert {r.page: r.text for r in J.page_texts(closed, found).collect()} == {1: "md a\n\nmd b", 2: "md c", 3: ""}
    assert {r.page: (r.page_w, r.approximate) for r in J.sizes(closed, found).collect()} == {1: (6.0, True), 2: (5.0, False), 3: (6.0, True)}  # no extent counts as lying on its side
    assert {r.page: r.text for r in J.page_texts(opened, J.blocks(opened)).collect()} == {1: "md a", 2: "md b", 3: "md c"}


@pytest.mark.parametrize("text", ["", " \n\t\n", '{"pages": []}\nno json', "[1, 2", '{"a": 1}', "no\njson"])
def test_files_that_fail_by_name(spark, tmp_path, text):
    (tmp_path / "odd.json").write_text(text)
    with pytest.raises(Exception, match="odd.json"):
        J.read_json(spark, str(tmp_path)).collect()


def test_odd_values(spark, tmp_path):
    block = lambda **k: {"block_label": "x", **k}
    odd = [block(block_order=n) for n in (0, -1, 2.0, "2", None, 4294967295, 4294967296)]
    odd += [block(block_bbox=b) for b in ([1, 2, 3], [1, 2, 3, "4"], {"x0": None, "x_min": 1, "y0": 1, "x1": 1, "y1": 1}, [1.5, 2, 3, 4], None)]
    odd += [block(block_polygon_points=p) for p in ([], [[1, 2], [3]], [[1, 2], [3, "4"]], [1, 2, 3], [1, 2, 3, 4.5], [[1, 2]])]
    odd += ["no object", 5, None, {}, {"block_label": " "}, {"block_content": "t", "block_bbox": [0, 0, 0, 0]}]
    (tmp_path / "o.json").write_text(json.dumps({"pages": [{"parsing_res_list": odd}, 7, None, {"prunedResult": {"parsing_res_list": None}, "parsing_res_list": [block()]}]}))
    pages = J.read_json(spark, str(tmp_path))
    rows = [r for r in J.blocks(pages).collect() if r.page == 1]
    assert sorted(r.ord for r in rows if r.ord is not None) == [0, 4294967295]
    assert sorted([r.x0, r.y0, r.x1, r.y1] for r in rows)[-1] == [1.5, 2, 3, 4] and sum(r.x1 > 0 for r in rows) == 1
    assert sorted([(p.x, p.y) for p in r.polygon] for r in rows if r.polygon) == [[(1, 2)], [(1, 2), (3, 4.5)]]
    assert sorted(r.label for r in rows)[:2] == ["", " "] and len(rows) == 7 + 5 + 6 + 2
    assert J.blocks(pages).filter("page > 1").count() == 0 and J.sizes(pages, J.blocks(pages)).count() == 4
    report = J.preflight(pages, J.blocks(pages)).first()
    assert report.pages == 4 and report.estimated_pages == [1, 2, 3, 4] and report.warnings == ["estimated_sizes"] and report.label_counts[""] == 1
