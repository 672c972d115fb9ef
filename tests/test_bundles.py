"""Layout files in bundles: few files, the same pages, lines that stand behind their file's name."""

import os

import pytest
from pyspark.sql import functions as F

from quirefold.plans import imports
from quirefold.sources import layout_json as J
from quirefold.sources.shared import new_path

SF = "/root/testdata/sf0.001"


def test_queries_import_few_files(spark, monkeypatch):
    """The queries' own bundles hold what the folder of a file for each volume does; the folder is not made."""
    page = ["doc_id", "page", F.to_json("v").alias("v"), "i", F.to_json("info").alias("info"), F.to_json("settings").alias("settings")]
    rows = lambda df: sorted(map(str, imports._by_volume(df.select(*page)).collect()))
    want = rows(J.read_json(spark, imports.written(spark, SF)))

    def no_folder(*_):
        raise AssertionError("a file for each volume")

    monkeypatch.setattr(imports, "written", no_folder)
    assert rows(imports._imported(spark, SF)[0]) == want and len(want) == 200


def test_bundles_are_as_many_as_tasks(spark):
    at = new_path(spark, "bundles")
    files = spark.range(1, 301).select(F.format_string("f%d.json", "id").alias("name"), F.lit(0).alias("seq"), F.format_string('[\n{"pageSize":[%d,7]}\r\n,{"pageSize":[0.5,2]}\r]', "id").alias("value"))
    J.bundle(files, at)
    assert sum(name.startswith("part-") for name in os.listdir(at.removeprefix("file:"))) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    pages = J.read_json(spark, at, bundled=True)
    found = {(r.doc_id, r.page): r.w for r in pages.select("doc_id", "page", J.page_size(F.col("v"), F.col("info"), F.col("i"))["w"].alias("w")).collect()}
    assert found == {(f"f{i}.json", page): w for i in range(1, 301) for page, w in ((1, float(i)), (2, 0.5))}


@pytest.mark.parametrize("text, named", [('[{"page_width":1}]', "without a file's name"), ("x.json\t[1", "x.json"), ("x.json\t", "x.json")])
def test_bundles_that_fail(spark, tmp_path, text, named):
    (tmp_path / "b.txt").write_text(text + "\n")
    with pytest.raises(Exception, match=named):
        J.read_json(spark, str(tmp_path), bundled=True).collect()
