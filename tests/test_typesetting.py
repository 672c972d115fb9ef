"""Wrap and pagination against plain loops."""

import random

import plain_typesetting as plain
import pytest
from pyspark.sql import functions as F

from quirefold.operators import typesetting as T


def test_wrap(spark, monkeypatch):
    monkeypatch.setattr(T, "RUN", 3)
    rng = random.Random(7)
    texts = [None, "", " \n　\n", "x", "甲乙丙丁戊", "  lead\n\n tail  ", "a\tb\x0bc\r\n", "𠀀𠀁é" * 9, "é" * 5, "wide 甲" * 40]
    texts += ["".join(rng.choice("ab 甲é\n𠀀") for _ in range(rng.randrange(200))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for first, full in ((200, 300), (100, 100), (10, 460), (460, 460)):
        got = {r.doc_id: r.l for r in rows.select("doc_id", T.wrap(F.col("text"), F.lit(first), F.lit(full)).alias("l")).collect()}
        assert got == {i: plain.wrap(t, first, full) for i, t in enumerate(texts)}


@pytest.mark.parametrize("scales, pages_a_segment", [((1.0, 1.0), 64), ((1.0, 1.0), 1), ((2.5, 3.0), 2), ((1.0, 7.2), 1)])
def test_pages(spark, monkeypatch, scales, pages_a_segment):
    """Long, short and empty documents; segments of one page; lines as high as a page."""
    monkeypatch.setattr(T, "PAGES_A_SEGMENT", pages_a_segment)
    monkeypatch.setattr(T, "RUN", 5)
    rng = random.Random(3)
    roles = [*T.STYLES, "Unknown", None]
    items = [("long", s, rng.choice(roles), "甲" * rng.randrange(400)) for s in range(1, 120)]
    items += [("short", 4, "Heading", "x"), ("empty", 1, "Body", None), ("empty", 9, "Image", "")]
    items += [(None, s, "Body", "word " * 60) for s in range(0, 90, 3)]
    rows = spark.createDataFrame(items, "doc string, seq long, role string, item string").withColumn("page", F.lit(0))
    got = sorted(((r.doc or "", r.page, r.seq, r.line_no, r.y, r.line) for r in T.paginated(rows, *scales).collect()))
    want = [((d or ""), *p) for d in ("long", "short", "empty", None) for p in plain.placed([(s, r or "", t) for x, s, r, t in items if x == d], *scales)]
    assert got == sorted(want)
    assert max(r[1] for r in got) > 3


def test_no_items(spark):
    none = spark.createDataFrame([], "doc long, seq long, role string, item string")
    found = T.paginated(none)
    assert found.columns == ["doc", "page", "seq", "line_no", "y", "line"] and found.count() == 0
