"""Pages of documents of bounded height in one pass, and whitespace that no pattern has to look for."""

import random

import plain_typesetting as plain
import pytest
from pyspark.sql import functions as F

from quirefold.functions import text as X
from quirefold.operators import typesetting as T


@pytest.mark.parametrize("at_once, batch", [(1, 1), (7, 3), (1 << 18, 10000)])
def test_documents_are_placed_in_one_pass(spark, monkeypatch, at_once, batch):
    """No rounds of joins by pointers; documents that go on over batches and parts of batches."""

    def no_rounds(*_):
        raise AssertionError("rounds over lines")

    monkeypatch.setattr(T, "page_starts", no_rounds)
    monkeypatch.setattr(T, "LINES", at_once)
    rng = random.Random(5)
    items = [(d, s * 3, rng.choice([*T.STYLES, None]), "甲" * rng.choice([0, 30, 300, 3000])) for d in ("a", "b", "c", None) for s in range(rng.randrange(1, 30))]
    rows = spark.createDataFrame(items, "doc string, seq long, role string, item string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = sorted((r.doc or "", r.page, r.seq, r.line_no, r.y, r.line) for r in T.paginated(rows).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted((d or "", *p) for d in ("a", "b", "c", None) for p in plain.placed([(s, r or "", t) for x, s, r, t in items if x == d]))
    assert max(r[1] for r in got) > 3


def test_placed_goes_on_at_any_cut():
    """What is kept between two parts is all that the second needs."""
    import numpy as np

    rng = np.random.default_rng(2)
    n = rng.integers(1, 60, 200)
    step, before, after = rng.integers(1, 40, 200), rng.integers(0, 9, 200), rng.integers(0, 9, 200)
    opens = rng.random(200) < 0.1
    opens[0] = True
    cols = (step, before, after, n, opens)
    whole = T._placed(*cols, 300, 0, (0, 0, 0))
    for cut in (1, 50, 117, 199):
        a = T._placed(*[c[:cut] for c in cols], 300, 0, (0, 0, 0))
        b = T._placed(*[c[cut:] for c in cols], 300, *a[2:])
        assert np.array_equal(np.concatenate([a[0], b[0]]), whole[0]) and np.array_equal(np.concatenate([a[1], b[1]]), whole[1]) and b[2:] == whole[2:]


def test_whitespace_is_that_of_the_pattern(spark):
    chars = [chr(i) for i in range(0x3100) if not 0xD800 <= i < 0xE000] + ["", " a ", "a\n", "\n  a b　\n\r", " \x85", "\x1c \x1f", "Images have been losslessly embedded.", "　\n Document generated by Anna's Archive around x", "x Images have been losslessly embedded.", None]
    rows = spark.createDataFrame([(c,) for c in chars] + [(f"{c}b{c}",) for c in chars if c], "t string")
    t, full = F.col("t"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    artefact = full.startswith(X.ARTEFACTS[0]) | full.startswith(X.ARTEFACTS[1])
    wrong = ~X.trim_ws(t).eqNullSafe(full) | ~X.rtrim_ws(t).eqNullSafe(F.regexp_replace("t", r"(?U)\s+$", "")) | (X.not_blank(t) != F.coalesce(F.length(full) > 0, F.lit(False))) | ~X.is_scanner_artefact(t).eqNullSafe(artefact)
    assert rows.filter(wrong).collect() == [] and rows.filter(X.is_scanner_artefact(t)).count() == 4
