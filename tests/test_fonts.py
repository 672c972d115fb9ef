"""Glyph bitmaps against plain sets of characters."""

import random

from quirefold.operators import fonts as G

SCHEMA = "lang string, text string"


def _plain(rows):
    out = {}
    for lang, text in rows:
        out.setdefault(lang, set()).update(c for c in text or "" if not c.isspace())
    return {k: v for k, v in out.items() if v}


def _sets(df, by="lang"):
    out = {}
    for r in df.collect():
        assert r.glyph not in out.setdefault(r[by], set())
        out[r[by]].add(r.glyph)
    return out


def test_round_trip(spark):
    edges = "\x01\x7f\x80߿ࠀ翿耀퟿￿\U00010000\U0001f600\U0010ffff"
    rows = [("a", "hello hello"), ("a", None), ("b", ""), ("c", edges), ("a", edges[::2]), ("d", " \t\n")]
    assert _sets(G.glyphs_of(G.required(spark.createDataFrame(rows, SCHEMA), ["lang"]), ["lang"])) == _plain(rows)


def test_merged_is_union(spark):
    rows = [("a", "abc"), ("b", "bé"), ("b", "\U0001f600c")]
    needed = G.required(spark.createDataFrame(rows, SCHEMA), ["lang"])
    assert {r.glyph for r in G.glyphs_of(G.merged(needed, []), []).collect()} == set("abcé\U0001f600")


def test_coverage_and_missing(spark):
    rng = random.Random(5)
    pool = [chr(c) for c in (*range(33, 127), *range(0xC0, 0x180), *range(0x4E00, 0x4E40), *range(0x1F600, 0x1F620))]
    rows = [(f"l{i % 7}", "".join(rng.choices(pool[: 20 + 60 * (i % 7)], k=30))) for i in range(60)] + [("none", "☃")]
    have = {f: set(rng.sample(pool, n)) for f, n in (("one", 90), ("two", 200), ("three", 200), ("same", 0))}
    have["same"] = set(have["two"])
    rank = {"one": 1, "two": 3, "three": 4, "same": 2}
    fonts = G.glyph_sets(spark.createDataFrame([(f, rank[f], g) for f, gs in have.items() for g in gs], "font string, rank int, glyph string"), ["font", "rank"])
    needed = G.required(spark.createDataFrame(rows, SCHEMA), ["lang"])
    chosen = G.coverage(needed, fonts, ["lang"])
    want, lacks = {}, {}
    for lang, need in _plain(rows).items():
        font = max(have, key=lambda f: (len(need & have[f]), -rank[f]))
        if need & have[font]:
            want[lang] = (font, len(need & have[font]), len(need - have[font]))
            if need - have[font]:
                lacks[lang] = need - have[font]
    assert {r.lang: (r.font, r.supported, r.missing) for r in chosen.collect()} == want and "none" not in want
    assert _sets(G.missing(needed, chosen, fonts, ["lang"])) == lacks


def test_no_texts(spark):
    none = G.required(spark.createDataFrame([], SCHEMA), ["lang"])
    assert G.coverage(none, none.selectExpr("lang as font", "1 as rank", "range", "glyphs"), ["lang"]).count() == 0
