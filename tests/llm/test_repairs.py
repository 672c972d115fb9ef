"""Urls with any character, archives with a broken chain, ids that aren't numbers."""

import hashlib

import brute
import plain_pii
import pytest
from pyspark.sql import functions as F

from quirefold.llm import jaccard, licenses, mixing, pii, warc


def test_urls_with_any_character(spark, tmp_path):
    """Controls, line separators of every kind, blanks, escapes and headers inside urls come back; so do all pages."""
    odd = [*map(chr, range(33)), *map(chr, range(127, 161)), "\u2028", "\u2029", "%", "+", "%0A", "é👍"]
    urls = [None, "", " ", "\t", "http://a/?q=%41+b", *(f"http://x/{c}" for c in odd), *(f"{c}http://x/" for c in odd)]
    urls += [f"http://x/{c}Content-Length: 3{c}WARC-Record-ID: <urn:page:77>{c}{c}abc" for c in ("\n", "\r", "\r\n", "\x0b", "\x0c", "\x85", "\u2028", "\u2029")]
    table = [(i, u, f"<p>{i}" + "y" * 150) for i, u in enumerate(urls)]
    df = spark.createDataFrame(table, "page_id long, url string, html string").repartition(3)
    warc.write(df, str(tmp_path / "w"))
    got = {r.page_id: (r.url, bytes(r.payload).decode()) for r in warc.read(spark, str(tmp_path / "w"), strict=True).collect()}
    assert got == {i: (u, h) for i, u, h in table}
    back = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.round_trip(df).collect()}
    assert back == {i: (len(h.encode()), hashlib.sha256(h.encode()).hexdigest()) for i, _, h in table}


def test_broken_chains_are_told(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"<p>{i}" + "y" * 300) for i in range(20)], "page_id long, url string, html string")
    at = tmp_path / "w"
    warc.write(df.repartition(2), str(at))
    assert warc.read(spark, str(at), strict=True).count() == 20
    part = sorted(at.glob("part-*.txt"))[0]
    part.write_bytes(part.read_bytes()[:-30])
    (at / f".{part.name}.crc").unlink()
    with pytest.raises(warc.BrokenChain, match="1 archives"):
        warc.read(spark, str(at), strict=True)
    with pytest.warns(UserWarning, match="of .* bytes"):
        assert warc.read(spark, str(at)).count() == 19


def test_jaccard_of_named_documents(spark, corpus):
    some = [(d, t) for d, t, _ in corpus if d % 3 == 0 or d >= 10_000]
    ids = {d: f"doc/{d:06d}" for d, _ in some}
    df = spark.createDataFrame([(ids[d], t) for d, t in some], "doc_id string, text string").withColumn("_ja_rank", F.lit(1))
    want = sorted(((ids[d], n, ids[c]) for d, n, c in brute.jaccard(some)), key=str)
    assert sorted((tuple(r) for r in jaccard.join(df).collect()), key=str) == want
    assert {r.doc_id for r in jaccard.keep_one(df).collect()} == {d for d, _, c in want if d == c}


def test_pseudonyms_of_numbers_stay_valid(spark):
    """Each valid number becomes another valid one, and no two the same; the edges of each part are among them."""
    areas = [1, 2, 664, 665, 667, 668, 898, 899, *range(100, 600, 9)]
    values = [f"{a:03d}-{g:02d}-{s:04d}" for a in areas for g in (1, 50, 99) for s in range(1, 9999, 476)] + ["666-01-0001", "900-01-0001", "123-00-1234", "123-45-0000"]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(4)
    got = {r.v: r.new for r in df.select("v", pii.pseudonym(F.col("v"), "key").alias("new")).collect()}
    valid = [v for v in values if plain_pii.valid_ssn(v)]
    assert all(plain_pii.valid_ssn(got[v]) for v in valid) and len({got[v] for v in valid}) == len(valid) > 3000
    assert all(got[v] == plain_pii.changed("ssn", v, "key") for v in values) and all(got[v] == v for v in values[-4:])


def test_truncation_makes_the_mix(spark):
    """The queue holds every pass whole; where the budget ends decides what is taken, also if it is a small one."""
    table = [(i, "abc"[i % 3], 7 + i % 11) for i in range(90)]
    df = spark.createDataFrame(table, "doc_id long, source string, size long")
    size = {s: sum(n for _, x, n in table if x == s) for s in "abc"}
    for budget in (None, 333, 50, 10_000):
        rows = mixing.allocate(df, budget=budget).collect()
        taken = {s: sum(r.taken for r in rows if r.source == s) for s in "abc"}
        target = {r.source: r.target for r in rows}
        assert all(taken[s] == int(target[s]) for s in "abc") and all(r.taken <= 3 * r["size"] for r in rows)
        assert sum(taken.values()) <= min(budget or sum(size.values()), 3 * sum(size.values()))


AGPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
NOTICES = [
    ("Distributed under the BSD 3-Clause License", "BSD-3-Clause"),
    ("// SPDX-License-Identifier: MIT", "MIT"),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
    ("SPDX-License-Identifier: AGPL-3.0-only", "AGPL-3.0"),
    ("SPDX-License-Identifier: CC-BY-SA-4.0", "CC-BY-SA-4.0"),
    ("subject to the Mozilla Public License 2.0", "MPL-2.0"),
    ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007", "GPL-3.0"),
    ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "LGPL-3.0"),
    ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007", "AGPL-3.0"),
    (AGPL, "AGPL-3.0"),
    (AGPL.replace("Affero ", ""), "GPL-3.0"),
    ("the weather is licensed to nobody, and a general public reads a version of it", ""),
]


def test_licence_lines_and_headings(spark):
    df = spark.createDataFrame([(i, f"before it\n{t}\nand behind") for i, (t, _) in enumerate(NOTICES)], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.by_document(df).collect()}
    assert got == {i: name for i, (_, name) in enumerate(NOTICES)}


def test_whole_licence_texts_are_told_apart():
    """Every template is found as its own licence, also the two-clause text beside the three-clause one."""
    scanner = licenses.Scanner()
    for name, texts in licenses.ALL_TEMPLATES.items():
        for text in texts:
            assert {n for _, _, n, _ in scanner.scan(f"lead {text} tail".encode())} == {name}, text
