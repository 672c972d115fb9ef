"""Sharding, whitening and the manifest against plain versions, and on odd tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.llm import manifest, sharding, whitening

SF = "/root/testdata/sf0.001"


# Sharding


def plain_shard(key: str, tree) -> int:
    def least(found: dict[str, float]) -> str:
        draws = {}
        for path, w in found.items():
            bits = int(hashlib.md5(f"{key}/{path}".encode()).hexdigest()[:12], 16)
            draws[path] = -math.log((bits + 0.5) / (1 << 48)) / w
        return min(draws, key=draws.get)

    weight: dict[str, Counter] = defaultdict(Counter)
    for region, rack, shard, w in tree:
        if w > 0:
            for parent, path in (("", region), (region, f"{region}/{rack}"), (f"{region}/{rack}", f"{region}/{rack}/{shard}")):
                weight[parent][path] += w
    at = ""
    for _ in range(3):
        at = least(weight[at])
    return int(at.rpartition("/")[2])


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(None, None), (None, "a"), (7, None), (7, ""), (900_001, "é👍" * 5000)] + [(900_002, "the same row")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    return df.withColumns({c: F.lit("x") for c in ("size", "shard", "slot", "law", "grown_shard", "_sh_n")})


def test_shards_of_odd_rows(odd_docs):
    tree, more = sharding.regular(), sharding.grown(sharding.regular())
    rows = sharding.assign(odd_docs).collect()
    given = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in odd_docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == given
    slots = defaultdict(list)
    for r in rows:
        key = "null" if r.doc_id is None else str(r.doc_id)
        assert r.shard == plain_shard(key, tree) and r.grown_shard == plain_shard(key, more) and r.grown_shard in (r.shard, 40) and r.law == "key"
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_windows_of_a_shard(odd_docs):
    """Slots are the same however many windows a shard is cut into."""
    found = sharding.placed(odd_docs.drop("_sh_n")).select("doc_id", "size", "text_crc32", "shard")
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_crc32", "size"))
    few, many = (sorted(map(str, sharding.numbered(found, key, n).collect())) for n in (10**6, 5))
    assert few == many


def test_weights_and_movement(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    tree = [("a", "x", 0, 1.0), ("a", "x", 1, 3.0), ("a", "y", 2, 2.0), ("b", "x", 3, 4.0), ("c", "x", 4, 0.0)]
    heavier = [(r, k, s, 2.0 if s == 0 else w) for r, k, s, w in tree]
    rows = keys.select(sharding.descend(F.col("k"), tree).alias("old"), sharding.descend(F.col("k"), heavier).alias("new"), sharding.descend(F.col("k"), sharding.grown(tree)).alias("grown")).collect()
    share = Counter(r.old for r in rows)
    assert set(share) == {0, 1, 2, 3} and all(abs(share[s] / 20_000 - w / 10) < 0.015 for s, w in ((0, 1), (1, 3), (2, 2), (3, 4)))
    # Only rack a/x and region a got heavier: nothing moves into b, nothing moves out of the rack.
    assert all(r.new in (0, 1) if r.old in (0, 1) else r.new != 3 or r.old == 3 for r in rows)
    assert all(r.grown in (r.old, 5) for r in rows) and any(r.grown == 5 for r in rows)
    with pytest.raises(ValueError):
        sharding.descend(F.col("k"), [("a", "x", 0, 0.0)])


def test_shards_of_no_rows_and_other_ids(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.assign(empty).collect() == []
    named = spark.createDataFrame([("p/1", "a", "en"), ("p/2", None, "de")], "doc_id string, text string, lang string")
    assert {r.doc_id: r.shard for r in sharding.assign(named).collect()} == {k: plain_shard(k, sharding.regular()) for k in ("p/1", "p/2")}
    sharding.write(named, str(tmp_path / "shards"))
    assert {(r.doc_id, r.text, r.lang, r.shard) for r in spark.read.parquet(str(tmp_path / "shards")).collect()} == {(k, t, g, plain_shard(k, sharding.regular())) for k, t, g in (("p/1", "a", "en"), ("p/2", None, "de"))}


# Whitening


def plain_whitening(vectors: list[list[float]], k: int = 4):
    d = max(map(len, vectors))
    x = [[math.floor(256 * c) for c in v] + [0] * (d - len(v)) for v in vectors]
    distinct = np.array(sorted({tuple(v) for v in x}), dtype=float)
    n, sums = len(distinct), [int(s) for s in distinct.sum(axis=0)]
    centred = distinct - distinct.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    far = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    white = ((np.array(x, float) * n - np.array(sums)) / n) @ axes[:, :k] / np.sqrt(values[:k])
    return n, far, white, values[:k] / values.sum()


def test_whitening_of_odd_rows(spark):
    rng = random.Random(3)
    good = [(i, [rng.gauss(0, j + 1) * 0.1 for j in range(9)]) for i in range(700)]
    good += [(5000, good[0][1]), (5000, good[0][1]), (None, good[1][1]), (5001, [1.5] * 4), (5002, [-0.0] * 9), (5003, [])]
    bad = [(6000, None), (6001, [1.0, None] + [0.0] * 7), (6002, [float("nan")] + [0.0] * 8), (6003, [float("inf")] + [0.0] * 8)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").repartition(23).withColumns({c: F.lit("x") for c in ("n", "component", "whitened", "_wh_x")})
    rows = whitening.whiten(df).collect()
    n, far, white, explained = plain_whitening([v for _, v in good])
    assert len(rows) == 4 * len(good)
    sign = {}
    want = defaultdict(list)
    for (i, _), f, w in zip(good, far, white):
        want[i].append((f, w))
    for r in rows:
        f, w = next(x for x in want[r.vec_id] if x[0] == r.deviation)
        w = w[r.component - 1]
        if abs(w) > 1e-3:
            assert sign.setdefault(r.component, r.whitened * w > 0) == (r.whitened * w > 0)
        assert r.n == n and abs(abs(r.whitened) - abs(w)) < 1e-8
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9


def test_merging_keeps_every_dimension(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-200, 200, (500, 12)) @ rng.integers(-3, 3, (12, 12))
    parts = [whitening.Summary.of(p) for p in np.array_split(x, 9)]
    one = parts[0]
    for p in parts[1:]:
        one = one.with_(p)
    scatter = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))
    back = (one.singular[:, None] * one.vectors).T @ (one.singular[:, None] * one.vectors)
    assert one.n == 500 and [int(s) for s in one.sums] == x.sum(axis=0).tolist() and np.allclose(back, scatter, rtol=1e-10)


def test_whitening_without_variance_and_of_huge_entries(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(make([])).collect() == [] == whitening.whiten(make([(1, None), (2, [])])).collect()
    rows = whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(rows)] == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    rows = whitening.whiten(make([(1, [0.0, 0.0]), (2, [1e300, 1.0]), (3, [4e15, 1.0])])).collect()
    assert {r.deviation for r in rows} == {None} and {r.n for r in rows} == {3}
    line = whitening.whiten(make([(i, [float(i), 2.0 * i]) for i in range(5)])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line) and all(r.identity_error < 1e-12 for r in line)


# Manifest


def H(*x: str) -> str:
    return hashlib.sha256("".join(x).encode()).hexdigest()


def plain_tree(leaves: list[str]) -> tuple[str, list[list[tuple[int, str]]]]:
    """The root, and the steps from every leaf to it."""
    proofs, at, now = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(now) > 1:
        for p, i in zip(proofs, at):
            p.append((2, "") if i ^ 1 >= len(now) else (i & 1, now[i ^ 1]))
        now, at = [H(*now[i : i + 2]) for i in range(0, len(now), 2)], [i >> 1 for i in at]
    return now[0], proofs


def plain_manifest(docs: list[tuple], tamper):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, n: H(*map(field, (d[0], d[1], d[2], n, d[4])))
    groups = defaultdict(list)
    for d in docs:
        groups[d[2]].append((d[0] is not None, d[0] or 0, leaf(d, d[3]), leaf(d, d[3] + 1) if tamper(d[0]) and d[3] is not None else leaf(d, d[3])))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g])]) for g in order}
    root, ups = plain_tree([trees[g][0] for g in order])
    out = []
    for g, up in zip(order, ups):
        for (there, doc, own, claim), proof in zip(sorted(groups[g]), trees[g][1]):
            folded = claim
            for side, x in proof + up:
                folded = H(folded, x) if side == 0 else H(x, folded) if side == 1 else H(folded)
            out.append((doc if there else None, own, trees[g][0], root, H(*[x for side, x in proof + up if side != 2]), folded, folded == root))
    return out


def odd_rows(n: int, seed: int = 0) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", None]), rng.choice(["en"] * 9 + ["de", "", None, "é"]), rng.choice([None, 1, 25]), rng.choice([None, "", "x" * 9, "é\0👍"])) for i in range(n)]
    return rows + [(None, "s", "en", 3, "null id")] * 2 + [(n // 2, "a", "en", 5, "again")] * 5 + [(n + 7, None, "only", None, "y" * 200_000)]


@pytest.mark.parametrize(("n", "a_range", "rise"), [(0, 50_000, 4), (33, 4, 1), (200, 7, 1), (700, 40, 2), (700, 50_000, 4)])
def test_manifest_of_odd_rows(spark, monkeypatch, n, a_range, rise):
    monkeypatch.setattr(manifest, "ROWS_A_RANGE", a_range)
    monkeypatch.setattr(manifest, "RISE", rise)
    docs = odd_rows(n)
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string").repartition(5).withColumns({c: F.lit("x") for c in ("leaf", "root", "proof", "place", "claim", "_mk_n", "level")})
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = manifest.audit(df, tampered, F.col("n_chars") + 1).collect()
    want = plain_manifest(docs, lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 0)
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))


def test_proofs_fold_to_the_root(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = manifest.manifest(docs).withColumn("folded", manifest.fold(F.col("leaf"), F.col("proof"))).collect()
    assert len(rows) == docs.count() and len({r.root for r in rows}) == 1 and all(r.folded == r.root for r in rows)
    assert all([r.place for r in sorted(g, key=lambda r: r.doc_id)] == list(range(len(g))) for g in ([r for r in rows if r.lang == x] for x in {r.lang for r in rows}))


def test_manifest_of_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert manifest.manifest(empty).collect() == []
