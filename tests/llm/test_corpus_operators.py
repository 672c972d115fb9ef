"""The corpus operators against plain versions, and their edge cases."""

import hashlib
import re
import zlib
from collections import defaultdict

import brute
import numpy as np
import plain_pii
import pytest
from pyspark.sql import functions as F

from quirefold.llm import components, decontamination, fingerprints, jaccard, licenses, mixing, pii, quality, suffixes, toxicity, warc

ITEMS = [(1, " ".join(f"W{i}" for i in range(100, 140))), (2, "one"), (3, None), (4, ""), (5, "a b c"), (6, "w20 w21 w22 w23"), (7, " ".join(f"w{i}" for i in range(135, 150)))]
EMPTY = "doc_id long, text string, source string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def test_decontamination(spark, corpus, docs):
    want = sorted(brute.decontamination([(d, t) for d, t, _ in corpus], ITEMS), key=str)
    assert rows(decontamination.report(docs, items(spark))) == want
    blocks = decontamination._scanned(docs.select("doc_id", "text"), decontamination.automata(items(spark), block_words=20))
    hits = {r.doc_id: (r.n_words, set(r.hit_items)) for r in blocks.collect()}
    assert all(hits[d][0] == n and len(hits[d][1]) == k for d, n, _, k, *_ in want)
    assert rows(decontamination.report(spark.createDataFrame([], EMPTY), items(spark))) == []
    none = decontamination.report(docs, items(spark).filter("item_id in (3, 4)"))
    assert none.filter("contaminated").count() == 0


def test_decontaminated_texts(spark, corpus, docs):
    out = {r.doc_id: r.text for r in decontamination.decontaminate(docs, items(spark)).collect()}
    again = brute.decontamination(out.items(), ITEMS)
    assert not any(r[-1] for r in again)
    clean = {r[0] for r in brute.decontamination([(d, t) for d, t, _ in corpus], ITEMS) if not r[-1]}
    assert all(out[d] == t for d, t, _ in corpus if d in clean)


def test_jaccard(spark, corpus, docs):
    want = sorted(brute.jaccard([(d, t) for d, t, _ in corpus]), key=str)
    assert rows(jaccard.join(docs)) == want
    kept = {r.doc_id for r in jaccard.keep_one(docs).collect()}
    assert kept == {d for d, _, c in want if d == c}
    assert rows(jaccard.join(spark.createDataFrame([], EMPTY))) == []


def test_jaccard_chain_of_edits(spark):
    """Copies of which each differs from the last: neighbours are linked, the ends are not alike."""
    rng = np.random.default_rng(5)
    text = [f"t{i}" for i in rng.integers(0, 10_000, 400)]
    chain = []
    for i in range(30):
        chain.append((i * 7 + 3, " ".join(text)))
        for j in rng.integers(0, 400, 4):
            text[j] = f"n{i}x{j}"
    df = spark.createDataFrame(chain, "doc_id long, text string")
    assert rows(jaccard.join(df)) == sorted(brute.jaccard(chain), key=str)


def test_jaccard_near_the_threshold(spark):
    """Families of texts about as alike as the threshold: which are linked is decided pair by pair."""
    rng = np.random.default_rng(17)
    table = []
    for family in range(6):
        base = [f"f{family}w{i}" for i in range(150)]
        for i in range(40):
            text = list(base)
            for j in rng.choice(150, int(rng.integers(1, 6)), replace=False):
                text[j] = f"x{rng.integers(1 << 40)}"
            table.append((family * 100 + i, " ".join(text)))
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(6)
    assert rows(jaccard.join(df)) == sorted(brute.jaccard(table), key=str)


def test_signatures_meet():
    """Sets at the threshold share a place, at every size."""
    rng = np.random.default_rng(3)
    for n in [*range(2, 60), 100, 333, 1000]:
        for _ in range(5):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            most = n // 5
            gone = rng.choice(n, rng.integers(0, most + 1), replace=False)
            b = np.delete(a, gone)
            extra = int(len(b) / 0.8) - n
            b = np.unique(np.append(b, rng.integers(0, 1 << 63, max(0, rng.integers(0, max(extra, 0) + 1)), dtype=np.uint64)))
            if len(b) > 1 and jaccard.similar(a, b):
                assert len(np.intersect1d(jaccard.signatures(a), jaccard.signatures(b)))
                points = jaccard.folded([jaccard.unpacked(jaccard.packed(jaccard.counts(v))) for v in (a, b)])
                assert len(jaccard.near_among(points[:1], points[:1].sum(axis=1), points[1]))


def test_meetings_in_parts(monkeypatch):
    """Places that many share come in parts, and every two of their nodes still meet at the place."""
    import pyarrow as pa

    table = sorted((p, n) for p in range(-3, 4) for n in range(1 + (p % 4) * 9))

    def result(size):
        batch = pa.RecordBatch.from_pydict({"place": [p for p, _ in table], "node": [n for _, n in table]})
        out = [r for b in jaccard.meeting_rows(batch.slice(i, size) for i in range(0, len(table), size)) for r in b.to_pylist()]
        held = defaultdict(set)
        for r in out:
            held[r["place"]] |= set(r["nodes"])
        return held, len({(r["first"], r["second"]) for r in out}) if size < 3 else None

    whole = result(1000)[0]
    assert whole == {p: {n for q, n in table if q == p} for p in range(-3, 4) if p % 4}
    monkeypatch.setattr(jaccard, "LONG", 4)
    assert result(3)[0] == result(1)[0] == whole


def test_hubs_by_batch():
    import pyarrow as pa

    table = [(1, 9), (1, 3), (1, 4), (2, 4), (2, 3), (5, 9), (5, 3)]
    batch = pa.RecordBatch.from_pydict({"place": [p for p, _ in table], "node": [n for _, n in table]})
    for size in (1, 2, 7):
        often = defaultdict(int)
        for b in jaccard.hub_rows(batch.slice(i, size) for i in range(0, 7, size)):
            for r in b.to_pylist():
                often[r["node"], r["hub"]] += r["n"]
        assert often == {(3, 9): 2, (4, 9): 1, (3, 4): 1}


def test_near_pairs_need_no_tree_or_one():
    """The tree lets through exactly the pairs whose summed minima allow a link."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 62, 300, dtype=np.uint64)
    sets = []
    for i in range(60):
        s = base.copy() if i % 3 else rng.integers(0, 1 << 62, 300, dtype=np.uint64)
        s[rng.choice(300, i, replace=False)] = rng.integers(0, 1 << 62, i, dtype=np.uint64)
        sets.append(np.unique(s))
    points = jaccard.folded([jaccard.counts(s) for s in sets])
    tree = jaccard.CountTree(points)
    for i in range(60):
        assert sorted(tree.near(i).tolist()) == jaccard.near_among(points, points.sum(axis=1), points[i]).tolist()
        assert all(j in tree.near(i) for j in range(60) if jaccard.similar(sets[i], sets[j]))


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 9), (5, 5), (100, 3)] + [(200 + i, 201 + i) for i in range(40)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 100: 1, 8: 8, 9: 8, **{200 + i: 200 for i in range(41)}}


def test_suffixes(spark, corpus, docs, monkeypatch):
    want = sorted(brute.repeats([(d, t) for d, t, _ in corpus]), key=str)
    assert rows(suffixes.report(docs)) == want
    assert rows(suffixes.report(docs.unionByName(docs))) == sorted([(d, n, n if n >= 400 else 0, int(n >= 400), brute.sha(b"" if n >= 400 else (dict((x, y) for x, y, _ in corpus)[d] or "").encode())) for d, n, *_ in want] * 2, key=str)
    assert rows(suffixes.report(spark.createDataFrame([], EMPTY))) == []


def test_suffixes_ids_are_only_passed_on(spark):
    """Null, repeated and string ids; a text that repeats inside itself; a very long text."""
    passage = " ".join(f"q{i}" for i in range(150))
    long = " ".join(str(i * 7919 % 100_003) for i in range(100_000))
    texts = [(None, "x " + passage), (None, passage + " y"), ("7", passage), ("7", None), ("a", "z" * 900), ("b", long), ("c", "c " + long[200_000:201_000])]
    df = spark.createDataFrame(texts, "doc_id string, text string")
    assert rows(suffixes.report(df)) == sorted(brute.repeats(texts), key=str)


def test_suffixes_in_small_pieces(spark, corpus, monkeypatch):
    """The streamed sort with hardly any rows held, and parts with too many runs for one task."""
    monkeypatch.setattr(suffixes, "TOGETHER", 1)
    df = spark.createDataFrame(corpus, EMPTY).repartition(5)
    assert rows(suffixes.report(df)) == sorted(brute.repeats([(d, t) for d, t, _ in corpus]), key=str)


def test_neighbours_hold_little(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffixes, "HELD", 3)
    rng = np.random.default_rng(1)
    table = sorted((int(rng.integers(0, 6)), int(rng.integers(0, 3)), i) for i in range(300))
    kinds = [suffixes.KNOWN if i % 17 == 0 else suffixes.OPEN for i in range(300)]
    cols = [pa.array(kinds, pa.int32()), *[pa.array([r[k] for r in table], pa.int64()) for k in range(3)], pa.array([0] * 300, pa.int32()), pa.array([1] * 300, pa.int32())]
    whole = pa.RecordBatch.from_arrays(cols, suffixes.NAMES)

    def result(size):
        out = [r for b in suffixes.neighbours(whole.slice(i, size) for i in range(0, 300, size)) for r in b.to_pylist()]
        marked = sorted(r["row"] for r in out if r["kind"] == suffixes.REPEATED)
        return marked, sorted({(r["part"], r["kind"]) for r in out if r["kind"] != suffixes.REPEATED})

    assert result(1) == result(7) == result(300)


def test_suffixes_remove(spark):
    passage = "p" * 10 + " ".join(str(i) for i in range(200))
    df = spark.createDataFrame([(1, "left " + passage + " right"), (2, passage), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffixes.remove(df).collect()}
    assert got[1] == "left  right" and got[2] == "" and got[3] is None


def test_mixing(spark, docs):
    sized = docs.drop("size").withColumn("size", mixing.words_in(F.col("text")))
    out = mixing.allocate(sized, rows_a_window=10).collect()
    again = mixing.allocate(sized.repartition(3)).collect()
    assert {(r.doc_id, r.taken) for r in out} == {(r.doc_id, r.taken) for r in again}
    taken, target = defaultdict(int), {}
    for r in out:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r["size"] and r.target <= 3 * r.source_size
    assert all(abs(taken[s] - target[s]) < 1 for s in target)
    assert abs(sum(target.values()) - sum(r["size"] for r in out)) < 1e-6
    assert mixing.allocate(spark.createDataFrame([], "doc_id long, source string, size long")).count() == 0
    mixed = mixing.mix(docs).collect()
    assert all(r.taken > 0 for r in mixed) and {r.doc_id for r in mixed} == {r.doc_id for r in out if r.taken}


@pytest.mark.parametrize("budget", [None, 700, 0])
def test_mixing_against_a_plain_version(spark, budget):
    """Null ids, repeated rows, ties and empty sources: passes sorted by finish time and cut at the budget."""
    rng = np.random.default_rng(2)
    table = [(int(i), ["a", "b", "c", None][rng.integers(4)], int(rng.integers(0, 40))) for i in range(60)] + [(None, "a", 5), (None, "a", 5), (7, "b", 3), (7, "b", 3), (90, "zero", 0), (91, "one", 2)]
    out = mixing.allocate(spark.createDataFrame(table, "doc_id long, source string, size long").withColumn("taken", F.lit("x")), rows_a_window=8, budget=budget).collect()
    key = lambda d, n: hashlib.md5((str(d) if d is not None else f"null {n}").encode()).hexdigest()
    sources = sorted({s for _, s, _ in table}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, x, n in table if x == s) for s in sources}
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    whole = sum(size.values()) if budget is None else budget
    full: set = set()
    while True:
        left, active = whole - sum(3 * size[s] for s in full), sum(weight[s] for s in sources if s not in full)
        more = {s for s in sources if s not in full and 3.0 * size[s] * active < left * weight[s]}
        if not more:
            break
        full |= more
    target = {s: 3.0 * size[s] if s in full else min(left * weight[s] / active, 3.0 * size[s]) for s in sources}
    passes, taken = [], defaultdict(int)
    for place, s in enumerate(sources):
        queue, start = sorted(((key(d, n), d or 0, n, j) for j, (d, x, n) in enumerate(table) if x == s)), 0
        for _, _, n, j in queue:
            for e in range(3):
                piece = max(0, min(n, int(target[s]) - e * size[s] - start))
                if piece:
                    passes.append(((e * size[s] + start + piece) / weight[s], place, piece, j))
            start += n
    left = whole
    for _, _, piece, j in sorted(passes):
        taken[j] += min(piece, left)
        left -= min(piece, left)
    want = sorted((str(d), str(s), n, taken[j]) for j, (d, s, n) in enumerate(table))
    got = sorted((str(r.doc_id), str(r.source), r["size"], r.taken) for r in out)
    assert got == want and all(abs(r.target - target[r.source]) < 1e-9 for r in out)


def test_mixing_truncates_inside_a_pass(spark):
    """A budget that ends inside a pass, below what the targets add up to."""
    rows_ = [(i, "a" if i % 2 else "b", 10) for i in range(40)]
    df = spark.createDataFrame(rows_, "doc_id long, source string, size long").withColumn("place", F.when(F.col("source") == "a", 1).otherwise(2))
    queue = df.withColumn("source_size", F.lit(200)).withColumn("target", F.lit(600.0)).withColumn("weight", F.lit(1)).withColumn("_mx_start", (F.floor(F.col("doc_id") / 2) * 10).cast("long"))
    assert mixing.truncation(queue, 10_000) is None
    assert mixing.truncation(queue, 45) == (30.0, 1, 5)
    assert mixing.truncation(queue, 0) == (10.0, 1, 0)


def test_mixing_targets(spark):
    sources = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1), (None, 500)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sources).collect()}
    assert got["a"] == 30 and got["c"] == 3 and abs(got["b"] - (1511 - 33) * 2 / 3) < 1e-9 and abs(got[None] - (1511 - 33) / 3) < 1e-9


def test_fingerprints(spark, corpus, docs):
    got = {r.doc_id: r for r in fingerprints.compare(docs).collect()}
    order = sorted(corpus, key=lambda r: -r[0])
    for (d, t, _), (_, follow, _) in zip(order, [*order[1:], order[0]]):
        t, follow = t or "", follow or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + follow[:half]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), brute.sha(edited))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if t == follow:
            assert r.near_next == 1.0
    by_text = defaultdict(set)
    for d, t, _ in corpus:
        by_text[t or ""].add(got[d].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert np.mean([r.near_edited for r in got.values()]) > np.mean([r.near_next for r in got.values()])
    assert fingerprints.compare(spark.createDataFrame([], EMPTY)).count() == 0
    three = spark.createDataFrame([(1, "only here"), (2, "quite another"), (3, "third text")], "doc_id long, text string")
    assert all(r.near_next == 0 for r in fingerprints.compare(three).collect())


def test_fingerprints_over_ranges(spark, corpus):
    """Ranges of a few rows, terms joined instead of looked up, null and equal ids: always the same."""
    df = spark.createDataFrame([*corpus, (None, "no id", None), (10_001, "again", None)], EMPTY)
    whole = rows(fingerprints.compare(df))
    assert rows(fingerprints.compare(df.repartition(7), rows_a_range=10)) == whole
    assert rows(fingerprints.compare(df, terms_in_a_set=0)) == whole


def test_fingerprints_recomputed(spark):
    """Fingerprints and likeness against a plain version over the hashes of Spark's own xxhash64."""
    real = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame(real, "doc_id long, text string")
    terms = {d: re.findall(r"[^\W_]+", t.lower()) for d, t in real}
    vocabulary = sorted({w for ws in terms.values() for w in ws})
    frame = spark.createDataFrame([(w,) for w in vocabulary], "w string").select("w", F.xxhash64("w").alias("h"))
    rates = [F.pmod(F.xxhash64("h", F.lit(r)), F.lit(r)).alias(f"r{r}") for r in fingerprints.RATES]
    of = {r.w: r for r in frame.select("*", *rates).collect()}
    often = defaultdict(int)
    for ws in terms.values():
        for w in set(ws):
            often[w] += 1
    n = len(real)
    lexicon = {w for w, k in often.items() if max(2, -(-n * 2 // 1000)) <= k <= n // 5}
    subsets = {d: [tuple(sorted(of[w].h for w in set(ws) & lexicon if of[w][f"r{r}"] == k)) for r in fingerprints.RATES for k in range(fingerprints.SUBSETS)] for d, ws in terms.items()}

    def like(x, y):
        for i in reversed(range(len(fingerprints.RATES))):
            part = [(p, q) for p, q in list(zip(subsets[x], subsets[y]))[i * fingerprints.SUBSETS : (i + 1) * fingerprints.SUBSETS] if p or q]
            if len(part) >= fingerprints.ENOUGH:
                return sum(p == q for p, q in part) / len(part)
        part = [(p, q) for p, q in zip(subsets[x], subsets[y]) if p or q]
        return sum(p == q for p, q in part) / len(part) if part else float(terms[x] == terms[y])

    got = {r.doc_id: r for r in fingerprints.compare(df).collect()}
    order = sorted(got, reverse=True)
    for d, following in zip(order, [*order[1:], order[0]]):
        assert abs(got[d].near_next - like(d, following)) < 1e-9
    prints = defaultdict(set)
    for d in got:
        prints[tuple(subsets[d]), tuple(terms[d])].add(got[d].fingerprint)
    assert all(len(v) == 1 for v in prints.values()) and len({f for v in prints.values() for f in v}) == len(prints)
    assert np.mean([r.near_edited for r in got.values()]) > 5 * np.mean([r.near_next for r in got.values()])


VALUES = ["x.99@mail7.example.com", "04dbebab91ab85687d33eeaaf9ac699e1188f962", "GB82 WEST 1234 5698 7654 32", "97.51.17.173", "2024-02-29", "29.02.2024", "123-45-6789", "+1 (017) 555-7713", "4111 1111 1111 1111"]
WRONG = ["9807915762804490", "999.1.1.1", "2023-02-29", "x@y", "000-12-3456", "12"]


def form(value):
    """A value with its digits and letters made equal; the numbers of an address may get other lengths."""
    if re.fullmatch("[0-9.]+", value) and value.count(".") == 3:
        return re.sub("[0-9]+", "9", value)
    return re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "9", value)))


def test_pii(spark):
    texts = [f"before {v}, after {v}\nend" for v in VALUES + WRONG] + [None, "", "plain"]
    out = [r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    for value, new in zip(VALUES, out):
        first, second = re.fullmatch(r"(?s)before (.*), after (.*)\nend", new).groups()
        assert first == second != value
        if len(value) == 40:
            assert re.fullmatch("[0-9a-f]{40}", first)
        elif "GB" not in value:
            assert form(first) == form(value)
    assert out[len(VALUES) :] == texts[len(VALUES) :]


def test_pii_against_a_plain_version(spark):
    """Every value of the real texts, and some odd ones, permuted by the plain version of the network."""
    real = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    more = [*VALUES, *WRONG, "иван@mail.ru", "Ωμεγα@x.gr", "1066-10-14", "0999-01-01", "31.12.9799", "2400-02-29", "1900-02-29", "5500005555555559 and +44 20 7946 0958", "a" * 200_000 + " x@y.org"]
    table = [*real, *((20_000 + i, v) for i, v in enumerate(more)), (30_000, None), (30_001, ""), (30_001, "x@y.org"), (30_001, "x@y.org")]
    df = spark.createDataFrame(table, "doc_id long, text string").withColumn("pii_found", F.lit("x"))
    got = rows(pii.pseudonymise(df, "k").select("doc_id", "text"))
    assert got == sorted(((d, plain_pii.pseudonymised(t, "k")) for d, t in table), key=str)
    assert pii.pseudonymise(df.limit(0)).count() == 0


def test_pii_is_a_permutation(spark):
    days = spark.range(0, 3000).select(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("text"))
    assert pii.pseudonymise(days).select("text").distinct().count() == 3000
    numbers = spark.range(0, 3000).select(F.format_string("555-%03d-%04d", F.col("id") % 1000, F.col("id")).alias("text"))
    assert pii.pseudonymise(numbers).select("text").distinct().count() == 3000
    assert pii.pseudonymise(days, "a").exceptAll(pii.pseudonymise(days, "a")).count() == 0
    assert pii.pseudonymise(days, "a").intersect(pii.pseudonymise(days, "b")).count() < 3000


def test_pii_card_stays_valid(spark):
    df = spark.createDataFrame([("4111111111111111",), ("5500005555555559",)], "text string")
    assert pii.pseudonymise(df).filter("pii_changed = 1 and luhn_check(text)").count() == 2


@pytest.mark.parametrize("split", ["64b", "1m"])
def test_warc(spark, split):
    evil = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    table = [(1, "u", None), (2, None, ""), (3, "ü\r\nx", "<p>\r\n\r\nWARC/1.1\r\n" + "é" * 200), (4, "b", evil * 3), (5, "c", evil * 3), (6, "d", "x" * 5000 + evil + "WARC/1.1\r\nContent-Length: zz\r\n\r\n"), (7, "e", "y" * 99), (8, "e", "y" * 99), (9, "f", "WARC/1.1\r\n")]
    first = {}
    for i, _, h in table:
        if len(b := (h or "").encode()) >= 100:
            first[b] = min(i, first.get(b, i))
    want = []
    for i, _, h in table:
        b = (h or "").encode()
        at = first.get(b, i)
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if at == i else "revisit", None if at == i else at))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split if split != "64b" else "700b")
    try:
        df = spark.createDataFrame(table, "page_id long, url string, html string").repartition(2)
        assert rows(warc.round_trip(df)) == sorted(want, key=str)
        assert warc.round_trip(df.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_warc_odd_rows(spark):
    """Repeated rows, null ids and columns with the names of results; empty payloads are all responses."""
    page = "<p>" + "x" * 200
    table = [(5, "u", page), (5, "u", page), (3, None, page), (3, "v", page), (None, "w", page), (8, "u", None), (9, "u", "")]
    df = spark.createDataFrame(table, "page_id long, url string, html string").withColumn("payload", F.lit("no")).withColumn("record_type", F.lit(1)).withColumn("first_id", F.lit("z"))
    sha = hashlib.sha256(page.encode()).hexdigest()
    none = hashlib.sha256(b"").hexdigest()
    want = [(5, 203, sha, "revisit", 3)] * 2 + [(3, 203, sha, "response", None)] * 2 + [(None, 203, sha, "revisit", 3), (8, 0, none, "response", None), (9, 0, none, "response", None)]
    assert rows(warc.round_trip(df)) == sorted(want, key=str)


def test_warc_broken_chain(spark, tmp_path):
    """A wrong length breaks a file's chain: what follows it is not returned, whatever it looks like; other files are."""
    df = spark.createDataFrame([(i, "u", f"<p>{i}" + "y" * 300) for i in range(30)], "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in ("128m", "900b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            at = str(tmp_path / f"w{split}")
            warc.write(df.repartition(2), at)
            broken, *others = sorted((tmp_path / f"w{split}").glob("part-*.txt"))
            parts = broken.read_bytes().split(b"WARC/1.1\r\n")
            assert len(parts) > 8
            kept = [int(re.search(rb"urn:page:(\d+)", p)[1]) for p in parts[1:5]]
            parts[5] = re.sub(rb"(?m)^(Content-Length: )\d+", rb"\g<1>7", parts[5], count=1)
            broken.write_bytes(b"WARC/1.1\r\n".join(parts))
            (tmp_path / f"w{split}" / f".{broken.name}.crc").unlink(missing_ok=True)
            whole = [int(x) for o in others for x in re.findall(rb"WARC-Record-ID: <urn:page:(\d+)", o.read_bytes())]
            got = {r.page_id for r in warc.read(spark, at).collect()}
            assert set(kept) | set(whole) <= got and len(got) <= len(kept) + len(whole) + 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_jaccard_odd_rows(spark):
    """Null and repeated ids, repeated rows, a very long text, columns with the names of results."""
    long = " ".join(f"x{i * 7919 % 100_003}" for i in range(60_000))
    table = [(1, "a b c d e f g"), (1, "q r s t u v"), (9, "q r s t u v"), (None, "a b c d e f g"), (3, "A b c d E f g"), (3, "A b c d E f g"), (4, None), (5, ""), (6, "one"), (7, "ONE"), (10, long), (11, long + " end")]
    df = spark.createDataFrame(table, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("component_id", F.lit(5))
    got = sorted(rows(jaccard.join(df)), key=str)
    long_n = len(brute.shingles(long))
    want = [(1, 3, 1), (1, 2, 1), (9, 2, 1), (None, 3, None), (3, 3, 1), (3, 3, 1), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6), (10, long_n, 10), (11, long_n + 1, 10)]
    assert got == sorted(want, key=str)
    kept = [(r.doc_id, (r.text or "")[:15]) for r in jaccard.keep_one(df).collect()]
    assert sorted(kept, key=str) == sorted([(1, "a b c d e f g"), (1, "q r s t u v"), (None, "a b c d e f g"), (4, ""), (5, ""), (6, "one"), (10, long[:15])], key=str)


def test_decontamination_odd_rows(spark, items_=ITEMS):
    """Null ids, repeated rows, a very long text, columns with the names of results, repeated and empty items."""
    passage = " ".join(f"W{i}" for i in range(100, 115))
    table = [(None, passage), (2, passage), (2, passage), (3, "z " * 200_000 + passage), (4, None), (5, "")]
    df = spark.createDataFrame(table, "doc_id long, text string").withColumn("n_hit", F.lit("x")).withColumn("contaminated", F.lit("y"))
    twice = items(spark).unionByName(items(spark))
    got = rows(decontamination.report(df, twice))
    assert got == sorted(brute.decontamination(table, ITEMS), key=str)
    out = decontamination.decontaminate(df, twice)
    assert out.columns == df.columns


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"][1]
    inside = "Some prose here. Released under the MIT License. More prose, and yet more of it follows."
    after = "Released under the MIT License. See LICENSE for details about it"
    texts = [None, "", "All rights reserved.", "x\nreleased UNDER the mit license\ny", mit.replace("charge, to", "charge,\nto"), "The MIT way of life", "Licensed under the Apache License, Version 2.0.\nAll rights reserved.", inside, after]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.licenses for r in licenses.by_document(df).orderBy("doc_id").collect()]
    assert got == ["", "", "all-rights-reserved", "MIT", "MIT", "", "Apache-2.0,all-rights-reserved", "MIT", "MIT"]
    found = rows(licenses.scan(df))
    assert [(d, a, b, n) for d, a, b, n, _ in found] == [(2, 0, 0, "all-rights-reserved"), (3, 1, 1, "MIT"), (4, 0, 1, "MIT"), (6, 0, 0, "Apache-2.0"), (6, 1, 1, "all-rights-reserved"), (7, 0, 0, "MIT"), (8, 0, 0, "MIT")]
    odd = spark.createDataFrame([(None, after, 1), ("x", after, 2), ("x", after, 2)], "doc_id string, text string, n_notices int")
    assert rows(licenses.by_document(odd)) == [("x", 1, "MIT", "MIT", 1.0)] * 2 + [(None, 1, "MIT", "MIT", 1.0)]
    assert licenses.scan(df.limit(0)).count() == licenses.by_document(df.limit(0)).count() == 0


def test_licenses_in_long_texts():
    """Very many notices in one text, and a very long word, take time in proportion."""
    scanner = licenses.Scanner()
    lines = "All rights reserved.\n" * 50_000
    assert len(scanner.scan(lines.encode())) == 50_000
    assert scanner.scan(b"all " * 200_000 + b"x" * 1_000_000 + b" all rights reserved") == [(0, 0, "all-rights-reserved", 1.0)]


def test_license_scan_against_all_stretches():
    """Every stretch of words against every template: the scan's first notice is the nearest of all, and nothing near is left over."""
    rng = np.random.default_rng(11)
    scanner = licenses.Scanner()
    names = [(n, licenses.words(x.encode())) for n, texts in licenses.TEMPLATES.items() for x in texts]
    for turn in range(12):
        name, w = names[rng.integers(len(names))]
        w = [x for x in w[: 60 + turn] if rng.random() > 0.05]
        text = [*(b"w%d" % i for i in rng.integers(0, 50, 5)), *w, *(b"v%d" % i for i in rng.integers(0, 50, 5))]
        best = 0.0
        for i in range(len(text)):
            for j in range(i + 2, len(text) + 1):
                bag = licenses.bigrams(text[i:j])
                best = max(best, max(licenses.dice(bag, b) for _, b in scanner.templates))
        found = scanner.scan(b" ".join(text))
        assert bool(found) == (best >= scanner.threshold)
        if found:
            assert abs(max(d for *_, d in found) - best) < 1e-12


def test_quality(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = quality.classify(real).join(labels, "doc_id").select("keep", "quality").collect()
    good = [r.keep for r in out if r.quality == 1]
    bad = [r.keep for r in out if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1
    odd = {r.doc_id: r for r in quality.classify(docs).collect()}
    assert not odd[10_000].keep and not odd[10_001].keep and odd[10_000].text is None
    assert quality.classify(spark.createDataFrame([], EMPTY)).count() == 0
    assert rows(quality.classify(docs).select("doc_id", "quality_score")) == rows(quality.classify(docs.repartition(3)).select("doc_id", "quality_score"))


def test_quality_odd_rows(spark):
    """String and null ids, rows repeated very often, a very long text, columns with the names of results."""
    text = "This is a plain sentence about the weather. " * 3
    table = [("a", text)] * 50 + [(None, text), ("b", None), ("c", "# $ % " * 200), ("d", "word and word. " * 100_000)]
    df = spark.createDataFrame(table, "doc_id string, text string").withColumn("votes", F.lit(3)).withColumn("keep", F.lit("x"))
    out = quality.classify(df).collect()
    assert len(out) == len(table) and len({r.quality_score for r in out if r.doc_id == "a"}) == 1
    assert all(isinstance(r.keep, bool) and (r.quality_score >= 0.5) == r.keep for r in out)


def test_quality_posteriors(spark):
    """Posteriors follow from votes, accuracies and the share of good texts, by Bayes' rule."""
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels, _ = quality.train(real)
    for pattern, posterior in zip(labels.patterns, labels.posterior):
        odds = np.log(labels.good / (1 - labels.good)) + sum((1 if v == quality.GOOD else -1) * np.log(a / (1 - a)) for v, a in zip(pattern, labels.accuracy) if v != quality.NOTHING)
        assert abs(1 / (1 + np.exp(-odds)) - posterior) < 1e-3


def test_label_model():
    """EM finds a labeller that is often wrong."""
    n = len(quality.RULES)
    patterns = {"0" * 5 + "-" * (n - 5): 100, "-" * (n - 2) + "11": 900, "-" * 7 + "0" + "-" * (n - 10) + "11": 300}
    model = quality.LabelModel().fit(patterns)
    assert model.accuracy[7] < 0.6 < 0.9 < model.accuracy[0] and model.of(list(patterns)[2]) > 0.9 and model.of(list(patterns)[0]) < 0.1


def test_toxicity(spark, docs):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.train_and_score(spark.read.parquet(f"{sf}/documents.parquet").join(labels.select("doc_id"), "doc_id"), labels)
    pairs = [(r.predicted, r.toxic) for r in out.filter("held_out").join(labels, "doc_id").collect()]
    hit = sum(p and t for p, t in pairs)
    assert hit / max(1, sum(p for p, _ in pairs)) > 0.9 and hit / sum(t for _, t in pairs) > 0.85
    model = toxicity.Model().fit([], toxicity.Lexicon({}))
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)


def test_toxicity_odd_rows(spark):
    """No labels, one label only, string and null ids, rows repeated very often, columns with the names of results."""
    table = [("1", "you stupid fool"), ("1", "you stupid fool"), (None, "you"), ("x", None), ("y", ""), ("z", "fool! " * 100_000)] + [("7", "same text")] * 40
    df = spark.createDataFrame(table, "doc_id string, text string").withColumn("score", F.lit("x")).withColumn("held_out", F.lit(1))
    labels = spark.createDataFrame([("1", 1), ("7", 1), ("7", 0), (None, 1), ("z", None)], "doc_id string, toxic int")
    for known, want in ((labels.limit(0), 0.0), (labels, 1.0)):
        out = toxicity.train_and_score(df, known).collect()
        assert len(out) == len(table) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
        assert {r.score for r in out} == {want}
    assert {r.held_out for r in out if r.doc_id is None} == {True}
    assert toxicity.train_and_score(df.limit(0), labels).count() == 0


def test_toxicity_lexicon(spark):
    """The learned beginnings and their odds against plain counts."""
    real = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    model = toxicity.train(spark.createDataFrame(list(real.items()), "doc_id long, text string"), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    rows_of = {d: (toxicity.bag(real[d]), int(y > 0)) for d, y in labels.items() if y is not None and d in real and zlib.crc32(str(d).encode()) % 5}
    n = [sum(1 for _, y in rows_of.values() if y == k) for k in (0, 1)]
    count = [defaultdict(int), defaultdict(int)]
    for b, y in rows_of.values():
        for g in b:
            count[y][g] += 1
    odds = {g: np.log((count[1][g] + 0.5) / (n[1] + 1)) - np.log((count[0][g] + 0.5) / (n[0] + 1)) for g in count[1]}
    strong = {g for g, o in odds.items() if o > 2.0 and count[0][g] + count[1][g] >= 4}
    assert set(model.marks.odds) <= strong and len(model.marks.odds) == min(len(strong), toxicity.LEARNED)
    assert all(abs(model.marks.odds[g] - odds[g]) < 1e-9 for g in model.marks.odds)


def test_isotonic_and_trees():
    iso = toxicity.Isotonic().fit(np.array([1.0, 2, 3, 4]), np.array([0, 1, 0, 1.0]))
    assert iso(np.array([0.0, 2.5, 9])).tolist() == [0.0, 0.5, 1.0]
    rng = np.random.default_rng(0)
    x = rng.random((500, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert (((toxicity.Trees().fit(x, y).score(x)) > 0) == (y > 0)).mean() > 0.95
